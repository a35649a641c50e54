"""Chat formatting: a finite-state machine over roles and a declarative template (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The backslash first: afterwards one stands in escapes only.
_ROLE_ESCAPES = (("\\", "\\s"), ('"', "\\q"), ("<", "\\l"))


@dataclass(frozen=True)
class Template:
    """What a formatted conversation looks like and which text is learned.

    ``head`` opens a turn (``{role}`` is filled in) and ``tail`` closes it.
    ``control`` names the strings that texts must not be able to imitate: after a
    ``<`` they get a backslash, and one more where they have some already, which
    makes the escape reversible for every text.  ``loss`` lists the roles whose
    texts count in the loss.  ``moves`` are the machine's transitions from
    (state, role) to a state; whatever is missing leads to ``error`` for good.
    """

    head: str = '<turn role="{role}">\n'
    tail: str = "</turn>\n"
    control: str = "/?turn"
    loss: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
            ("answered", "tool"): "called",
            ("called", "assistant"): "answered",
            ("called", "tool"): "called",
        }
    )

    def _around(self) -> tuple[str, str]:
        before, _, after = self.head.partition("{role}")
        return before, after

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"<(\\*{self.control})", r"<\\$1")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"<\\(\\*{self.control})", "<$1")

    @staticmethod
    def _role(role: Column) -> Column:
        """Roles stand inside quotation marks and before no escape: no mark, no backslash and no ``<`` may be left in one."""
        for plain, written in _ROLE_ESCAPES:
            role = F.replace(role, F.lit(plain), F.lit(written))
        return role

    @staticmethod
    def _unrole(role: Column) -> Column:
        for plain, written in reversed(_ROLE_ESCAPES):
            role = F.replace(role, F.lit(written), F.lit(plain))
        return role


def format_conversations(
    turns: DataFrame,
    template: Template = Template(),
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Conversations as marked text with loss flags.

    Returns one row per conversation: ``conv_id``, ``n_turns``, ``formatted``,
    ``segments`` (array of text and loss flag, in order; their concatenation is
    ``formatted``), ``state`` (the machine's last one), ``first_wrong`` (index of the
    first turn that no transition allows, else null) and ``valid``.
    Null texts and roles count as empty strings, a null turn sorts first, rows
    that tie in turn are ordered by role and text, repeated rows are turns of
    their own, and rows with a null conversation form one conversation.  An
    invalid order of roles is reported, not dropped.  An empty table gives an
    empty table; further columns are ignored.  A conversation is one string in
    the end, so its turns meet in one task; nothing else does.
    """
    before, after = template._around()
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    moves = F.create_map(*[F.lit(x) for (state, by), to in template.moves.items() for x in (f"{state}|{by}", to)])
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def segment(x: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(before), template._role(x["role"]), F.lit(after)).alias("text"), F.lit(False).alias("loss")),
            F.struct(template.escape(x["text"]).alias("text"), x["role"].isin(*template.loss).alias("loss")),
            F.struct(F.lit(template.tail).alias("text"), F.lit(False).alias("loss")),
        )

    def move(acc: Column, x: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(acc["s"], F.lit("|"), x["role"])), F.lit("error"))
        wrong = F.when(acc["wrong"].isNull() & (to == "error"), acc["i"]).otherwise(acc["wrong"])
        return F.struct(to.alias("s"), (acc["i"] + 1).alias("i"), wrong.alias("wrong"))

    machine = F.aggregate(
        "t",
        F.struct(F.lit(template.start).alias("s"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("wrong")),
        move,
    )
    return (
        whole.withColumn("segments", F.flatten(F.transform("t", segment)))
        .withColumn("machine", machine)
        .select(
            "conv_id",
            F.size("t").cast("long").alias("n_turns"),
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "segments",
            F.col("machine.s").alias("state"),
            F.col("machine.wrong").alias("first_wrong"),
            F.col("machine.s").isin(*template.accept).alias("valid"),
        )
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns and the learned texts, parsed from ``formatted`` and its loss flags.

    Adds ``turns`` (array of role and text) and ``learned`` (array of texts under
    the loss mask, unescaped).  Texts come from the marked string; the mask says
    only which turns' texts count.
    """
    before, after = template._around()
    pieces = F.split("formatted", rf"\Q{template.tail}\E", -1)
    parsed = F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            template._unrole(F.substring_index(p.substr(F.lit(len(before) + 1), F.length(p)), after, 1)).alias("role"),
            template.unescape(p.substr(F.instr(p, after) + F.lit(len(after)), F.length(p))).alias("text"),
        ),
    )
    with_turns = formatted.withColumn("turns", parsed)
    flagged = F.filter(F.transform("segments", lambda s: s["loss"]), lambda _, i: i % 3 == 1)
    return with_turns.withColumn(
        "learned",
        F.transform(F.filter(F.arrays_zip(F.col("turns").alias("turns"), flagged.alias("loss")), lambda z: z["loss"]), lambda z: z["turns"]["text"]),
    )
