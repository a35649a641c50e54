"""Filter interaction audit: what filters remove in each order, with duplicates by partition refinement."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm._shared import Scratch

#: Ends of the blocks of code points that are hashed one after the other; the last block reaches to the end.
BLOCKS = (64, 512, 4096)
#: A class that holds a larger share than one in so many rows is joined by broadcast: there are at most that many.
HEAVY = 1000

_SPACES = "[\\x20\\x09-\\x0D]+"


def failing(text: Column) -> dict[str, Column]:
    """The production filters but the duplicates: letter to failure condition of a text that isn't null."""
    words = F.array_remove(F.split(text, _SPACES), "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * upper.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _block_hashes(text: Column) -> list[Column]:
    starts = (0, *BLOCKS)
    ends = (*BLOCKS, 2**31 - 1)
    return [F.xxhash64(F.substring(text, a + 1, b - a)) for a, b in zip(starts, ends, strict=True)]


def _refined(key: Column, block: Column) -> Column:
    return F.xxhash64(key, block)


def _class_join(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns of their class in ``classes`` (key, rows, ...); rows of no class go.

    No key's rows meet in one task: classes with a thousandth of ``total`` or more
    are a thousand at most, so they are broadcast, and only rows of others move.
    """
    heavy = classes.where(F.col("rows") * HEAVY > total)
    light = classes.where(F.col("rows") * HEAVY <= total)
    there = rows.join(F.broadcast(heavy), "key")
    others = rows.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(light, "key")
    return there.unionByName(others)


def duplicates(docs: DataFrame, scratch: Scratch, carried: DataFrame | None = None) -> DataFrame:
    """Rows whose text equals that of a smaller id, with the carried columns.

    ``docs`` has ``doc_id`` and ``text`` (no nulls in it); ``carried``, if given, is a stored
    narrow table of the same rows with ``doc_id, key, h0, h1, ...`` (see ``digests``)
    and further columns, which come back.  Classes start as the code-point lengths;
    each round splits them by the hash of the texts' next block and drops classes of one
    row.  Only narrow rows take part.  Texts of the classes that survive all rounds are
    compared whole: equal ones meet in a partially aggregated count, so of a group
    of copies a task sends one text, and rows of a class with one text are equal.  A
    class that holds several texts (equal hashes) is joined by the text itself.

    Of equal texts all rows of the smallest id are no duplicates; rows with a null id
    are smaller than none and larger than none, so they never are and make no others.
    """
    rows = carried if carried is not None else scratch.keep(docs.select("doc_id", *digests(F.col("text"))))
    hashes = [f"h{i}" for i in range(len(BLOCKS) + 1)]
    extra = [c for c in rows.columns if c not in ("key", *hashes)]
    total = rows.count()
    live = rows.where("doc_id IS NOT NULL")
    for step in range(len(hashes) + 1):
        counts = live.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
        left = hashes[step:]
        key = _refined(F.col("key"), F.col(left[0])) if left else F.col("key")
        live = _class_join(live, counts, total).select(*extra, key.alias("key"), *left[1:])
        live = scratch.keep(live)
    key, *parts = digests(F.col("text"))
    chain = key
    for h in parts:
        chain = _refined(chain, h)
    wanted = scratch.keep(live.select("key").distinct())
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", chain.alias("key"), "text").join(wanted, "key", "left_semi")
    same = texts.groupBy("key", "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = same.groupBy("key").agg(F.min("least").alias("least"), F.sum("n").alias("rows"), F.count("*").alias("texts"))
    classes = scratch.keep(classes)
    marked = _class_join(live, classes.where("texts = 1"), total).where("doc_id > least").select(*extra)
    mixed = classes.where("texts > 1").select("key")
    if mixed.isEmpty():
        return marked
    # different texts with equal hashes: rows are told apart by their texts
    unlike = texts.join(mixed, "key", "left_semi")
    least = unlike.groupBy("key", "text").agg(F.min("doc_id").alias("least"))
    again = unlike.join(least, ["key", "text"]).where("doc_id > least").select("doc_id", "key").distinct()
    # one id may have several texts, so rows are joined with the key, too
    return marked.unionByName(live.join(again, ["doc_id", "key"], "left_semi").select(*extra))


def digests(text: Column) -> list[Column]:
    """``key`` (the length) and the hash of each block."""
    return [F.length(text).cast("long").alias("key"), *[h.alias(f"h{i}") for i, h in enumerate(_block_hashes(text))]]


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters=failing,
    *,
    duplicate: str = "E",
    id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """What each filter removes, for every order of the filters, part and step.

    ``filters`` maps a text Column to failure conditions by letter; ``duplicate`` is the letter
    of the texts that equal a smaller id's anywhere in the table.  Every row becomes
    the letters that it fails; only counts of these masks, two to the number of filters
    for each part, meet the orders.  Returns ``part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley``, counts of rows.

    A null part is the empty string, a null text is empty; texts of any length are read
    whole; repeated rows count as often as they stand there and (having the same id) don't
    make each other duplicates; a null id has no label and is no duplicate.  An
    id with several labels is good or toxic if one of them says so; null labels say
    nothing.  Further columns are ignored whatever their names; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "audit")
    rows = docs.select(
        F.col(id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    conditions = filters(F.col("text"))
    letters = sorted([*conditions, duplicate])
    mask = F.concat(*[F.when(conditions[c], F.lit(c)).otherwise(F.lit("")) for c in letters if c != duplicate])
    marks = (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    plain = rows.select("doc_id", "part", mask.alias("mask"), *digests(F.col("text")))
    narrow = scratch.keep(plain.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}))
    twice = duplicates(rows, scratch, narrow)
    groups = ["part", "mask", "good", "toxic"]
    count = lambda df: df.groupBy(*groups).agg(F.count("*").alias("n"))
    again = scratch.keep(count(twice))
    moved = again.withColumn("mask", F.concat("mask", F.lit(duplicate)))
    counts = count(narrow).unionByName(again.withColumn("n", -F.col("n"))).unionByName(moved)
    counts = counts.groupBy(*groups).agg(F.sum("n").alias("n"))
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    steps = counts.withColumn("filter_order", F.explode(orders)).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")
    )
    letter = F.expr("substring(filter_order, step, 1)")
    earlier = F.expr("substring(filter_order, 1, step - 1)")
    fails = F.contains("mask", letter)
    gone = _meets(earlier)
    removed = fails & ~gone
    per_order = F.expr(f"{factorial(len(letters))} div greatest(length(mask), 1)")
    total = lambda c, n=F.col("n"): F.sum(F.when(c, n).otherwise(0)).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(removed).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == letter).alias("unique_fails"),
        total(removed & (F.col("good") == 1)).alias("good_lost"),
        total(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
        # the filter comes first among those that a row fails in one of as many orders as it fails
        total(fails, F.col("n") * per_order).alias("shapley"),
    )


def _meets(letters: Column) -> Column:
    """Whether ``mask`` has one of ``letters``."""
    return F.exists(F.split(F.col("mask"), ""), lambda c: (c != "") & F.contains(letters, c))
