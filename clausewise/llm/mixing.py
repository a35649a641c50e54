"""Mixing sources to target weights (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clausewise.llm._shared import Scratch

_NULL = "\x00null"
BUCKETS = 4096
ADDED = ("mix_block", "mix_key", "mix_weight", "mix_tokens")


def count_tokens(text: Column) -> Column:
    """White-space separated words: the token counts that mixing weighs by."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \n\t\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \n\t\r]+"))).cast("long")


def bisect_exponent(totals: DataFrame, *, repetition: float | None = None, entropy: float | None = None, steps: int = 5, ways: int = 32) -> float:
    """The exponent that meets the target, by ``ways``-fold bisection.

    ``totals(source, tokens, share)``: one row per source with tokens.  Weights are
    ``share ** a``, normalised.  For a repetition limit: the smallest ``a`` in [0, 1]
    at which no source is repeated more than ``repetition`` times under a budget
    that drops nothing, which is ``(largest share / smallest share) ** (1 - a)``.
    For a target entropy (nats): the ``a`` at which the weights' entropy is
    ``entropy``, or the nearest end.  Each step is one aggregate over the sources
    for all exponents of the bracket at once, so any number of sources will do;
    one row of sums per exponent reaches the driver.
    """
    low, high = 0.0, 1.0 if entropy is None else 4.0
    for _ in range(steps):
        grid = [low + (high - low) * i / ways for i in range(ways + 1)]
        sums: list[Column] = []
        for i, a in enumerate(grid):
            p = F.pow("share", F.lit(a))
            sums += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log("share")).alias(f"l{i}"), F.max(p / F.col("share")).alias(f"r{i}"), F.min(p / F.col("share")).alias(f"m{i}")]
        row = totals.agg(*sums).first()
        if row["z0"] is None:
            return 1.0

        def past(i: int) -> bool:
            """Whether the exponent is large enough."""
            if entropy is None:
                return row[f"r{i}"] / row[f"m{i}"] <= repetition * (1 + 1e-12)
            z = row[f"z{i}"]
            return math.log(z) - grid[i] * row[f"l{i}"] / z <= entropy

        if past(0):
            return grid[0]
        if not past(ways):
            return grid[ways]
        first = next(i for i in range(ways + 1) if past(i))
        low, high = grid[first - 1], grid[first]
    return high


def mix(
    docs: DataFrame,
    *,
    repetition: float | None = 2.0,
    entropy: float | None = None,
    budget: float | None = None,
    seed: int = 1,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` with its rows repeated so that sources reach temperature weights.

    Source ``s`` with share ``p`` of all tokens gets the weight ``p ** a / sum`` with
    ``a`` from ``bisect_exponent`` and the token budget ``weight * budget``.  Without a
    given budget it is the smallest one under which no source loses documents, so
    the source that is over-represented most is taken exactly once and every other
    one at least once.  A source's budget is filled by blocks: whole permutations of
    its documents while they fit, then a prefix of one more permutation that ends
    before the budget does.

    Adds ``mix_block`` (0, 1, ...: the permutation), ``mix_key`` (a document's place in
    that permutation is the rank of this hash), ``mix_weight`` and ``mix_tokens``; a
    document of a budgeted prefix only comes with the blocks it is in.  Documents
    without tokens cost nothing: they are in every whole permutation and, if there
    is none, in the prefix where their hash puts them.  A null source is a source
    of its own; null ids and null texts are allowed; repeated rows are rows of
    their own with one common place, in or out of the prefix together; an empty table gives an empty table; other
    columns pass unchanged, but columns of ``docs`` named like the added ones give
    way to them.

    The prefix is found without ordering a source in one task: token totals by
    (source, hash bucket) are summed along the buckets, which tells for all buckets
    but one per source whether they are in; that one is cut into as many finer ones
    in the same way, and only narrow rows of one of these are ordered.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    columns = [c for c in docs.columns if c not in ADDED]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    named = docs.select(
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(_NULL)).alias("s"),
        F.shiftrightunsigned(F.when(F.col(f"`{id}`").isNull(), F.xxhash64(F.lit(seed), whole)).otherwise(F.xxhash64(F.lit(seed), F.col(f"`{id}`"), F.col(f"`{source}`"))), 1).alias("h"),
        F.col(f"`{text}`").alias("text"),
        whole.alias("row"),
    )
    counted = count_tokens(F.col("text")).alias("n")
    bits = (BUCKETS - 1).bit_length()
    bucket = F.shiftright("h", 63 - bits).cast("int")
    # another 12 bits of the same hash: the buckets within a bucket
    finer = F.shiftright("h", 63 - 2 * bits).bitwiseAND(BUCKETS - 1).cast("int")
    sums = scratch.keep(named.select("s", "h", counted).groupBy("s", bucket.alias("b")).agg(F.sum("n").alias("n")))
    every = sums.groupBy("s").agg(F.sum("n").alias("tokens"))
    total = every.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    shares = scratch.keep(every.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total or 1))))
    a = bisect_exponent(shares, repetition=repetition, entropy=entropy)
    z, least = shares.agg(F.sum(F.pow("share", F.lit(a))), F.max(F.col("share") / F.pow("share", F.lit(a)))).first()
    z = z or 1.0
    tokens = float(budget) if budget is not None else (least or 0.0) * z * total
    plan = every.withColumn("share", F.col("tokens") / F.lit(float(total or 1))).select(
        "s",
        "tokens",
        F.when(F.col("tokens") > 0, F.pow("share", F.lit(a)) / F.lit(z)).otherwise(0.0).alias("weight"),
    )
    # rounding of the powers must not cost the scarcest source its last block
    goal = F.floor(F.col("weight") * F.lit(tokens) + F.lit(1e-6) * F.col("tokens") + F.lit(1e-6)).cast("long")
    plan = plan.select(
        "s",
        "weight",
        F.when(F.col("tokens") > 0, F.floor(goal / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long").alias("full"),
        F.when(F.col("tokens") > 0, goal % F.greatest("tokens", F.lit(1))).otherwise(0).cast("long").alias("rest"),
    )
    along = W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)

    def boundary(totals: DataFrame, cut: str, before: str) -> DataFrame:
        """The first bucket of each source in which the budget ends, and the tokens before it; none if it ends with a whole block."""
        summed = totals.withColumn("t", F.col("start") + F.coalesce(F.sum("n").over(along), F.lit(0)))
        inside = (F.col("rest") > 0) & (F.col("t") <= F.col("rest")) & (F.col("t") + F.col("n") > F.col("rest"))
        return summed.where(inside).groupBy("s").agg(F.min(F.struct("b", "t")).alias("c")).select("s", F.col("c.b").alias(cut), F.col("c.t").alias(before))

    plan = scratch.keep(plan.join(boundary(sums.join(plan, "s").withColumn("start", F.lit(0)), "cut", "before"), "s", "left"))
    ends = plan.where("cut IS NOT NULL").select("s", "cut", "before", "rest")
    # the bucket where a budget ends is cut again, and then ordered: narrow rows, one in 16 million of a source
    within = named.withColumn("at", bucket).join(ends, "s").where(F.col("at") == F.col("cut"))
    narrow = scratch.keep(within.select("s", "h", counted, F.xxhash64("row").alias("r"), finer.alias("b"), F.col("before").alias("start"), "rest"))
    fine = narrow.groupBy("s", "b", "start", "rest").agg(F.sum("n").alias("n"))
    last = narrow.drop("start").join(boundary(fine, "cut2", "start"), "s").where(F.col("b") == F.col("cut2"))
    order = W.partitionBy("s").orderBy("h", "r").rowsBetween(W.unboundedPreceding, 0)
    # the last hash and row that are in; equal rows share one, and are in together or not at all
    row = last.groupBy("s", "h", "r", "start", "rest").agg(F.sum("n").alias("n"))
    kept = row.withColumn("t", F.col("start") + F.sum("n").over(order)).where(F.col("t") <= F.col("rest"))
    edge = kept.groupBy("s").agg(F.max(F.struct("h", "r")).alias("edge"))
    plan = scratch.keep(plan.join(boundary(fine, "cut2", "start").select("s", "cut2"), "s", "left").join(edge, "s", "left"))
    place, here = F.struct(bucket.alias("b"), finer.alias("f")), F.struct(F.col("cut").alias("b"), F.col("cut2").alias("f"))
    before_ = (place < here) | ((place == here) & (F.struct("h", F.xxhash64("row").alias("r")) <= F.col("edge")))
    taken = named.select("s", "h", counted, "row").join(plan, "s").withColumn("more", F.coalesce(F.col("cut").isNotNull() & before_, F.lit(False)))
    blocks = F.col("full") + F.col("more").cast("long")
    taken = taken.where(blocks > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return taken.select(
        "row.*",
        F.col("block").alias("mix_block"),
        F.when(F.col("block") == F.col("full"), F.col("h")).otherwise(F.shiftrightunsigned(F.xxhash64("h", "block"), 1)).alias("mix_key"),
        F.col("weight").alias("mix_weight"),
        F.col("n").alias("mix_tokens"),
    )
