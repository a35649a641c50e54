"""Licence scans (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.license_rules import BASE, Rule, rules

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _gate_word(keyword: str) -> str:
    """The word of a keyword that few texts have."""
    return max(keyword.split(), key=len)


def _gate(table: list[Rule]) -> Column:
    """Words of which every text that holds a rule's keyword or a base phrase has one, and few others have any."""
    keywords = {r.keyword for r in table} | {p for p, _ in BASE}
    return F.array(*[F.lit(w) for w in sorted(set(map(_gate_word, keywords)))])


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(norm: Column, pattern: Column) -> Column:
    """Where ``pattern`` stands among the words of ``norm``: an array of (first, last) word numbers."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    pieces = F.split(norm, whole, -1)
    hits = F.regexp_extract_all(norm, whole, F.lit(0))
    walked = F.aggregate(
        F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit")),
        F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + _spaces(x["gap"]) + _spaces(x["hit"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + _spaces(x["gap"])).alias("first"),
                        (acc["at"] + _spaces(x["gap"]) + _spaces(x["hit"])).alias("last"),
                    )
                ),
            ).alias("out"),
        ),
    )
    return walked["out"]


def scan_licenses(
    docs: DataFrame, table: list[Rule] | None = None, *, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Licence detections in whole texts; no shuffle.

    Texts are lowered (A-Z) and cut into words.  A text that holds no
    rule's gate word (the longest of its keyword) passes with empty results; on others
    each rule whose gate word and keyword occur is matched over the words.  Detections are resolved in order of their
    first word, the longer one first: one that lies inside a detection of the same
    or a better tier is suppressed.  Returns ``doc_id, n_words, base`` (array of
    first word, last word, label of the fixed phrases), ``detections`` (count that
    survive), ``labels`` (sorted), ``score`` (the best confidence that survives).
    Null and empty texts have no words; null ids, repeated rows and very long
    texts are rows like others; an empty table gives an empty table; further
    columns are ignored.
    """
    table = rules() if table is None else table
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    norm = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    source = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    none = F.lit(None).cast("string")
    # lower() differs from A-Z lowering in other letters only, which neither count nor gate depends on
    base = source.withColumn("low", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).select(
        "doc_id",
        F.size("low").cast("long").alias("n_words"),
        F.array_intersect("low", _gate(table)).alias("hits"),
        "text",
    )
    base = base.select("doc_id", "n_words", "hits", F.when(F.size("hits") > 0, norm).otherwise(none).alias("norm"))
    listed = F.array(
        *[
            F.struct(
                F.lit(r.label).alias("label"),
                F.lit(_gate_word(r.keyword)).alias("word"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(r.pattern).alias("pattern"),
                F.lit(r.tier).alias("tier"),
                F.lit(r.confidence).alias("confidence"),
            )
            for r in table
        ]
    )
    found = F.flatten(
        F.transform(
            F.filter(listed, lambda r: F.array_contains(F.col("hits"), r["word"]) & F.contains(F.col("norm"), r["keyword"])),
            lambda r: F.transform(
                _places(F.col("norm"), r["pattern"]),
                lambda p: F.struct(
                    p["first"].alias("first"),
                    (-p["last"]).alias("end"),
                    r["tier"].alias("tier"),
                    r["label"].alias("label"),
                    r["confidence"].alias("confidence"),
                ),
            ),
        )
    )
    tiers = sorted({r.tier for r in table})

    def resolve(acc: Column, d: Column) -> Column:
        # seen[i]: the furthest word that a detection of tier i has covered; starts are in order
        inside = F.lit(False)
        for i, t in enumerate(tiers):
            inside = inside | ((d["tier"] >= t) & (acc["seen"][i] >= -d["end"]))
        seen = F.array(
            *[F.when(d["tier"] == t, F.greatest(acc["seen"][i], -d["end"])).otherwise(acc["seen"][i]) for i, t in enumerate(tiers)]
        )
        return F.struct(
            F.when(inside, acc["seen"]).otherwise(seen).alias("seen"),
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, acc["n"]).otherwise(acc["n"] + 1).alias("n"),
            F.when(inside, acc["best"]).otherwise(F.greatest(acc["best"], d["confidence"])).alias("best"),
        )

    kept = F.aggregate(
        F.array_sort(found),
        F.struct(
            F.array(*[F.lit(-1) for _ in tiers]).alias("seen"),
            F.array().cast("array<string>").alias("labels"),
            F.lit(0).alias("n"),
            F.lit(0.0).alias("best"),
        ),
        resolve,
    )

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(
            _places(F.col("norm"), F.lit(phrase)),
            lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), F.lit(label).alias("label")),
        )

    fixed = F.flatten(F.array(*[labelled(*b) for b in BASE]))
    gated = F.col("norm").isNotNull()
    return base.select(
        "doc_id",
        "n_words",
        F.when(gated, fixed).otherwise(F.array().cast("array<struct<first:int,last:int,label:string>>")).alias("base"),
        F.when(gated, kept).alias("kept"),
    ).select(
        "doc_id",
        "n_words",
        "base",
        F.coalesce(F.col("kept.n"), F.lit(0)).cast("long").alias("detections"),
        F.array_sort(F.coalesce(F.col("kept.labels"), F.array().cast("array<string>"))).alias("labels"),
        F.coalesce(F.col("kept.best"), F.lit(0.0)).alias("score"),
    )
