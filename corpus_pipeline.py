"""A corpus pipeline: quality, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.llm import linededup, mixing, ordermin, packing, quality
from clausewise.llm._shared import Scratch

#: No SQL: the model of stage one, sketches and the tokenizer have no SQL form.
ORACLE_SQL = None

QUALITY_LEAST = 0.3
NEAR = 0.8
REPETITION = 2.0
WINDOW = 2048


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that an operator would overwrite renamed, and what gives all columns their names back."""
    away = {c: f"{c} of the documents" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(away), [F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote for quality; the others go.

    Null and empty texts are judged as texts without words, texts of any length are
    read whole, equal texts and repeated rows are judged alike, a null id is no
    hindrance, other columns pass whatever their names, and an empty table stays
    empty.  Without labels all documents stay.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, carry=True).where(F.col("score") >= QUALITY_LEAST).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from texts; a document of which nothing is left goes, too.

    The first place (the smallest id; a null one counts as smaller) keeps a chunk.
    Null, empty and blank texts pass as they came, texts of any length are cut
    whole, repeated rows keep the same, ``n_chars`` follows a text that got shorter,
    other columns pass whatever their names, and an empty table stays empty.
    """
    rows, named = _aside(docs, linededup.ADDED)
    cut = linededup.dedup_lines(rows)
    left = cut.where((F.col("removed_chunks") == 0) | (F.btrim("text", F.lit(" \n\t\r")) != ""))
    length = F.when(F.col("removed_chunks") > 0, F.length("text").cast("long"))
    return left.withColumn("n_chars", F.coalesce(length, "n_chars")).select(*named)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id.

    Null texts count as empty, and texts without words are copies if their bytes are
    equal.  All rows of the id that stays do, rows without an id do, too; texts
    of any length are compared whole, other columns pass whatever their names,
    and an empty table stays empty.
    """
    kept = ordermin.near_duplicates(docs, threshold=NEAR).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at temperature weights: scarce ones come up to ``REPETITION`` times, none loses a document. Rows follow the permutations.

    A null source is a source of its own; null and empty texts weigh nothing and
    come with each whole permutation; equal hashes order by the row, and repeated
    rows are in a block together; texts of any length are counted whole; other
    columns pass whatever their names, and an empty table stays empty.
    """
    rows, named = _aside(docs, mixing.ADDED)
    return mixing.mix(rows, repetition=REPETITION).orderBy("mix_block", "mix_key").select(*named)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens: pieces with their ids and places, in the order of the rows.

    Null and empty texts are their end id, repeated rows and null ids are packed
    like others, texts of any length become as many pieces as they touch windows,
    other columns are ignored, and an empty table gives no pieces.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, path, length=WINDOW, end_id=1).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
