"""The chunk index: upserts and deletes of a table, one plan each; ``operators.store`` keeps one in buckets and rewrites few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clausewise.functions.text import is_statute


def upsert(index: DataFrame, incoming: DataFrame, seq: str = "pos", start: int | None = None) -> DataFrame:
    """``index`` with ``incoming`` rows: the last row of an id wins, an old id keeps its place, new ones come after all.

    A null id is an id like any other. New places count from ``start``, or else from the greatest place of ``index`` on.
    """
    same = W.partitionBy("id")
    numbered = incoming.withColumn("_n", F.row_number().over(same.orderBy(F.desc(seq)))).withColumn("_first", F.min(seq).over(same))
    last = numbered.where("_n = 1").drop("_n")
    old = index.select(F.col("id").alias("_id"), F.col("pos").alias("_old"), F.lit(True).alias("_known"))
    placed = last.join(old, F.col("id").eqNullSafe(F.col("_id")), "left")
    if start is None:
        placed = placed.join(F.broadcast(index.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("_offset"))))
    else:
        placed = placed.withColumn("_offset", F.lit(start).cast("long"))
    place = F.when(F.col("_known"), F.col("_old")).otherwise(F.col("_offset") + F.col("_first"))
    fresh = placed.withColumn("pos", place).select(*index.columns)
    gone = incoming.select(F.col("id").alias("_id")).distinct()
    kept = index.join(gone, F.col("id").eqNullSafe(F.col("_id")), "left_anti")
    return kept.select(*index.columns).unionByName(fresh)


def delete_statute(index: DataFrame, regulation: str) -> DataFrame:
    """Without one regulation's statute; its other documents stay."""
    return index.where(~(F.col("regulation").eqNullSafe(regulation) & is_statute(F.col("doc_type"))))


def delete_document(index: DataFrame, regulation: str, label: str) -> DataFrame:
    return index.where(~(F.col("regulation").eqNullSafe(regulation) & F.col("document_label").eqNullSafe(label)))


def replace(index: DataFrame, chunks: DataFrame, regulation: str, label: str | None = None) -> DataFrame:
    """Re-ingestion: delete, then upsert."""
    return upsert(delete_statute(index, regulation) if label is None else delete_document(index, regulation, label), chunks)


def save(index: DataFrame, path: str) -> None:
    """Parquet by regulation, so that filters on it prune folders. ``path`` must not be one that ``index`` reads."""
    index.write.mode("overwrite").partitionBy("regulation").parquet(path)
