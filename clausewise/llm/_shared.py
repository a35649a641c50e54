"""Helpers that several operators of this folder need."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.session import delete, scratch_dir


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch_dir(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read back with the same schema."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df._scratch_path)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, component)``.

    A component is named by its smallest node.  Alternating large-star and
    small-star steps (Kiveris et al., 2014): each is one partially aggregated
    minimum and one equi-join, so no neighbourhood is ever gathered in a task, and
    the number of rounds grows with the logarithm of the graph.  Every round is
    written to the shared folder.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    mark = state(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # an edge whose lower end is the star's centre is in ``large`` from its other side
        large = scratch.keep(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(large)
        scratch.drop(now)
        now = after
        before, mark = mark, state(now)
        if mark == before:
            break
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return members.unionByName(roots).distinct()


def batches(columns: dict[str, pa.DataType]) -> Callable[[dict[str, list]], pa.RecordBatch]:
    """A maker of record batches of one schema from lists by name."""
    schema = pa.schema(list(columns.items()))
    return lambda data: pa.RecordBatch.from_arrays([pa.array(data[n], t) for n, t in columns.items()], schema=schema)


def small_slices(stream: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column`` (``a.b``: field b of a) at the most, one row at least."""
    outer, _, inner = column.partition(".")
    for batch in stream:
        values = pc.struct_field(batch.column(outer), inner) if inner else batch.column(outer)
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def held_out(column: str = "doc_id"):
    """Whether a row belongs to the fold that no model may learn from; a null id counts as empty text, so it does."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
