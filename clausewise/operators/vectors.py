"""A stored index of vectors: inverted lists of centroids, of which a search reads some."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from clausewise.operators.rank import DIGITS, QUESTIONS, SEMANTIC_FLOOR, top
from clausewise.session import map_batches

#: Vectors that the centroids are fitted on, and lists, at the most; a list's files hold so many rows.
SAMPLE, LISTS, FILE_ROWS = 65_536, 16_384, 200_000
#: Sampled vectors that serve as questions when the number of probed lists is chosen.
TRIED = 256


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _centroids(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; a centroid that loses all its vectors starts again at one that fits its own badly."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        nearest, fit = _nearest_centroid(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) == 0)
        sums[empty] = sample[np.argsort(fit)[: len(empty)]]
        centres = _unit(sums)
    return centres


def _nearest_centroid(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    at, fit = np.zeros(len(x), np.int64), np.zeros(len(x))
    for k in range(0, len(x), block):
        score = x[k : k + block] @ centres.T
        at[k : k + block], fit[k : k + block] = score.argmax(1), score.max(1)
    return at, fit


def _probes_for(sample: np.ndarray, centres: np.ndarray, n: int, recall: float) -> int:
    """How many lists hold this share of the ``n`` nearest of a question, on average over sampled ones."""
    asked = sample[:: max(1, len(sample) // TRIED)]
    own, _ = _nearest_centroid(sample, centres)
    scores = asked @ sample.T
    nearest = np.argsort(-scores, axis=1, kind="stable")[:, :n]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    needed = np.sort(np.take_along_axis(place, own[nearest], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def _rows(vectors: DataFrame) -> DataFrame:
    """Vectors that have a direction."""
    sound = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))) & F.exists("vector", lambda x: x != 0)
    return vectors.where(F.coalesce(sound, F.lit(False)))


def build(vectors: DataFrame, path: str, *, lists: int | None = None, recall: float = 0.97, n: int = 18, rounds: int = 8, seed: int = 7) -> "VectorIndex":
    """Stores ``vectors`` (id, pos, vector, metadata) as inverted lists at ``path`` and opens them.

    Centroids, twice the root of the number of rows unless ``lists`` says otherwise, are
    fitted on at most ``SAMPLE`` vectors (those of the smallest hashes); every vector
    then goes to the list of its nearest centroid.  A list is a folder, so a search
    reads the probed ones only; a list with many rows is many files, each written by a
    task of its own.  The number of lists that a search probes is the least that holds
    ``recall`` of the ``n`` nearest neighbours within the sample.  Vectors without a direction (null, empty,
    zero, with nulls or NaNs) are near nothing and aren't stored.
    """
    spark = vectors.sparkSession
    rows = _rows(vectors)
    known = rows.count()
    drawn = rows.select(F.col("vector").cast("array<double>").alias("vector"), F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE)
    sample = _unit(np.array([r.vector for r in drawn.collect()], dtype=float)) if known else np.zeros((0, 1))
    lists = max(1, min(lists or int(2 * np.sqrt(known)), LISTS, len(sample)))
    centres = _centroids(sample, lists, rounds, seed) if known else np.zeros((1, 1))
    probes = _probes_for(sample, centres, n, recall) if known else 1
    shared = spark.sparkContext.broadcast(centres)
    columns = rows.columns
    at = pa.field("list", pa.int32())

    def assign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                v = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
                yield batch.append_column(at, pa.array(_nearest_centroid(_unit(v), shared.value)[0].astype(np.int32)))

    placed = map_batches(rows, assign, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", list int")
    # counts of at most LISTS lists tell how many tasks write each
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("parts"))
    salted = placed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    spread = salted.repartition("list", "part").select(*columns, "list")
    spread.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("list").parquet(f"{path}/lists")
    about = [(k, c.tolist(), probes, known) for k, c in enumerate(centres)]
    spark.createDataFrame(about, "list int, centroid array<double>, probes int, known long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return open_vectors(spark, path)


@dataclass(frozen=True)
class VectorIndex:
    """Stored vectors by list, their centroids, and how many lists a search probes."""

    vectors: DataFrame | None
    centroids: np.ndarray
    probes: int

    def nearest(self, queries: DataFrame, n: int, *, probes: int | None = None, floor: float | None = SEMANTIC_FLOOR, condition: Column | None = None) -> DataFrame:
        """(query_id, rank, id, score, pos): the ``n`` nearest vectors in each question's ``probes`` nearest lists, then those above the floor.

        ``queries`` has query_id and vector.  Blocks of ``QUESTIONS`` questions are broadcast with
        the lists that they probe; of the stored vectors only the folders of those
        lists are read.  With all lists probed the result is exact.  Questions without a direction
        find nothing.
        """
        asked = _rows(queries).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        probes = min(probes or self.probes, len(self.centroids))
        blocks = max(1, -(-asked.count() // QUESTIONS))
        found = None
        for k in range(blocks):
            block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
            near = self._block(block.collect(), asked.schema["query_id"], n, probes, condition)
            found = near if found is None else found.unionByName(near)
        best = top(found, n)
        return (best.where(F.col("score") >= floor) if floor is not None else best).select("query_id", "rank", "id", "score", "pos")

    def _block(self, asked: list, kind: StructField, n: int, probes: int, condition: Column | None) -> DataFrame:
        spark = SparkSession.active()
        numbered = spark.createDataFrame([(i, q["query_id"]) for i, q in enumerate(asked)], StructType([StructField("q", IntegerType()), kind]))
        if not asked or self.vectors is None:
            empty = spark.createDataFrame([], "q int, id string, score double, pos long")
            return empty.join(numbered, "q").select("query_id", "id", "pos", "score")
        matrix = _unit(np.array([q["vector"] for q in asked]))
        near = np.argsort(-(matrix @ self.centroids.T), axis=1, kind="stable")[:, :probes]
        by_list: dict[int, list[int]] = {}
        for q, row in enumerate(near):
            for c in row:
                by_list.setdefault(int(c), []).append(q)
        shared = spark.sparkContext.broadcast((matrix, {c: np.array(q) for c, q in by_list.items()}))
        rows = self.vectors.where(F.col("list").isin(*sorted(by_list)))
        rows = rows.where(condition) if condition is not None else rows
        rows = rows.select(F.col("id").cast("string").alias("id"), F.col("pos").cast("long").alias("pos"), F.col("vector").cast("array<double>").alias("vector"), "list")
        schema = pa.schema([("q", pa.int32()), ("id", pa.string()), ("pos", pa.int64()), ("score", pa.float64())])

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, by_list = shared.value
            for batch in stream:
                if not batch.num_rows:
                    continue
                unit = _unit(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                own = batch.column("list").to_numpy()
                for c in np.unique(own):
                    at, q = np.flatnonzero(own == c), by_list[int(c)]
                    score = np.round(matrix[q] @ unit[at].T, DIGITS)
                    least = np.partition(score, -n, axis=1)[:, -n, None] if len(at) > n else score.min(1, keepdims=True)
                    i, j = np.nonzero(score >= least)
                    ids = [pc.take(batch.column(x), pa.array(at[j])) for x in ("id", "pos")]
                    yield pa.RecordBatch.from_arrays([pa.array(q[i].astype(np.int32)), *ids, pa.array(score[i, j])], schema=schema)

        near = map_batches(rows, run, "q int, id string, pos long, score double")
        return near.join(F.broadcast(numbered), "q").drop("q")


def open_vectors(spark: SparkSession, path: str) -> VectorIndex:
    """A stored index."""
    about = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    rows = spark.read.parquet(f"{path}/lists") if about[0].known else None
    return VectorIndex(rows, np.array([r.centroid for r in about]), about[0].probes)
