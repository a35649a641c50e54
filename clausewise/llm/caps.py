"""Embedding near-duplicates by spherical-cap filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm._shared import Scratch, batches, components
from clausewise.session import map_batches

#: Vectors of one filter that meet in one block.
BLOCK = 256
#: Filters of a vector at the least.
LEAST = 24


class Filters:
    """Structured random product codes on the sphere.

    A vector is rotated by signs and a Hadamard transform (twice) and split into
    two halves; each half has its own random codebook of ``codes`` unit vectors.
    A filter is a pair of codewords, its direction their concatenation over the
    square root of two.  ``decode`` lists every filter whose cap holds a vector:
    those with an inner product of ``level`` at least, and the ``LEAST`` best ones in
    any case, as the number varies much between directions.
    """

    def __init__(self, dims: int, codes: int, share: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dims, self.codes = dims, codes
        self.size = max(4, 1 << (dims - 1).bit_length())
        self.signs = rng.choice([-1.0, 1.0], (2, self.size))
        half = self.size // 2
        books = rng.standard_normal((2, codes, half))
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True) / np.sqrt(2)
        # the level that this share of all filters exceeds for a random direction
        probe = rng.standard_normal((400, self.size))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        pick = rng.integers(0, codes, (2, 20000))
        sums = np.concatenate([self._halves(probe)[0][:, pick[0]] + self._halves(probe)[1][:, pick[1]]])
        self.level = float(np.quantile(sums, 1 - share))

    def _halves(self, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.size // 2
        return rotated[:, :half] @ self.books[0].T, rotated[:, half:] @ self.books[1].T

    def rotate(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : self.dims] = x
        for signs in self.signs:
            y = y * signs
            step = 1
            while step < self.size:
                y = y.reshape(len(x), -1, 2, step)
                y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2)
                step *= 2
            y = y.reshape(len(x), self.size) / np.sqrt(self.size)
        return y

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each unit vector; only sums that can reach the level are formed."""
        left, right = self._halves(self.rotate(x))
        out = []
        for a, b in zip(left, right, strict=True):
            i, j = np.flatnonzero(a >= self.level - b.max()), np.flatnonzero(b >= self.level - a.max())
            u, v = np.nonzero(a[i][:, None] + b[j][None, :] >= self.level)
            if len(u) < LEAST:
                i, j = np.argsort(-a)[:LEAST], np.argsort(-b)[:LEAST]
                sums = a[i][:, None] + b[j][None, :]
                u, v = np.unravel_index(np.argsort(-sums, axis=None, kind="stable")[:LEAST], sums.shape)
            out.append(np.sort(i[u].astype(np.int64) * self.codes + j[v]))
        return out


def _first_common(p: np.ndarray, q: np.ndarray) -> int:
    both = np.intersect1d(p, q, assume_unique=True)
    return int(both[0]) if len(both) else -1


def near_vectors(
    vectors: DataFrame,
    *,
    threshold: float = 0.98,
    per_vector: int = 64,
    crowd: float = 0.5,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Links between vectors of one label with a cosine of ``threshold`` at least, and their components.

    Equal vectors of one label form one group first, so copies are never compared.
    Each group's vector goes to every spherical-cap filter that holds it,
    ``per_vector`` on average; the number of filters grows with the largest label so
    that about ``crowd`` unrelated vectors share one (a task then holds two codebooks
    of the root of that number: 100 MB for a label of a thousand million vectors).  Groups that share a filter are
    compared exactly in double precision; a pair counts under its first common
    filter only.  A filter with many vectors is cut into blocks, and pairs of blocks
    are compared in tasks of bounded size, so no filter is gathered anywhere.

    Returns one row per row of ``vectors``: ``vec_id, n_links`` (other vectors that
    are linked directly), ``component_id`` (the smallest id that links reach) and
    ``kept``.  Vectors that are null, empty, zero or hold null or non-finite numbers,
    and vectors without a label, link with nothing.  Vectors of different lengths
    don't link.  Repeated rows link with each other; rows with a null id count as
    partners and stay alone.  Other columns are ignored; an empty table gives an
    empty table.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "caps")
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = (
        F.col("v").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    # -0.0 and 0.0 are the same number
    rows = rows.select("vec_id", "label", F.when(sound, F.transform("v", lambda x: x + 0.0)).alias("v"))
    groups = scratch.keep(
        rows.where("v IS NOT NULL")
        .groupBy("label", "v")
        .agg(F.count("*").alias("rows"), F.min("vec_id").alias("least"))
        .withColumn("g", F.xxhash64("label", "v", F.coalesce("least", F.lit(0))))
    )
    sizes = groups.groupBy("label", F.size("v").alias("d")).count().groupBy("d").agg(F.max("count").alias("n")).collect()
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    plans = {}
    for r in sizes:
        share = min(0.25, crowd / max(r["n"], 1))
        codes = max(16, int(np.ceil(np.sqrt(per_vector / share))))
        plans[r["d"]] = (codes, per_vector / codes**2)
    find = batches({"g": pa.int64(), "filters": pa.list_(pa.int64())})

    def decode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, Filters] = {}
        for batch in stream:
            ids = batch.column("g").to_pylist()
            lists = batch.column("v").to_pylist()
            filters: list = [None] * len(lists)
            for d in {len(v) for v in lists}:
                own = [i for i, v in enumerate(lists) if len(v) == d]
                if d not in ready:
                    ready[d] = Filters(d, *plans[d])
                x = np.array([lists[i] for i in own])
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for start in range(0, len(own), 512):
                    for i, f in zip(own[start : start + 512], ready[d].decode(x[start : start + 512]), strict=True):
                        filters[i] = f
            yield find({"g": ids, "filters": filters})

    decoded = scratch.keep(map_batches(groups.select("g", "v"), decode, "g long, filters array<long>"))
    where = groups.select("g", "label", F.size("v").alias("d"), "rows", "least", "v")
    spots = decoded.join(where.select("g", "label", "d"), "g").select("g", "label", "d", F.explode("filters").alias("f"))
    key = ["label", "d", "f"]
    busy = spots.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    # block numbers come from the group's hash; a pair of blocks i <= j is one piece of work
    held = spots.join(busy, key).withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int"))
    held = held.withColumn("i", F.pmod(F.xxhash64("g", F.lit("block")), F.col("k").cast("long")).cast("int"))
    work = held.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "g",
        "f",
        F.xxhash64("label", "d", "f", F.least("i", "j"), F.greatest("i", "j")).alias("work"),
        "i",
        "j",
    )
    loaded = work.join(decoded, "g").join(where.select("g", "rows", "least", "v"), "g")
    spread = loaded.repartition("work").sortWithinPartitions("work", "i", "g")
    emit = batches({"g": pa.int64(), "root": pa.int64(), "links": pa.int64()})

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each group, and one linked group of lower number for the components."""

        def settle(p: dict[str, list]) -> tuple[list, list, list]:
            # one piece: block i against block j, or a block against itself
            g, f = np.array(p["g"]), p["f"][0]
            if len(g) < 2:
                return [], [], []
            x = np.array(p["v"])
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            hit = np.triu(x @ x.T >= threshold, 1)
            block = np.array(p["i"])
            if (np.array(p["i"]) != np.array(p["j"])).any():
                hit &= block[:, None] != block[None, :]
            a, b = np.nonzero(hit)
            own = [k for k in range(len(a)) if _first_common(p["filters"][a[k]], p["filters"][b[k]]) == f]
            a, b = a[own], b[own]
            if not len(a):
                return [], [], []
            rows = np.array(p["rows"])
            links = np.bincount(a, rows[b], len(g)) + np.bincount(b, rows[a], len(g))
            root = np.arange(len(g))
            for u, v in zip(a, b, strict=True):
                while root[u] != u:
                    u = root[u]
                while root[v] != v:
                    v = root[v]
                root[max(u, v)] = min(u, v)
            for k in range(len(g)):
                root[k] = root[root[k]]
            some = np.flatnonzero(links)
            return g[some].tolist(), g[root[some]].tolist(), links[some].astype(int).tolist()

        names = ("work", "g", "f", "i", "j", "rows", "filters", "v")
        piece: dict[str, list] = {n: [] for n in names}
        for batch in stream:
            columns = {n: batch.column(n).to_pylist() for n in names if n not in ("filters", "v")}
            columns["filters"] = [np.asarray(x.values) for x in batch.column("filters")]
            columns["v"] = [np.asarray(x.values) for x in batch.column("v")]
            edges = [0, *[k for k in range(1, batch.num_rows) if columns["work"][k] != columns["work"][k - 1]], batch.num_rows]
            found: tuple[list, list, list] = ([], [], [])
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if piece["work"] and s < e and columns["work"][s] != piece["work"][0]:
                    for all_, new in zip(found, settle(piece), strict=True):
                        all_ += new
                    piece = {n: [] for n in names}
                for n in names:
                    piece[n] += columns[n][s:e]
            yield emit(dict(zip(("g", "root", "links"), found, strict=True)))
        if piece["work"]:
            yield emit(dict(zip(("g", "root", "links"), settle(piece), strict=True)))

    kinds = "g long, root long, links long"
    found = scratch.keep(map_batches(spread.select("work", "g", "f", "i", "j", "rows", "filters", "v"), compare, kinds))
    joined = components(found.select(F.col("g").alias("a"), F.col("root").alias("b")), scratch)
    total = groups.select("g", "label", "v", "rows", "least").join(found.groupBy("g").agg(F.sum("links").alias("links")), "g", "left")
    total = total.join(joined.withColumnRenamed("node", "g"), "g", "left").withColumn("c", F.coalesce("component", "g"))
    lowest = total.groupBy("c").agg(F.min("least").alias("component_id"))
    named = scratch.keep(
        total.join(lowest, "c").select(
            "label", "v", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id"
        )
    )
    return (
        rows.join(named, ["label", "v"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
