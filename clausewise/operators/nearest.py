"""The nearest vectors of every vector of a table: all pairs, exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.session import map_batches

#: Questions and rows of one product; components of questions that a task holds; questions that are worth a task, and tasks a core.
BLOCK, HELD, LEAST, SHARE = 512, 1 << 22, 512, 2
#: Components of pairs whose exact score is made at once.
CELLS = 1 << 20
#: Keys that sort as the scores: a pair of which one vector has no direction (NaN) is before, one without a cosine (null) behind all others.
NAN, NONE = 2.0, -2.0
SCALE = 1e6


class _Rows:
    """Vectors of a batch: as they are, as single-precision units, and which are none or have no direction."""

    def __init__(self, column: pa.Array, dims: int):
        known = column.is_valid().to_numpy(zero_copy_only=False)
        self.raw = np.zeros((len(column), dims))
        self.raw[known] = column.flatten().to_numpy(zero_copy_only=False).reshape(known.sum(), dims)
        with np.errstate(all="ignore"):
            self.square = np.einsum("ij,ij->i", self.raw, self.raw)
            sound = known & np.isfinite(self.square) & (self.square > 0)
            self.unit = np.where(sound[:, None], self.raw / np.sqrt(self.square)[:, None], 0).astype(np.float32)
        self.none, self.nan = np.flatnonzero(~known), np.flatnonzero(known & ~sound)


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero."""
    y = x * SCALE
    whole = np.trunc(y)
    return (whole + np.where(np.abs(y - whole) >= 0.5, np.sign(y), 0)) / SCALE


def _places(found: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mask with few hits, eight places at a time."""
    flat = found.reshape(-1)
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    at = np.concatenate([(eights[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(flat))])
    return at[flat[at]]


class _Block:
    """The best ``n`` rows of a few questions among all that come by, in order of ``pos``: of equals the first stay.

    A product in single precision leaves out what can't be among them, by more than its
    error; exact scores are made of the rest.
    """

    def __init__(self, asked: _Rows, n: int):
        self.asked, self.n, (self.size, dims) = asked, n, asked.raw.shape
        self.error, self.pairs = (dims + 8) * 1.2e-7, max(1, CELLS // max(1, dims))
        self.full, self.held = False, 0
        self.least = np.full(self.size, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self._limit()

    def _limit(self) -> None:
        """What a product has to exceed; no cosine is over 1."""
        at = self.least
        limit = np.where(at >= 1, np.maximum(at, 1.5), np.where(at == NONE, -1.5, at - self.error))
        self.limit = limit.astype(np.float32)[:, None]

    def meet(self, rows: _Rows, pos: np.ndarray, first: int) -> None:
        """``first``: how many rows came before these."""
        asked = self.asked
        near = asked.unit @ rows.unit.T
        near[asked.nan] = NAN
        near[:, rows.nan] = NAN
        near[asked.none] = NONE
        near[:, rows.none] = NONE
        limit = self.limit
        if not self.full and near.shape[1] > self.n:
            limit = np.maximum(limit, np.partition(near, -self.n, axis=1)[:, -self.n, None] - np.float32(2 * self.error + 2 / SCALE))
        found = _places(near > limit)
        for start in range(0, len(found), self.pairs):
            q, r = np.divmod(found[start : start + self.pairs], near.shape[1])
            key = near[q, r].astype(float)
            real = np.flatnonzero(np.abs(key) < 1.5)
            a, b = q[real], r[real]
            dot = np.einsum("ij,ij->i", asked.raw[a], rows.raw[b])
            key[real] = _rounded(np.clip(dot / np.sqrt(asked.square[a] * rows.square[b]), -1, 1))
            better = np.flatnonzero(key > self.least[q])
            if len(better):
                q, r = q[better], r[better]
                self.parts.append((q, key[better], r + first, pos[r]))
                self.held += len(q)
            if self.held > self.size * self.n:
                self.cut()
        if not self.full:
            self.cut()

    def cut(self) -> None:
        if not self.parts:
            return
        q, key, at, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((-key, q))  # stable, and rows came in order
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept, order = place < self.n, order[place < self.n]
        q, place = q[kept], place[kept]
        key, at, pos = key[order], at[order], pos[order]
        self.parts, self.held = [(q, key, at, pos)], 0
        last = place == self.n - 1
        self.least[q[last]] = key[last]
        self.full = bool(last.sum() == self.size)
        self._limit()


def _lists(blocks: list[_Block], ids: pa.Array, n: int, nulls_from: int) -> Iterator[pa.RecordBatch]:
    """Ranked lists by id; questions of one id, which stand together, share a list.  Rows from ``nulls_from`` have a null ``pos``."""
    of, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (null[1:] != null[:-1])])
    group = np.cumsum(new) - 1
    # a block's lists with the ones of the next, if an id is in both
    waiting: list[tuple[np.ndarray, ...]] = []
    end = 0
    for block in blocks:
        block.cut()
        start, end = end, end + block.size
        waiting += [(group[start + q], key, at, pos) for q, key, at, pos in block.parts]
        if not waiting or end < len(group) and not new[end]:
            continue
        g, key, at, pos = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting = []
        order = np.lexsort((at, -key, g))
        g = g[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g) + 1
        g, order, rank = g[rank <= n], order[rank <= n], rank[rank <= n]
        key, at, pos, one = key[order], at[order], pos[order], np.flatnonzero(new)[g]
        score = pa.array(np.where(key == NAN, np.nan, key), mask=key == NONE, from_pandas=False)
        columns = [pa.array(of[one], mask=null[one]), pa.array(pos, mask=at >= nulls_from), pa.array(rank.astype(np.int32)), score]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "pos", "rank", "score"])


def nearest_of_each(vectors: DataFrame, n: int) -> DataFrame:
    """(query_id, pos, rank, score): of every row's vector, the ``n`` of the greatest cosine, ties by ``pos``; itself is one.

    ``vectors`` has pos (a long, the question's id too) and vector.  As in SQL, a vector
    without a direction (zero, or with a NaN or an infinity) scores NaN, which comes
    first, and one that is null or empty scores null, which comes last.  One
    with a null in it, or of another length than the longest, counts as null.
    Questions are dealt by id to tasks, every row goes to each of them in
    order of ``pos``: a task keeps its questions' lists only, and nothing comes to the
    driver.  The work is the square of the number of rows.
    """
    spark = vectors.sparkSession
    known, dims = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    dims = max(0, dims or 0)
    tasks = max(1, min(SHARE * spark.sparkContext.defaultParallelism, known // LEAST), -(-known * dims // HELD))
    sound = (F.size("vector") == dims) & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull())
    rows = vectors.select(F.col("pos").cast("long").alias("pos"), F.when(sound, F.col("vector")).alias("vector"))
    # once as a question, and once for each task
    dealt = rows.select("*", F.explode(F.sequence(F.lit(-1), F.lit(tasks - 1))).alias("task")).select(
        (F.col("task") >= 0).alias("met"), "pos", "vector", F.when(F.col("task") < 0, F.pmod(F.xxhash64("pos"), F.lit(tasks)).cast("int")).otherwise(F.col("task")).alias("task")
    )
    spread = dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions("met", F.col("pos").asc_nulls_last()).select("met", "pos", "vector")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[pa.RecordBatch] = []
        blocks: list[_Block] | None = None
        seen = nulls_from = 0
        for batch in stream:
            questions = batch.num_rows - (pc.sum(batch.column("met")).as_py() or 0)
            if questions:
                asked.append(batch.slice(0, questions))
            if not asked and blocks is None:
                return
            if questions < batch.num_rows and blocks is None:
                ids, own = (pa.concat_arrays([x.column(c) for x in asked]) for c in ("pos", "vector"))
                blocks = [_Block(_Rows(own.slice(k, BLOCK), dims), n) for k in range(0, len(own), BLOCK)]
                asked.clear()
            for start in range(questions, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                met, pos = _Rows(part.column("vector"), dims), part.column("pos")
                for block in blocks:
                    block.meet(met, pos.fill_null(0).to_numpy(zero_copy_only=False), seen)
                seen, nulls_from = seen + part.num_rows, nulls_from + part.num_rows - pos.null_count
        if blocks:
            yield from _lists(blocks, ids, n, nulls_from)

    return map_batches(spread, run, "query_id long, pos long, rank int, score double")
