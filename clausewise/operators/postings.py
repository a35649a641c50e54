"""A stored lexical index in blocks with a maximum weight each, so that a search skips blocks that can't matter."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StructField, StructType

from clausewise.functions.text import tokenize
from clausewise.operators import rank
from clausewise.operators.rank import CELLS, DIGITS, K1, LEXICAL_FLOOR, B, Best, allowed, corpus_stats, document_lengths, query_terms, top
from clausewise.operators.rank import postings  # noqa: F401 - the same postings as rows, to compare with
from clausewise.session import keep, map_batches, scratch_dir

#: Texts of a slot at the most; it has no more than ``CELLS`` tokens either, unless its one text has.
SPAN = 1024
#: What rounding of scores and sums in another order can change.
SLACK = 2.0 * 10**-DIGITS

GROUP = ("regulation", "doc_type")
BLOCK = "term string, regulation string, doc_type string, slot long, most double, n long, at array<short>, tf array<int>, pos array<long>, dl array<int>, ids array<string>"
ARROW = pa.schema(
    [(c, pa.string()) for c in ("term", *GROUP)]
    + [("slot", pa.int64()), ("most", pa.float64()), ("n", pa.int64()), ("at", pa.list_(pa.int16())), ("tf", pa.list_(pa.int32())), ("pos", pa.list_(pa.int64())), ("dl", pa.list_(pa.int32())), ("ids", pa.list_(pa.string()))]
)


def save(chunks: DataFrame, path: str) -> None:
    """Stores the index of ``chunks`` (id, pos, text, regulation, doc_type) at ``path``.

    A slot is up to ``SPAN`` texts of one group (regulation and type, which searches
    filter by) that a task reads at once.  A block holds the postings of one term in one
    slot: the texts' numbers there (``at``) and how often they have it (``tf``).  ``most`` is
    the greatest weight, a posting's share of the score without the term's idf; weights
    follow from ``tf`` and the texts' lengths and are not stored.  A row without a term
    lists a slot's texts with their lengths.  So blocks are made where texts are read, no
    posting moves, and no task or key holds all of a common word.
    """
    spark = chunks.sparkSession
    corpus_stats(document_lengths(chunks)).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    blocks(chunks, stats.first()["avgdl"]).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
    counts = spark.read.parquet(f"{path}/blocks").where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    rank.weighted(counts, stats).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/terms")


def blocks(chunks: DataFrame, average: float | None) -> DataFrame:
    """The blocks of ``chunks``, made within the tasks that read them."""
    rows = chunks.select(F.col("id").cast("string").alias("id"), F.col("pos").cast("long").alias("pos"), *GROUP, tokenize(F.col("text")).alias("tokens"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() << 32
        for batch in stream:
            regulation, kind = (batch.column(c).dictionary_encode("encode") for c in GROUP)
            group = regulation.indices.to_numpy().astype(np.int64) * len(kind.dictionary) + kind.indices.to_numpy()
            order = np.argsort(group, kind="stable")
            read = np.append(0, np.cumsum(_lengths(batch.column("tokens"))[order]))
            ends = [*(np.flatnonzero(np.diff(group[order])) + 1), len(order)] if len(order) else []
            start = 0
            for last in ends:
                while start < last:
                    end = int(np.searchsorted(read, read[start] + CELLS, side="right")) - 1
                    end = min(max(end, start + 1), start + SPAN, last)
                    yield from _slot(batch.take(pa.array(order[start:end])), slot, average)
                    slot, start = slot + 1, end

    return map_batches(rows, run, BLOCK)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _slot(part: pa.RecordBatch, slot: int, average: float | None) -> Iterator[pa.RecordBatch]:
    """The row that lists a slot's texts, and its blocks by term."""
    rows, tokens = part.num_rows, part.column("tokens")
    length, coded = _lengths(tokens), tokens.flatten().dictionary_encode()
    texts = {"pos": part.column("pos").to_pylist(), "dl": length, "ids": part.column("id").to_pylist()}
    yield _batch({"slot": [slot], "n": [0]} | {c: pa.array([x], ARROW.field(c).type) for c, x in texts.items()}, 1)
    if not len(coded):
        return
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = np.repeat(np.arange(rows), length)
    key, tf = np.unique(place[coded.indices.to_numpy()] * rows + row, return_counts=True)
    term, at = np.divmod(key, rows)
    weight = _weight(tf, length[at], average)
    start = np.flatnonzero(np.diff(term, prepend=-1))
    ends = pa.array(np.append(start, len(term)).astype(np.int32))
    group = {c: part.column(c).take(pa.array(np.zeros(len(start), np.int64))) for c in GROUP}
    found = group | {
        "term": pc.take(coded.dictionary, pa.array(order[term[start]])),
        "slot": np.full(len(start), slot),
        "most": np.maximum.reduceat(weight, start),
        "n": np.diff(np.append(start, len(term))),
        "at": pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int16))),
        "tf": pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32))),
    }
    yield _batch(found, len(start))


def _weight(tf: np.ndarray, dl: np.ndarray, average: float) -> np.ndarray:
    """Postings' shares of a score without their terms' idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _batch(columns: dict, rows: int) -> pa.RecordBatch:
    made = [columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in ARROW]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, ARROW, strict=True)], schema=ARROW)


@dataclass(frozen=True)
class BlockIndex:
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame

    def wanted(self, queries: DataFrame, n: int, condition: Column) -> DataFrame:
        """(query_id, term, factor, essential, gate) of the questions' terms.

        ``factor`` times a weight is a posting's share of the score, ``top`` the largest
        share among allowed postings and ``others`` the sum of the other terms' largest.
        ``least`` is a score that ``n`` allowed rows reach: the n-th best weight of the
        question's best term among its blocks' greatest ones, which are weights of as many
        texts, less what terms of negative idf may take away.  Terms are essential from
        where, taken in rising order of ``top``, their sum reaches ``least``: a row with
        none of these can't.  Of an essential term only blocks whose greatest weight
        reaches ``gate`` can hold a row that does.
        """
        asked = query_terms(queries)
        terms = self.terms.join(F.broadcast(asked), "term").select("query_id", "term", (F.col("idf") * F.col("n_q")).alias("factor"))
        here = self.blocks.where(condition).join(F.broadcast(asked.select("term").distinct()), "term").select("term", "most")
        here = here.withColumn("at", F.row_number().over(W.partitionBy("term").orderBy(F.desc("most")))).where(F.col("at") <= n)
        here = here.groupBy("term").agg(F.max("most").alias("first"), F.max(F.when(F.col("at") == n, F.col("most"))).alias("nth"))
        rows = terms.join(here, "term").select(
            "query_id",
            "term",
            "factor",
            F.greatest(F.lit(0.0), F.col("factor") * F.col("first")).alias("top"),
            F.least(F.lit(0.0), F.col("factor") * F.col("first")).alias("worst"),
            F.when(F.col("factor") > 0, F.col("factor") * F.col("nth")).alias("nth"),
        )
        whole = W.partitionBy("query_id")
        rising = whole.orderBy("top", "term").rowsBetween(W.unboundedPreceding, 0)
        others, least = F.col("others"), F.col("least")
        return rows.select(
            "query_id",
            "term",
            "factor",
            (F.sum("top").over(whole) - F.col("top")).alias("others"),
            F.greatest(F.coalesce(F.max("nth").over(whole) + F.sum("worst").over(whole), F.lit(0.0)), F.lit(0.0)).alias("least"),
            F.sum("top").over(rising).alias("reach"),
        ).select(
            "query_id",
            "term",
            "factor",
            (F.col("reach") >= least - SLACK).alias("essential"),
            F.when(F.col("factor") > 0, (least - SLACK - others) / F.col("factor")).otherwise(float("-inf")).alias("gate"),
        )

    def candidates(self, wanted: DataFrame, condition: Column) -> DataFrame:
        """(query_id, id, pos, score): rows of those blocks of essential terms that reach their gate, with their whole score."""
        return self._scored(wanted, condition, None)

    def _scored(self, wanted: DataFrame, condition: Column, n: int | None) -> DataFrame:
        """The candidates, or of each task's ones every question's best ``n`` of positive score.

        Slots without a candidate's block are left out.  Of the others the blocks of
        all wanted terms come together by slot, so a text's score is known in one task.
        """
        spark, kind, asked = self.blocks.sparkSession, wanted.schema["query_id"], wanted.collect()
        who = {q: i for i, q in enumerate(dict.fromkeys(r["query_id"] for r in asked))}
        number = {t: i for i, t in enumerate(sorted({r["term"] for r in asked}))}
        pairs = sorted((number[r["term"]], who[r["query_id"]], r["factor"], r["gate"] if r["essential"] else np.inf) for r in asked)
        gates: dict[int, float] = {}
        for t, _, _, gate in pairs:
            gates[t] = min(gate, gates.get(t, np.inf))
        numbered = F.broadcast(spark.createDataFrame([(t, i, gates[i]) for t, i in number.items()], "term string, t int, gate double"))
        opened = self.blocks.where(condition).join(numbered, "term").where("most >= gate").select("slot").distinct()
        rows = self.blocks.join(numbered, "term", "left").where(F.col("term").isNull() | (F.col("t").isNotNull() & condition))
        # one number per slot
        rows = rows.join(F.broadcast(opened), "slot", "left_semi")
        # lists that nearly all rows lack cost as much on the way to Python as those that they have
        texts = F.when(F.col("term").isNull(), F.to_json(F.struct("pos", "dl", "ids"))).alias("texts")
        rows = rows.select("slot", "t", "most", "at", "tf", texts).repartition("slot").sortWithinPartitions("slot", "t")
        average = self.stats.first()["avgdl"]
        found = map_batches(rows, _scorer(spark, pairs, len(number), len(who), n, average), "q int, id string, pos long, score double")
        schema = StructType([StructField("q", IntegerType()), kind])
        return found.join(F.broadcast(spark.createDataFrame([(i, q) for q, i in who.items()], schema)), "q").select("query_id", "id", "pos", "score")

    def search(
        self,
        queries: DataFrame,
        n: int,
        *,
        regulations: Sequence[str] | str | None = None,
        doc_types: Sequence[str] | str | None = None,
        floor: float = LEXICAL_FLOOR,
    ) -> DataFrame:
        """(query_id, rank, id, score, pos): the same rows as ``rank.bm25``.

        Rows come from blocks of essential terms whose greatest weight, with all that the
        other terms could add, reaches the bound; ``rank.QUESTIONS`` questions a pass.
        """
        condition = allowed(regulations, doc_types)
        scratch = scratch_dir(queries.sparkSession, "search")
        passes = max(1, -(-queries.count() // rank.QUESTIONS))
        found = []
        for k in range(passes):
            block = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k)
            found.append(self._scored(keep(self.wanted(block, n, condition), f"{scratch}/wanted-{k}"), condition, n))
        scored = reduce(DataFrame.unionByName, found)
        best = F.max("score").over(W.partitionBy("query_id"))
        kept = top(scored, n).withColumn("best", best).where(F.col("score") >= floor * F.col("best"))
        return kept.select("query_id", "rank", "id", "score", "pos")


def _scorer(spark: SparkSession, pairs: list[tuple[int, int, float, float]], terms: int, questions: int, n: int | None, average: float | None):
    """The function that scores slots in a task; ``pairs`` (term, question, factor, gate) are sorted by term."""
    term, who, factor, gate = (np.array([p[i] for p in pairs], dtype=d) for i, d in enumerate((np.int64, np.int64, np.float64, np.float64)))
    shared = spark.sparkContext.broadcast((np.searchsorted(term, np.arange(terms + 1)), who, factor, gate))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None if n is None else Best(questions, n)
        for rows in _by_slot(stream):
            texts = json.loads(rows.column("texts")[0].as_py())
            pos, ids = pa.array(texts["pos"], pa.int64()), pa.array(texts["ids"], pa.string())
            score, hit = _scores(rows.slice(1), np.array(texts["dl"]), average, questions, *shared.value)
            if best is not None:
                best.add(np.where(hit & (score > 0), score, -np.inf), pos.to_numpy(), ids)
                continue
            q, at = np.nonzero(hit)
            yield _found(q, ids.take(pa.array(at)), pos.take(pa.array(at)), score[q, at])
        if best is not None:
            best.cut()
            for q, score, pos, ids in best.parts:
                yield _found(q, ids, pos, score)

    return run


def _found(q, ids, pos, score) -> pa.RecordBatch:
    made = (pa.array(np.asarray(q, np.int32)), ids, pos if isinstance(pos, pa.Array) else pa.array(pos), pa.array(score))
    return pa.RecordBatch.from_arrays(list(made), names=["q", "id", "pos", "score"])


def _by_slot(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each slot, the one that lists its texts first."""
    held: list[pa.RecordBatch] = []
    for batch in stream:
        slots = batch.column("slot").to_numpy()
        for start, end in pairwise([0, *(np.flatnonzero(np.diff(slots)) + 1), len(slots)]):
            if held and held[0].column("slot")[0].as_py() != slots[start]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _scores(
    rows: pa.Table, dl: np.ndarray, average: float | None, questions: int, first: np.ndarray, who: np.ndarray, factor: np.ndarray, gate: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Scores by question and text (of length ``dl``) of a slot, and which of them are in a block that reaches its gate."""
    texts = len(dl)
    score, hit = np.zeros(questions * texts), np.zeros(questions * texts, bool)
    if rows.num_rows:
        t, most = (rows.column(c).chunk(0).to_numpy() for c in ("t", "most"))
        at, tf = (rows.column(c).chunk(0).flatten().to_numpy() for c in ("at", "tf"))
        w = _weight(tf, dl[at], average)
        length = _lengths(rows.column("at").chunk(0))
        offset, times = np.cumsum(length) - length, first[t + 1] - first[t]
        cells = np.append(0, np.cumsum(times * length))
        start = 0
        while start < len(t):
            # each posting once for every question that has its term, a share of the blocks at a time
            end = max(start + 1, int(np.searchsorted(cells, cells[start] + CELLS, side="right")) - 1)
            row, pair = _spread(first[t[start:end]], times[start:end])
            row += start
            of, posting = _spread(offset[row], length[row])
            cell = who[pair][of] * texts + at[posting]
            score += np.bincount(cell, factor[pair][of] * w[posting], len(score))
            hit[cell[(most[row] >= gate[pair])[of]]] = True
            start = end
    return np.round(score, DIGITS).reshape(questions, texts), hit.reshape(questions, texts)


def _spread(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges from ``start``, ``length`` long: each element's range, and the element."""
    of = np.repeat(np.arange(len(length)), length)
    return of, np.arange(len(of)) + np.repeat(start - (np.cumsum(length) - length), length)


def open_blocks(spark: SparkSession, path: str) -> BlockIndex:
    """A stored index."""
    return BlockIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("blocks", "terms", "stats")))
