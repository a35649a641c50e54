"""Quality: nearest-neighbour voting over latent-semantic vectors of labelled documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.llm._shared import Scratch, batches, held_out, small_slices
from clausewise.session import map_batches

#: Columns of a text's terms: marks of the whole text, then hashed word shapes and pairs of shapes, then hashed words.
_MARKS, _SHAPES, _WORDS = 64, 2048, 4096
TERMS = _WORDS
_KINDS = dict.fromkeys(range(97, 123), "l") | dict.fromkeys(range(65, 91), "u") | dict.fromkeys(range(48, 58), "d")
_OTHER_LETTERS, _RUN = re.compile(r"[^\W\d_a-zA-Z]"), re.compile(r"(.)\1+", re.DOTALL)
_EDGES = ".,;:!?\"'()[]"


def _shape(word: str) -> str:
    """A word's shape: stretches of ASCII capitals as ``u`` (``U`` for two and more), of other letters as ``l``, of digits as ``d``, of one mark as that mark."""
    kinds = (word if word.isascii() else _OTHER_LETTERS.sub("l", word)).translate(_KINDS)
    return _RUN.sub(lambda m: "U" if m[1] == "u" else m[1], kinds)


class _Codes(dict):
    """A number for each word: 24 bits of its shape's hash, 7 of its length, 32 of its lower-case form's hash."""

    def __missing__(self, word: str) -> int:
        folded = xxhash.xxh32_intdigest(word.lower().strip(_EDGES))
        code = self[word] = xxhash.xxh32_intdigest(_shape(word)) & 0xFFFFFF | min(len(word), 127) << 24 | folded << 31
        return code


class Terms:
    """Term counts of whole texts: words, word shapes, pairs of shapes, word lengths, and repetition nearby.

    Codes come from a cache of words, so most words cost a lookup.
    """

    def __init__(self, most: int = 150_000):
        self.most, self.codes = most, _Codes()

    def count(self, text: str | None) -> np.ndarray:
        """Counts by column, log-damped and normalised by length; all zero for a text without words."""
        words = (text or "").split()
        n = len(words)
        if not n:
            return np.zeros(TERMS)
        if len(self.codes) > self.most:
            self.codes.clear()
        code = np.fromiter(map(self.codes.__getitem__, words), np.int64, n)
        shape, size, word = code & 0xFFFFFF, code >> 24 & 127, code >> 31
        room = _SHAPES - _MARKS
        places = [_MARKS + shape % room, _MARKS + (shape[:-1] * 31 + shape[1:] + 7) % room, np.minimum(size, 23), _SHAPES + word % (_WORDS - _SHAPES)]
        out = np.bincount(np.concatenate(places), minlength=TERMS).astype(float)
        # repetition: the share of words that are not new, and words that stand twice in a row
        times = np.unique(word, return_counts=True)[1]
        out[24] = (n - len(times)) * 2
        out[25] = (word[1:] == word[:-1]).sum() * 4.0
        out[26] = (times >= 3).sum()
        out[27] = times.max()
        out[28] = text.count("\n")
        return np.log1p(out * (1000.0 / n))


@dataclass
class Neighbours:
    """A fitted classifier: weights of terms, the latent axes, and labelled vectors (all of bounded size)."""

    idf: np.ndarray
    centre: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    k: int = 15
    power: float = 8.0

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = (counts * self.idf - self.centre) @ self.axes
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def vote(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """Similarity-weighted share of label 1 among the ``k`` nearest labelled vectors, exactly, in blocks.

        Cosines count to five decimals, and all vectors that tie with the ``k``-th vote,
        so equal texts get equal scores whatever block they are in.
        """
        out = np.empty(len(x))
        k = min(self.k, len(self.labels))
        for start in range(0, len(x), block):
            cosine = np.round(x[start : start + block] @ self.vectors.T, 5)
            least = np.partition(cosine, -k, axis=1)[:, -k, None]
            row, near = np.nonzero(cosine >= least)
            weight = np.clip(cosine[row, near].astype(float), 0, 1) ** self.power + 1e-9
            n = len(cosine)
            out[start : start + n] = np.bincount(row, weight * self.labels[near], n) / np.bincount(row, weight, n)
        return out


def _axes(x: np.ndarray, dims: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(3).standard_normal((x.shape[1], min(dims + 24, *x.shape)))
    for _ in range(8):
        basis, _ = np.linalg.qr((x.T @ (x @ basis.astype(x.dtype))).astype(float))
    _, _, vt = np.linalg.svd((x @ basis.astype(x.dtype)).astype(float), full_matrices=False)
    return (basis @ vt.T)[:, :dims]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most: int = 1500,
    dims: int = 48,
) -> Neighbours | None:
    """Labelled vectors from rows outside the held-out fold.

    At most ``most`` rows of either label are used, those with the
    smallest hashes of their ids; their counts (not their texts) reach the driver,
    which computes the axes by a truncated singular value decomposition.  Of several
    rows of one id the smallest text counts, so the sample is bounded by rows,
    too; an id with both labels counts once for each.  With no labelled rows there is
    no model and ``score`` gives 0.5.
    """
    spark = docs.sparkSession
    known = labels.where(~held_out(id) & F.col(id).isNotNull()).selectExpr(f"`{id}` AS doc_id", f"CAST(`{label}` AS int) AS y").where("y IN (0, 1)")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not sizes:
        return None
    rank = F.xxhash64("doc_id", F.lit("quality"))
    of = lambda y: known.where(F.col("y") == y).dropDuplicates(["doc_id"]).orderBy(rank, "doc_id").limit(most)
    # at most two times ``most`` ids and labels, so that the texts stay where they are
    chosen = F.broadcast(of(1).unionByName(of(0)))
    make = batches({"y": pa.int32(), "at": pa.binary(), "x": pa.binary()})

    def counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _terms()
        for batch in small_slices(stream, "text"):
            at, x = [], []
            for t in batch.column("text").to_pylist():
                c = terms.count(t)
                some = np.flatnonzero(c)
                at.append(some.astype("<u2").tobytes())
                x.append(c[some].astype("<f4").tobytes())
            yield make({"y": batch.column("y").to_pylist(), "at": at, "x": x})

    sample = docs.selectExpr(f"`{id}` AS doc_id", f"`{text}` AS text").join(chosen, "doc_id")
    sample = sample.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")
    rows = Scratch(spark, "quality").keep(map_batches(sample, counts, "y int, at binary, x binary")).collect()
    if not rows:
        return None
    # one table of at most two times ``most`` rows, worked on in place
    x = np.zeros((len(rows), TERMS), np.float32)
    for row, r in zip(x, rows, strict=True):
        row[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], "<f4")
    y = np.array([r["y"] for r in rows], dtype=float)
    del rows
    order = np.lexsort((y, *x.T[:32]))
    x, y = x[order], y[order]
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 0.3
    x *= idf.astype(np.float32)
    centre = x.mean(0, dtype=float)
    x -= centre.astype(np.float32)
    axes = _axes(x, dims)
    vectors = x @ axes.astype(np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Neighbours(idf, centre, axes, vectors, y, float(y.mean()))


_cache: list[Terms] = []


def _terms() -> Terms:
    if not _cache:
        _cache.append(Terms())
    return _cache[0]


def score(docs: DataFrame, model: Neighbours | None, *, id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Quality of every whole text: ``doc_id, score`` from 0 to 1, higher for label 1.

    The model (at most a few thousand short vectors, by ``fit``'s bounds) is
    broadcast.  A text without words, null included, has no terms; its neighbours
    vote like any other's.  A text of any length is counted whole, one at a time.
    Ids are passed on as they are, repeated rows are scored once each, other columns
    are ignored, whatever their names; an empty table gives an empty table.
    With ``carry`` the result is one column ``row`` that holds the whole input row,
    and ``score``; texts then cross to Python once, inside it.
    """
    if carry:
        source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    else:
        source = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    passed = "row" if carry else "doc_id"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([source.schema[passed]]).add("score", "double")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, fitted = _terms(), shared.value
        for batch in small_slices(stream, f"row.{text}" if carry else "text"):
            texts = (pc.struct_field(batch.column("row"), text) if carry else batch.column("text")).to_pylist()
            found = [np.full(len(texts), 0.5)]
            if fitted is not None:
                parts = [texts[i : i + 128] for i in range(0, len(texts), 128)]
                found = [fitted.embed(np.stack([terms.count(t) for t in part])) for part in parts]
                found = [fitted.vote(np.concatenate(found))] if found else []
            columns = [batch.column(passed), pa.array(np.concatenate([*found, np.zeros(0)]))]
            yield pa.RecordBatch.from_arrays(columns, names=[passed, "score"])

    return map_batches(source, run, schema)
