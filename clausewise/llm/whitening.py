"""Embedding whitening by a tiled covariance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm._shared import Scratch, batches, partition_id
from clausewise.session import map_batches

#: Dimensions of a column block; a tile is the pair of two.
WIDTH = 32
#: Bytes of one row-block of doubles, and of the tile sums that a task holds before it passes them on.
BLOCK_BYTES, HELD_BYTES = 4_000_000, 64_000_000
#: Scaled entries are exact in double precision up to here.
EXACT = 2**52
#: A direction whose share of the trace is below this has no variance but rounding.
NOTHING = 1e-13


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _slices(stream: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    most = max(1, BLOCK_BYTES // (8 * max(dims, 1)))
    for batch in stream:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def integers(vectors: DataFrame, scale: int = 1024, shift: int = 100_000, *, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """``(vec_id, x)`` with ``x = floor(scale * entry) + shift`` as longs, and the number of dimensions.

    Vectors that are null, empty or hold null or non-finite entries go, and so do
    entries whose scaled value a double can't hold exactly.  Vectors must have one
    length to have a covariance: those of the length that most rows have stay (of
    equally common lengths the larger one).
    """
    rows = vectors.select(F.col(id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < EXACT - shift))
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = common.dims if common else 0
    return rows.where(F.size("v") == dims).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + shift).alias("x")), dims


def sums(rows: DataFrame, dims: int, column: str = "x") -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension of ``column`` (array<long>): one row per task and dimension moves."""
    make = batches({"dim": pa.int32(), "n": pa.int64(), "high": pa.int64(), "low": pa.int64()})

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in _slices(stream, dims):
            x = _matrix(batch.column(0), batch.num_rows)
            n, high, low = n + len(x), high + (x >> 20).sum(0), low + (x & 0xFFFFF).sum(0)
        yield make({"dim": range(dims), "n": [n] * dims, "high": high, "low": low})

    each = map_batches(rows.select(column), run, "dim int, n long, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    found = sorted(each.groupBy("dim").agg(*wide).collect())
    return (int(found[0].n) if found else 0), [(int(r.high) << 20) + int(r.low) for r in found]


def covariance(rows: DataFrame, column: str, dims: int, n: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The covariance (divisor ``n``) of the rows' vectors, centred before they are multiplied.

    Rows are cut into row-blocks and dimensions into column blocks.  The shuffle by
    row-block brings the column blocks of one row-block together; a tile key is a
    pair of column blocks, the lower one first, and each pair is multiplied.  A task adds up
    its products by tile, ``HELD_BYTES`` at the most, and passes on sums; they are added per
    tile and entry.  What reaches the driver is the matrix: the square of the
    dimensions, whatever the number of rows.
    """
    block = pa.schema([("row_block", pa.int64()), ("tile", pa.int32()), ("data", pa.binary())])

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = partition_id() << 33
        for number, batch in enumerate(_slices(stream, dims)):
            x = centred(_matrix(batch.column(0), batch.num_rows))
            data = [np.ascontiguousarray(x[:, a : a + WIDTH]).tobytes() for a in range(0, dims, WIDTH)]
            columns = [pa.array([first + number] * len(data)), pa.array(range(len(data)), pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=block)

    blocks = map_batches(rows.select(column), cut, "row_block long, tile int, data binary")
    left = blocks.select("row_block", F.col("tile").alias("i"), F.col("data").alias("a"))
    right = blocks.select("row_block", F.col("tile").alias("j"), F.col("data").alias("b"))
    pairs = left.join(right, "row_block").where("i <= j").select("i", "j", "a", "b")
    make = batches({"i": pa.int32(), "j": pa.int32(), "sums": pa.list_(pa.float64())})

    def multiply(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        spent = lambda: make({"i": [k[0] for k in held], "j": [k[1] for k in held], "sums": [v.ravel() for v in held.values()]})
        for batch in stream:
            for i, j, a, b in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                x = np.frombuffer(a).reshape(-1, min(WIDTH, dims - i * WIDTH))
                y = np.frombuffer(b).reshape(-1, min(WIDTH, dims - j * WIDTH))
                product = x.T @ y
                held[i, j] = held[i, j] + product if (i, j) in held else product
                if len(held) * WIDTH * WIDTH * 8 > HELD_BYTES:
                    yield spent()
                    held.clear()
        if held:
            yield spent()

    tiles = map_batches(pairs, multiply, "i int, j int, sums array<double>")
    entries = tiles.select("i", "j", F.posexplode("sums").alias("at", "s")).groupBy("i", "j", "at").agg(F.sum("s").alias("s"))
    out = np.zeros((dims, dims))
    for i, j, at, s in entries.collect():
        row, col = divmod(at, min(WIDTH, dims - j * WIDTH))
        row, col = i * WIDTH + row, j * WIDTH + col
        out[row, col] = out[col, row] = s / n
    return out


class Whitening:
    """Means and components of a fit list of integer vectors."""

    def __init__(self, n: int, total: list[int], most: int = 8):
        self.n, self.total, self.most = n, total, most
        # x is taken relative to a whole number near the mean, so that its distance to the mean is exact
        self.near = np.array([s // n for s in total] if n else [], np.int64)
        self.rest = np.array([s - n * int(r) for s, r in zip(total, self.near, strict=True)] if n else [], np.int64)
        self.values = np.zeros(0)
        self.components = np.zeros((len(total), 0))
        self.trace = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n * x - S) ** 2 of each row: with y and q the parts of x and S, of (n * y - q) ** 2."""
        y, n, q = x - self.near, self.n, self.rest
        most = int(np.abs(y).max(initial=0))
        if len(q) * most * max(most, n) >= 2**63:
            y, q = y.astype(object), q.astype(object)
        square = sum(int(v) ** 2 for v in self.rest)
        return [n * n * int(a) - 2 * n * int(b) + square for a, b in zip((y * y).sum(1), (y * q).sum(1), strict=True)]

    def solve(self, matrix: np.ndarray) -> None:
        """Unit eigenvectors by falling eigenvalue, each with its largest entry positive; ``explained`` is the share of the trace."""
        values, vectors = np.linalg.eigh(matrix)
        order = np.argsort(-values, kind="stable")[: self.most]
        vectors = vectors[:, order]
        signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        self.values, self.components, self.trace = values[order], vectors * signs, float(np.trace(matrix))

    @property
    def explained(self) -> list[float]:
        return [float(v) / self.trace if self.trace > 0 else 0.0 for v in self.values]

    @property
    def sound(self) -> np.ndarray:
        """Which components have variance."""
        return np.array(self.explained) > NOTHING

    def whiten(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.centred(x) @ self.components) / np.sqrt(self.values)


def whiten(vectors: DataFrame, components: int = 8, *, scale: int = 1024, shift: int = 100_000, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Vectors projected on the first components of their covariance, each to variance one.

    Entries become integers (``integers`` says which rows stay); the fit list is
    all that stay.  Returns one row per row and component: ``vec_id, component`` (from
    1, by falling eigenvalue), ``n``, ``deviation`` (the exact sum over dimensions of
    (n * x - S) ** 2 as a decimal of 38 digits, null beyond them), ``whitened``,
    ``explained`` (eigenvalue over trace) and ``identity_error``: the largest absolute
    entry of the whitened rows' own covariance minus the identity.

    There are as many components as dimensions, ``components`` at the most.  A component without variance (all rows
    equal, fewer rows than dimensions) has whitened null and is no part of the
    error; the error is null if none has variance.  Equal vectors get equal values;
    equal eigenvalues come in an arbitrary order, which is the same for all rows; null
    ids and repeated rows are rows like others; columns but ``id`` and
    ``vector`` are ignored whatever their names; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    rows, dims = integers(vectors, scale, shift, id=id, vector=vector)
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not dims:
        return spark.createDataFrame([], out)
    model = Whitening(*sums(rows, dims), components)
    model.solve(covariance(rows, "x", dims, model.n, model.centred))
    kept = len(model.values)

    def project(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(stream, dims):
            x = _matrix(batch.column(1), batch.num_rows)
            w = np.where(model.sound, model.whiten(x), 0.0)
            values = pa.ListArray.from_arrays(np.arange(0, w.size + 1, kept, dtype=np.int32), w.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(str, model.deviations(x)))), values], ["vec_id", "deviation", "w"])

    done = scratch.keep(map_batches(rows, project, f"vec_id {kind}, deviation string, w array<double>"))
    means = [F.avg(F.get("w", F.lit(k))).alias(f"m{k}") for k in range(kept)]
    mean = np.array(done.agg(*means).first())
    spread = covariance(done, "w", kept, model.n, lambda w: w - mean)
    error = np.abs(spread - np.eye(kept))[np.ix_(model.sound, model.sound)]
    listed = F.array(*[F.struct(F.lit(float(e)).alias("explained"), F.lit(bool(s)).alias("sound")) for e, s in zip(model.explained, model.sound, strict=True)])
    each = done.select("vec_id", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), F.posexplode(F.arrays_zip("w", listed.alias("c"))).alias("k", "z"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("z.c.sound"), F.col("z.w")).alias("whitened"),
        F.col("z.c.explained").alias("explained"),
        F.lit(float(error.max()) if error.size else None).cast("double").alias("identity_error"),
    )
