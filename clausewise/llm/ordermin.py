"""Near-duplicates by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm._shared import Scratch, batches, components, small_slices
from clausewise.session import map_batches

_WORD = re.compile(r"\w+")
_MASK = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Sketcher:
    """Shingles and Order MinHash sketches of whole texts.

    A k-mer is ``shingle`` words in a row (lower case, letters and digits); a text
    of fewer words has one, all its words.  For each of ``sketches`` hash functions
    the ``picks`` smallest k-mers are taken, each labelled with its number among
    equal ones, and hashed in the order in which they stand in the text.  So two
    texts agree in a sketch if they share the k-mers and their order.
    """

    def __init__(self, shingle: int = 5, sketches: int = 16, picks: int = 3, seed: int = 11, most: int = 300_000):
        rng = np.random.default_rng(seed)
        self.shingle, self.picks, self.most = shingle, picks, most
        self.seeds = rng.integers(0, 1 << 63, (sketches, 1), dtype=np.uint64)
        self.odd = rng.integers(0, 1 << 63, (sketches, 1), dtype=np.uint64) | np.uint64(1)
        self.known: dict[str, int] = {}

    def _words(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > self.most:
                self.known.clear()
            for w in words:
                if w not in self.known:
                    self.known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            got = [self.known[w] for w in words]
        return np.array(got, dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """64-bit hashes of the text's shingles in order; none for a text without words."""
        return self.shingled(self._words(text or ""))

    def shingled(self, w: np.ndarray) -> np.ndarray:
        """The shingles of a text of these words."""
        if not len(w):
            return w
        k = min(self.shingle, len(w))
        n = len(w) - k + 1
        h = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            h = _mix(h ^ w[i : i + n]) + np.uint64(i + 1)
        return h

    @staticmethod
    def labelled(shingles: np.ndarray) -> np.ndarray:
        """The shingles told from equal ones by their number among them: all different."""
        n = len(shingles)
        order = np.argsort(shingles, kind="stable")
        ordered = shingles[order]
        starts = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), np.arange(n), 0))
        occurrence = np.empty(n, dtype=np.uint64)
        occurrence[order] = (np.arange(n) - starts).astype(np.uint64)
        # every text's alike, whether or not something repeats in it
        return _mix(shingles ^ (occurrence * np.uint64(0x9E3779B97F4A7C15)))

    def words(self, text: str | None) -> np.ndarray:
        """32-bit hashes of the text's words in order."""
        return (self._words(text or "") >> np.uint64(32)).astype("<u4")

    def prefix(self, words: np.ndarray, spread: np.ndarray, least: float) -> np.ndarray:
        """The rarest labelled shingles by ``spread`` (a count per upper 16 bits): texts that share ``least`` of the longer one's shingles share one of these."""
        all_ = self.labelled(self.shingled(words.astype(np.uint64)))
        n = len(all_)
        order = np.lexsort((all_, spread[all_ >> np.uint64(48)]))
        return all_[order[: n - math.ceil(least * n - 1e-9) + 1]]

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key per hash function."""
        n = len(shingles)
        if not n:
            return np.zeros(0, dtype=np.int64)
        labelled = self.labelled(shingles)
        values = (labelled[None, :] ^ self.seeds) * self.odd
        values ^= values >> np.uint64(32)
        k = min(self.picks, n)
        least = np.argpartition(values, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(self.seeds), 1))
        least.sort(axis=1)
        key = np.arange(len(self.seeds), dtype=np.uint64) + np.uint64(1)
        for i in range(k):
            key = _mix(key ^ shingles[least[:, i]])
        return key.astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """The share of the longer text's words that align in order, or 0.0 if that is below ``least``.

    It is one less the edits by insertion and deletion that the longer text needs.  The
    alignment is a longest common subsequence within the band that ``least`` allows
    (further off the diagonal no alignment can reach it), by bit-parallel dynamic
    programming between the first and the last difference, and only if the words
    regardless of order allow it.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    top, rest = max(n, m), min(n, m)
    need = least * top - 1e-9
    if rest < need:
        return 0.0
    differ = np.flatnonzero(a[:rest] != b[:rest])
    lead = int(differ[0]) if len(differ) else rest
    rest -= lead
    differ = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1]) if rest else ()
    tail = int(differ[0]) if len(differ) else rest
    x, y = a[lead : n - tail], b[lead : m - tail]
    if len(x) and len(y):
        (p, i), (q, j) = (np.unique(z, return_counts=True) for z in (x, y))
        _, at, of = np.intersect1d(p, q, assume_unique=True, return_indices=True)
        if lead + tail + np.minimum(i[at], j[of]).sum() < need:
            return 0.0
    aligned = lead + tail + _lcs(x.tolist(), y.tolist(), int(n + m - 2 * need) + 1)
    return aligned / top if aligned >= need else 0.0


def _lcs(x: list[int], y: list[int], band: int) -> int:
    """Length of the longest common subsequence whose pairs (i, j) have |i - j| <= band."""
    masks: dict[int, int] = {}
    for i, s in enumerate(x):
        masks[s] = masks.get(s, 0) | 1 << i
    full = (1 << len(x)) - 1
    within = (1 << (2 * band + 1)) - 1
    row = full
    for j, s in enumerate(y):
        bits = masks.get(s)
        if bits:
            bits &= within << (j - band) if j >= band else within >> (band - j)
            if bits:
                u = row & bits
                row = ((row + u) | (row - u)) & full
    return len(x) - row.bit_count()


def near_duplicates(
    docs: DataFrame,
    *,
    threshold: float = 0.8,
    shingle: int = 5,
    sketches: int = 16,
    picks: int = 3,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Classes of near-duplicate documents: ``doc_id, class_id, kept``.

    Two texts are linked if ``similarity`` of their words is ``threshold`` at least and
    they agree in one Order MinHash sketch of their word shingles; classes are the
    components of all links, named by their smallest id, which is the one that
    is kept.

    Copies of one text form a node first, so they cost one row each.  Nodes with a
    sketch key in common are candidates.  First each key's nodes are aligned with
    one leader, the node that meets most others (a partially aggregated maximum
    and an equi-join that the skew rule splits).  Then pairs of a key that lie in
    different classes are dealt with, without listing them: each node shows so many
    of its rarest shingles that a pair which shares ``threshold`` of the longer text's
    shingles cannot miss it (prefix filtering), and pairs that share a key and such a
    shingle are aligned.  So every candidate pair is in one class, or aligned, or
    shares too few shingles, however crowded a key is.  (Pairs that share fewer
    shingles, but whose words align, as edits are spread, are found by their leaders
    alone: aligning all pairs of a crowd would cost its square.)  Texts are fetched
    for candidates only.

    Null texts count as empty; texts without words are copies of each other if
    their bytes are equal.  Rows of one id are one document.  Rows with a null id
    are kept and have no class.  Texts of any length are read and aligned whole.
    Other columns are ignored, whatever their names; an empty table gives an
    empty table.  Two texts whose shingles have the similarity s agree in a sketch
    with probability of about s ** picks, so that 16 sketches of 3 miss a pair at 0.8
    with one of 0.00001, and at 0.5 with one of 0.12.
    """
    scratch = Scratch(docs.sparkSession, "near")
    source = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    shape = (shingle, sketches, picks)
    sketched = batches({"doc_id": pa.int64(), "t": pa.binary(), "keys": pa.list_(pa.int64()), "size": pa.int32()})

    def sketch(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(*shape)
        for batch in small_slices(stream, "text"):
            out: dict[str, list] = {"doc_id": batch.column("doc_id").to_pylist(), "t": [], "keys": [], "size": []}
            for t in batch.column("text").to_pylist():
                t = t or ""
                words = sketcher._words(t)
                out["t"].append(hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
                out["keys"].append(sketcher.sketch(sketcher.shingled(words)))
                out["size"].append(len(words))
            yield sketched(out)

    all_ = scratch.keep(map_batches(source.where("doc_id IS NOT NULL"), sketch, "doc_id long, t binary, keys array<long>, size int"))
    nodes = all_.groupBy("t").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("size").alias("size"))
    nodes = scratch.keep(nodes)
    # several texts of one id are one document
    twice = all_.groupBy("doc_id").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("doc_id")
    same = all_.join(twice, "doc_id").join(nodes.select("t", "node"), "t").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    spots = nodes.select("node", "size", F.posexplode("keys").alias("i", "key"))
    crowded = spots.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    spots = scratch.keep(spots.join(crowded, ["i", "key"]).select("i", "key", "node", "size", "n"))
    # not bounded, so never broadcast: the texts move at every size
    wanted = spots.select(F.col("node").alias("doc_id")).distinct().hint("merge")
    sheet = batches({"node": pa.int64(), "words": pa.binary()})

    def worded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(*shape)
        for batch in small_slices(stream, "text"):
            yield sheet({"node": batch.column("doc_id").to_pylist(), "words": [sketcher.words(t).tobytes() for t in batch.column("text").to_pylist()]})

    texts = scratch.keep(map_batches(source.join(wanted, "doc_id", "left_semi"), worded, "node long, words binary"))
    linked = batches({"a": pa.int64(), "b": pa.int64()})

    def align(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            a, b = [], []
            for u, v, p, q in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("p"), batch.column("q"), strict=True):
                x, y = np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(q.as_buffer(), "<u4")
                if similarity(x, y, threshold) >= threshold:
                    a.append(u)
                    b.append(v)
            yield linked({"a": a, "b": b})

    def verified(pairs: DataFrame) -> DataFrame:
        first = pairs.join(texts.select(F.col("node").alias("b"), F.col("words").alias("q")), "b")
        both = first.join(texts.select(F.col("node").alias("a"), F.col("words").alias("p")), "a")
        return scratch.keep(map_batches(both.select("a", "b", "p", "q"), align, "a long, b long"))

    def fits(x: str, y: str) -> Column:
        """Whether two numbers of words allow the similarity at all."""
        return F.least(x, y) >= F.greatest(x, y) * threshold - 1e-6

    # the text that its copies were made from meets most others
    met = spots.groupBy("node").agg(F.sum("n").alias("met"))
    lead = spots.join(met, "node").groupBy("i", "key").agg(F.max(F.struct("met", (-F.col("node")).alias("m"), "size")).alias("lead"))
    near = spots.join(lead.select("i", "key", (-F.col("lead.m")).alias("leader"), F.col("lead.size").alias("lead_size")), ["i", "key"])
    ends = (F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b"))
    links = verified(near.where("node <> leader").where(fits("size", "lead_size")).select(*ends).distinct()).unionByName(same)
    classes = components(links, scratch)
    here = scratch.keep(spots.join(classes, "node", "left").select("i", "key", "node", F.coalesce("component", "node").alias("c")))
    mixed = here.groupBy("i", "key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("i", "key")
    open_ = here.join(mixed, ["i", "key"]).groupBy("node", "c").agg(F.collect_list(F.xxhash64("i", "key")).alias("keys"))
    # joined anew for each of its two uses: rows then come dealt by node, and not packed into few tasks by small files
    open_ = texts.join(scratch.keep(open_), "node")
    counted = batches({"at": pa.int64(), "n": pa.int64()})

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sketcher = np.zeros(1 << 16, dtype=np.int64), Sketcher(*shape)
        for batch in stream:
            all_ = [sketcher.labelled(sketcher.shingled(np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64))) for x in batch.column("words")]
            n += np.bincount((np.concatenate([*all_, np.zeros(0, np.uint64)]) >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
        at = np.flatnonzero(n)
        yield counted({"at": at.tolist(), "n": n[at].tolist()})

    # 65,536 numbers at the most
    spread = np.zeros(1 << 16, dtype=np.int64)
    for r in map_batches(open_.select("words"), count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        spread[r["at"]] = r["n"]
    shown = batches({"keys": pa.list_(pa.int64()), "s": pa.list_(pa.int64()), "node": pa.int64(), "c": pa.int64(), "size": pa.int32()})

    def rarest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(*shape)
        for batch in small_slices(stream, "words"):
            words = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("words")]
            data = {k: batch.column(k).to_pylist() for k in ("keys", "node", "c")}
            yield shown(data | {"s": [sketcher.prefix(x, spread, threshold).astype(np.int64) for x in words], "size": [len(x) for x in words]})

    heads = map_batches(open_.select("node", "words", "c", "keys"), rarest, "keys array<long>, s array<long>, node long, c long, size int")
    # a row a shingle, whatever the number of keys: those are compared where two rows meet
    heads = heads.select(F.explode("s").alias("s"), "node", "c", "size", "keys")
    shared = heads.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s")
    heads = scratch.keep(heads.join(shared, "s"))
    other = heads.select("s", F.col("node").alias("b"), F.col("c").alias("d"), F.col("size").alias("m"), F.col("keys").alias("other"))
    meets = (F.col("node") > F.col("b")) & (F.col("c") != F.col("d")) & fits("size", "m") & F.arrays_overlap("keys", "other")
    last = heads.join(other, "s").where(meets).select(F.col("node").alias("a"), "b").distinct()
    won = verified(last)
    if not won.isEmpty():
        classes = components(links.unionByName(won), scratch)
    # components are named by their smallest node, and a node by its smallest id
    named = nodes.select("t", "node").join(classes, "node", "left").select("t", F.coalesce("component", "node").alias("class_id"))
    result = all_.select("doc_id", "t").join(named, "t").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    nameless = source.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return result.unionByName(nameless)
