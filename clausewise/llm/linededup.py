"""Line deduplication by content-defined chunks of lines."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.llm._shared import Scratch, batches, small_slices
from clausewise.session import map_batches

#: A line, or a sentence of a line, with the marks and white space behind it.
_UNIT = re.compile(r"[^.!?。！？\n]+[.!?。！？\s]*|[.!?。！？\s]+")
_hash = xxhash.xxh3_64_intdigest
_BASE = 0x9E3779B97F4A7C15
_TOP = np.uint64((1 << 64) - 1)
ADDED = ("removed_chunks", "removed_chars")


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(1 << 10, _BASE), _powers(1 << 10, pow(_BASE, -1, 1 << 64))


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse, from 0 to ``n`` - 1."""
    global _up, _down
    if len(_up) < n:
        _up, _down = _powers(2 * n, _BASE), _powers(2 * n, pow(_BASE, -1, 1 << 64))
    return _up[:n], _down[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Chunking:
    """How texts are cut.

    Units are lines, and in them sentences; one of more than ``long_unit`` words is
    cut again, before each word whose hash is the smallest within ``reach`` words.  A
    boundary stands between two units if they have ``close`` words or more together,
    or if the rolling hash over both is smaller than that at the unit borders before
    and behind.  So it depends on four units at most, whatever stands elsewhere.
    A chunk begins at each boundary and is the shortest run of units up to another
    one that has two units and ``least_words`` words at least; chunks overlap.
    """

    long_unit: int = 17
    reach: int = 4
    close: int = 12
    least_words: int = 16

    def units(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """All units of all texts in order, which together are the texts, and how many each text has."""
        found = [_UNIT.findall(t) if t else [] for t in texts]
        each = np.fromiter(map(len, found), np.int64, len(found))
        units = list(chain.from_iterable(found))
        long = np.flatnonzero(np.fromiter((u.count(" ") for u in units), np.int64, len(units)) >= self.long_unit)
        if not len(long):
            return units, each
        pieces, n = self._pieces([units[k] for k in long])
        of = np.searchsorted(np.cumsum(each), long, side="right")
        each += np.bincount(of, n - 1, len(each)).astype(np.int64)
        out: list[str] = []
        before, at = 0, 0
        for k, m in zip(long.tolist(), n.tolist(), strict=True):
            out += units[before:k]
            out += pieces[at : at + m]
            before, at = k + 1, at + m
        return out + units[before:], each

    def _pieces(self, units: list[str]) -> tuple[list[str], np.ndarray]:
        """Long units, each cut where its words nearby say so, not where it begins; and the number of pieces of each."""
        joined = " ".join(units)
        raw = np.frombuffer(b" " * 8 + joined.encode() + b" " * 8, np.uint8)
        edges = np.flatnonzero(np.diff((raw > 32).view(np.int8), prepend=0))
        start, end = edges[::2], edges[1::2]
        # a word's hash: its first and its last eight bytes, and its length
        eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
        width = np.minimum(end - start, 8).astype(np.uint64)
        first = eight[start].view("<u8")[:, 0] << (np.uint64(64) - width * np.uint64(8))
        last = eight[end - 8].view("<u8")[:, 0] >> (np.uint64(64) - width * np.uint64(8))
        h = _mix(_mix(first) + last * np.uint64(_BASE) + (end - start).astype(np.uint64))
        at = (start if len(raw) == len(joined) + 16 else np.cumsum((raw & 0xC0) != 0x80)[start] - 1) - 8
        size = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(size + 1) - size - 1
        of = np.searchsorted(begin, at, side="right") - 1
        low = np.ones(len(h), bool)
        low[0] = False
        low[1:] &= of[1:] == of[:-1]
        for k in range(1, self.reach + 1):
            other = of[k:] != of[:-k]
            low[k:] &= (h[k:] < h[:-k]) | other
            low[:-k] &= (h[:-k] <= h[k:]) | other
        cuts = np.concatenate([begin, at[low]])
        stops = np.concatenate([begin[1:] - 1, [len(joined)]])
        order = np.argsort(cuts, kind="stable")
        of = np.concatenate([np.arange(len(units)), of[low]])[order]
        cuts = cuts[order]
        ends = np.append(cuts[1:], len(joined))
        ends = np.minimum(ends, stops[of])
        pieces = [joined[a:b] for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
        return pieces, np.bincount(of, minlength=len(units))

    def keyed(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, hash, start, end) of every chunk of all texts, as arrays; white space at a chunk's end does not count."""
        units, each = self.units(texts)
        n = len(units)
        none = np.zeros(0, np.int64)
        if not n:
            return none, none.astype(np.uint64), none, none
        bare = [u.rstrip() for u in units]
        h = np.fromiter(map(_hash, units), np.uint64, n)
        size = np.fromiter([b.count(" ") + 1 for b in bare], np.int64, n)
        offset = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), np.int64, n))])
        ends = np.cumsum(each)
        stop = np.zeros(n, bool)
        stop[ends[each > 0] - 1] = True
        rolled = _mix(h[:-1] * np.uint64(_BASE) + h[1:])
        rolled[stop[:-1]] = _TOP
        cut = np.ones(n - 1, bool)
        cut[1:] &= rolled[1:] < rolled[:-1]
        cut[:-1] &= rolled[:-1] <= rolled[1:]
        cut |= (size[:-1] + size[1:] >= self.close) | stop[:-1]
        at = np.concatenate([[0], np.flatnonzero(cut) + 1, [n]])
        total = np.concatenate([[0], np.cumsum(size)])[at]
        begin = np.arange(len(at) - 1)
        text = np.searchsorted(ends, at[:-1], side="right")
        # the border at which the text ends
        most = np.searchsorted(at, ends[text])
        last = np.maximum(np.searchsorted(total, total[:-1] + self.least_words), begin + 1)
        last += (last <= most) & (at[np.minimum(last, most)] - at[begin] < 2)
        fits = last <= most
        text, first, last = text[fits], at[begin[fits]], at[last[fits]]
        up, down = _scales(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
        inner = (sums[last - 1] - sums[first]) * down[first]
        tails = np.fromiter([_hash(bare[k]) for k in (last - 1).tolist()], np.uint64, len(last))
        key = _mix(_mix(inner) + tails * np.uint64(_BASE) + (last - first).astype(np.uint64))
        here = offset[ends - each][text]
        return text, key, offset[first] - here, offset[last] - here

    def chunks(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of all units."""
        out, at = [], 0
        for u in self.units([text])[0]:
            out.append((at, at + len(u)))
            at += len(u)
        return out


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cover(spans: list[tuple[int, int]]) -> list[int]:
    """Indexes of few of the sorted spans that cover as much as all."""
    out: list[int] = []
    reach, best = -1, -1
    for k, (a, b) in enumerate(spans):
        if best >= 0 and a > reach:
            out.append(best)
            reach, best = spans[best][1], -1
        if b > reach and (best < 0 or b > spans[best][1]):
            best = k
    return out + [best] * (best >= 0)


#: How much of a chunk's surroundings is looked at where a repeated stretch begins or ends.
AROUND = 120


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """Whole words before ``start`` and behind ``end``."""
    low, high = max(0, start - AROUND), min(len(text), end + AROUND)
    before, after = text[low:start], text[end:high]
    if low and not text[low - 1].isspace():
        before = before[len(before.split(None, 1)[0]) if before and not before[0].isspace() else 0 :]
    if high < len(text) and not text[high].isspace():
        after = after[: len(after) - len(after.rsplit(None, 1)[-1])] if after and not after[-1].isspace() else after
    return before, after


def longer(text: str, start: int, end: int, before: str, after: str) -> tuple[int, int]:
    """``start`` and ``end`` moved out over the whole words that stand around the first place, too; white space behind them goes with them."""
    n = 0
    while n < min(start, len(before)) and text[start - n - 1] == before[len(before) - n - 1]:
        n += 1
    inside = lambda s, i: 0 < i < len(s) and not s[i - 1].isspace() and not s[i].isspace()
    while n and (inside(text, start - n) or inside(before, len(before) - n)):
        n -= 1
    while n and text[start - n].isspace():
        n -= 1
    m = 0
    while m < min(len(text) - end, len(after)) and text[end + m] == after[m]:
        m += 1
    while m and (inside(text, end + m) or inside(after, m)):
        m -= 1
    end += m
    while end < len(text) and text[end].isspace():
        end += 1
    return start - n, end


def removed(text: str, places: Iterable[dict]) -> list[tuple[int, int]]:
    """Merged spans of ``text`` that stand elsewhere before: its ``places`` whose characters are those of the first place."""
    out = []
    for p in places:
        start, end = p["at"] >> 32, p["at"] & 0xFFFFFFFF
        bare = start + len(p["model"])
        if text[start:bare] == p["model"] and not text[bare:end].strip():
            low, high = longer(text, start, bare, p["before"] or "", p["after"] or "")
            out.append((low, max(high, end)))
    return merged(sorted(out))


def dedup_lines(docs: DataFrame, chunking: Chunking = Chunking(), *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without chunks of lines that occur before, anywhere in the table.

    A chunk's first place (the smallest id, then the place in the text) keeps it;
    each other place loses it, if its characters are those of the first place: equal
    hashes alone remove nothing.  Where such a stretch begins or ends, up to
    ``AROUND`` characters go with it, in whole words, as far as they stand around
    the first place, too.  What goes is always left at an earlier place.  The added
    ``removed_chunks`` counts the stretches that go, and ``removed_chars`` their
    characters; input columns of these names give way, others pass unchanged.

    Null and empty texts have no chunks and pass as they are.  Of copies of one
    text all but the one with the smallest id lose all chunks.  Repeated rows (same
    id and text) are one document, so each keeps what the document keeps; rows
    with a null id count as the smallest id.  Texts of any length are cut whole; an
    empty table gives an empty table.

    Only chunk hashes are counted over the whole table, with partial aggregates;
    the joins are on hashes that repeat, so a passage that a third of all documents
    share costs one narrow row per place and is split by the skew-join rule.  Texts
    are shuffled once, by document; first places' characters come from that
    exchange and go to the others.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    others = [c for c in docs.columns if c not in (*ADDED, text)]
    keyed = docs.select(
        F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(-(1 << 63))).alias("id"),
        # tells apart texts of one id; every place is compared in its own text, so equal values do no harm
        F.hash(F.col(f"`{text}`")).alias("key"),
        F.col(f"`{text}`").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
    )
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("key", pa.int32()), ("at", pa.int64())])

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(stream, "text"):
            of, h, start, end = chunking.keyed(batch.column("text").to_pylist())
            ids = [pc.take(batch.column(c), pa.array(of)) for c in ("id", "key")]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *ids, pa.array(start << 32 | end)], schema=schema)

    chunks = scratch.keep(map_batches(keyed.select("id", "key", "text"), cut, "h long, id long, key int, at long"))
    more = chunks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    repeated = scratch.keep(chunks.join(more, "h"))
    place = F.struct("id", "key", "at")
    firsts = repeated.groupBy("h").agg(F.min(place).alias("first"))
    marks = repeated.join(firsts, "h").select("id", "key", F.struct("at", "h", (F.col("first") == place).alias("first")).alias("mark"))
    picked = schema.append(pa.field("side", pa.int32()))

    def choose(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document the first places (side -1) and few of the others that cover all; 1 and 2 mark where a stretch begins and ends."""
        for batch in stream:
            lists = batch.column("marks")
            of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            at, h, first = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("at", "h", "first"))
            order = np.lexsort((at, of))
            rows, side = order[first[order]], []
            order = order[~first[order]]
            edges = np.searchsorted(of[order], np.arange(len(lists) + 1)).tolist()
            spans = list(zip((at[order] >> 32).tolist(), (at[order] & 0xFFFFFFFF).tolist(), strict=True))
            few: list[int] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                chosen = [a + k for k in cover(spans[a:b])]
                few += chosen
                for k, j in enumerate(chosen):
                    begins = not k or spans[chosen[k - 1]][1] < spans[j][0]
                    ends = k + 1 == len(chosen) or spans[j][1] < spans[chosen[k + 1]][0]
                    side.append(begins + 2 * ends)
            rows = np.concatenate([rows, order[few]]) if few else rows
            side = np.concatenate([np.full(len(rows) - len(side), -1), np.array(side, dtype=np.int64)])
            ids = [pc.take(batch.column(c), pa.array(of[rows])) for c in ("id", "key")]
            yield pa.RecordBatch.from_arrays([pa.array(h[rows]), *ids, pa.array(at[rows]), pa.array(side.astype(np.int32))], schema=picked)

    # one document's places: bounded by its own length
    by_document = marks.groupBy("id", "key").agg(F.collect_set("mark").alias("marks"))
    chosen_ = scratch.keep(map_batches(by_document, choose, "h long, id long, key int, at long, side int"))
    again = chosen_.where("side >= 0")
    sources = chosen_.where("side < 0").join(again.select("h").distinct(), "h", "left_semi")
    sources = sources.groupBy("id", "key").agg(F.collect_list(F.struct("h", "at")).alias("firsts"))
    piece = batches({"h": pa.int64(), "before": pa.string(), "model": pa.string(), "after": pa.string()})

    def fetch(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(stream, "text"):
            out: dict[str, list] = {k: [] for k in ("h", "before", "model", "after")}
            for t, places in zip(batch.column("text").to_pylist(), batch.column("firsts").to_pylist(), strict=True):
                for p in places:
                    start = p["at"] >> 32
                    model = t[start : p["at"] & 0xFFFFFFFF].rstrip()
                    before, after = surroundings(t, start, start + len(model))
                    for name, v in zip(out, (p["h"], before, model, after), strict=True):
                        out[name].append(v)
            yield piece(out)

    # all columns stay in both joins, so that one exchange of the texts serves both
    pieces = map_batches(keyed.join(sources, ["id", "key"]), fetch, "h long, before string, model string, after string")
    models = pieces.groupBy("h").agg(F.max(F.struct("model", "before", "after")).alias("m"))
    side = lambda bit, c: F.when(F.col("side").bitwiseAND(bit) > 0, F.col(c)).alias(c.split(".")[1])
    known = again.join(models, "h").select("id", "key", F.struct("at", F.col("m.model"), side(1, "m.before"), side(2, "m.after")).alias("place"))
    gone = known.groupBy("id", "key").agg(F.collect_set("place").alias("gone"))
    joined = keyed.join(gone, ["id", "key"], "left")
    schema_out = T.StructType(
        [
            T.StructField("row", joined.schema["row"].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("removed_chunks", T.LongType()),
            T.StructField("removed_chars", T.LongType()),
        ]
    )

    def rebuild(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(stream, "text"):
            texts, counts, chars = [], [], []
            for t, places in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                spans = removed(t, places) if places else []
                if spans:
                    edges = [0, *(x for s in spans for x in s), len(t)]
                    texts.append("".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                else:
                    texts.append(t)
                counts.append(len(spans))
                chars.append(sum(b - a for a, b in spans))
            columns = [batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(chars, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "removed_chunks", "removed_chars"])

    done = map_batches(joined, rebuild, schema_out)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c not in ADDED], *ADDED)
