"""Packing: concatenate all tokens in order and cut the line into fixed windows."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.session import map_batches
from clausewise.llm._shared import Scratch, batches, partition_id, small_slices

#: Characters at which str.split() cuts and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: How the tokenizer cuts ASCII words in lower case.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: The rule of the tokenizer on which that rests.
_SPLIT = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: printable ones as they are, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_SPELLED = _byte_letters()


class _Known(dict):
    """Ids of words, found on demand.

    Two generations of ``most`` words bound it: when the younger is full it becomes
    the older, whose own words go, so words in use stay.
    """

    def __init__(self, tokenizer, code: str, most: int):
        super().__init__()
        self.tokenizer, self.model, self.code = tokenizer, tokenizer.model, code
        self.most, self.older = most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ascii_ = word.isascii()
            if word.isalpha():
                pieces = [word if ascii_ else word.encode().decode("latin-1").translate(_SPELLED)]
            elif ascii_:
                pieces = _PIECE.findall(word)
            else:
                pieces = None
            if pieces is None:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            else:
                ids = [t.id for piece in pieces for t in self.model.tokenize(piece)]
            ids = array(self.code, ids).tobytes()
        self[word] = ids
        return ids

    def trim(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class WordTokens:
    """Ids of whole texts from a word-level tokenizer, by a cache of its words.

    The tokenizer's ids of a text are those of its words (stretches without white
    space) in order, as no rule of it looks across white space; nor does one look
    from a letter to a mark behind it, so such marks count as words of their own.
    Texts are lower-cased and cut into words together; the ids of each distinct word
    come from the cache and are laid out by word numbers.  A new word of letters is
    one piece of the model, another ASCII word is cut by the tokenizer's own
    rule, and all other words go through the whole tokenizer.  So do whole texts
    that hold a separator control character or a special token, or that aren't in
    composed form (before or after lower-casing), and all texts where the tokenizer's rules are
    not those that this rests on.  ``most`` bounds each generation of the cache.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        rules = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in rules["added_tokens"]]
        names = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        fits = names == ["NFC", "Replace", "Lowercase"] and _SPLIT in json.dumps(rules["pre_tokenizer"], ensure_ascii=False)
        self.known = _Known(self.tokenizer, self.code, most) if fits and rules["model"].get("end_of_word_suffix") else None

    def _plain(self, text: str) -> str | None:
        """The text in lower case, or None if it has to go through the tokenizer whole."""
        if self.known is None or _ODD.search(text) or not is_normalized("NFC", text) or any(t in text for t in self.special):
            return None
        # a final sigma is Python's own rule, not the tokenizer's
        low = text.replace("Σ", "σ").lower()
        return low if low.isascii() or is_normalized("NFC", low) else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``type``."""
        low = [self._plain(t) if t else "" for t in texts]
        cut = pc.replace_substring_regex(pa.array(low, pa.string()), r"(\pL)([^\s\pL\pN])", r"\1 \2")
        words = pc.utf8_split_whitespace(cut.fill_null(""))
        coded = words.values.dictionary_encode()
        ids = [self.known[w] for w in coded.dictionary.to_pylist()] if self.known is not None else [b""] * len(coded.dictionary)
        if self.known is not None:
            self.known.trim()
        width = self.type.itemsize
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        first = np.cumsum(size) - size
        number = coded.indices.to_numpy(zero_copy_only=False)
        each = size[number]
        ends = np.concatenate([[0], np.cumsum(each)])
        all_ = np.frombuffer(b"".join(ids), self.type)
        raw = all_[np.repeat(first[number] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        at = (ends[words.offsets.to_numpy()] * width).tolist()
        out = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i, t in enumerate(texts):
            if t and low[i] is None:
                out[i] = array(self.code, self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
        return out


@lru_cache(1)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    length: int = 2048,
    end_id: int = 1,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Concatenate and cut: the pieces of all documents in windows of ``length`` tokens.

    Pass one tokenizes each partition once, appends ``end_id`` to each document
    and stores ids with their running offset in the partition.  The partitions'
    totals (one number each) give every partition's place in the whole line by a
    prefix sum.  Pass two cuts the stored ids at multiples of ``length``; a
    document that crosses a window's boundary becomes several pieces.  No row is
    shuffled and only the last window is padded.

    Returns ``doc_id, start, length, ids`` (binary, little-endian 32-bit),
    ``doc_tokens, sequence_id, offset``.  Null texts count as empty: such a document
    is its end id.  Repeated rows are packed once each; null ids are passed on;
    a text of any length is packed whole; an empty table gives no rows; further
    columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    source = docs.selectExpr(f"`{id}` AS doc_id", f"`{text}` AS text")
    make = batches({"part": pa.int32(), "at": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "ids": pa.binary()})

    def tokenize(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, at, part = _tokens(tokenizer_path), 0, partition_id()
        last = np.array([end_id], dtype=tokens.type).tobytes()
        width = tokens.type.itemsize
        for batch in small_slices(stream, "text"):
            ids = [x + last for x in tokens.encode(batch.column("text").to_pylist())]
            sizes = np.array([len(x) // width for x in ids], dtype=np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield make({"part": [part] * len(ids), "at": starts, "doc_id": batch.column("doc_id").to_pylist(), "n": sizes, "ids": ids})

    stored = scratch.keep(map_batches(source, tokenize, "part int, at long, doc_id long, n long, ids binary"))
    # one row per partition of the input: its number is bounded by the number of tasks
    totals = sorted(stored.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, sum_ = {}, 0
    for part, n in totals:
        base[part] = sum_
        sum_ += n
    # as large as that number of tasks: a few bytes for each
    places = spark.sparkContext.broadcast(base)
    cut = batches(
        {
            "doc_id": pa.int64(),
            "start": pa.int64(),
            "length": pa.int64(),
            "ids": pa.binary(),
            "doc_tokens": pa.int64(),
            "sequence_id": pa.int64(),
            "offset": pa.int64(),
        }
    )

    def pieces(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(stream, "ids"):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "at", "part")), strict=True)
            for doc_id, n, raw, at, part in rows:
                at += places.value[part]
                ids = np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    window, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    values = (doc_id, start, size, ids[4 * start : 4 * (start + size)], n, window, offset)
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
                    start += size
            yield cut(out)

    kinds = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return map_batches(stored.select("doc_id", "n", "ids", "at", "part"), pieces, kinds)


def with_crc32(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of ``ids``."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
