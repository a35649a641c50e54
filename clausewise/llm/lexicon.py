"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm._shared import Scratch, batches, held_out, small_slices
from clausewise.session import map_batches

#: Letters of other scripts that look like Latin ones.
_HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝкмтвнαορεικνυτχ", "aeopcyxijshdqwkmtbhaopeiknutx", strict=True))
#: Digits and marks that stand for letters inside words.
_DIGITS = dict(zip("0134578@$!|", "oieastbasil", strict=True))
_FOLD = {ord(a): b for a, b in _HOMOGLYPHS.items()}
#: Invisible characters, and marks that are put on top of letters.
_FOLD |= dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF, *range(0x300, 0x370), *range(0x20D0, 0x2100)])

#: Written by hand: words to start from by weight, in the four languages, and phrases in which lexicon words are harmless.
_SEEDS: dict[float, str] = {
    1.5: "stupid pathetic disgusting loser clown trash ridicule débile bouffon estúpido patético ridículo dämlich lächerlich blöde",
    2.0: "idiot imbecile dumbass worthless degenerate vermin imbécile abruti ordure crétin idiota imbécil tarado payaso dummkopf trottel versager",
    2.5: "moron cretin scum scumbag connard enfoiré pourriture gilipollas escoria malnacido vollidiot abschaum drecksack arschloch",
}
SEED: dict[str, float] = {word: weight for weight, words in _SEEDS.items() for word in words.split()}
#: Of these the beginning alone says nothing.
WHOLE = frozenset("trash clown scum loser ridicule ordure payaso escoria blöde".split())
EXCEPTIONS: tuple[str, ...] = (
    "trash can", "trash bin", "trash folder", "clown fish", "sore loser trophy", "not stupid", "not worthless", "pond scum",
    "idiot proof", "class clown award", "cercopithecus moron", "trash talk", "white trash bag", "trash bag", "trash pickup", "clown car",
    "clown nose", "stupid easy", "ordure ménagère", "payaso de circo", "tourner en ridicule",
)


def _letters_for_digits(word: str) -> str:
    if not any(c in _DIGITS for c in word) or not any(c.isalpha() for c in word):
        return word
    # marks at the end of a word are punctuation, marks inside it are letters
    core = word.rstrip("!|$@")
    return "".join(_DIGITS.get(c, c) for c in core) + word[len(core) :]


def fold(text: str) -> str:
    """Lower case, one space between words, look-alikes and digits inside words as letters."""
    if text.isascii():
        low = text.lower()
    else:
        # full-width, mathematical and circled letters and digits are plain ones first
        low = unicodedata.normalize("NFKC", text).lower().translate(_FOLD)
    words = low.split()
    if any(c in low for c in _DIGITS):
        words = [_letters_for_digits(w) for w in words]
    return f" {' '.join(words)} "


@dataclass
class Lexicon:
    """Entries match where a word starts; ``whole`` ones only if the word also ends there."""

    weights: dict[str, float] = field(default_factory=lambda: dict(SEED))
    whole: frozenset[str] = WHOLE
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -3.0
    slope: float = 3.0

    def key(self) -> tuple:
        return tuple(self.weights.items()), tuple(sorted(self.whole)), self.exceptions

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            found.add_word(word, (word, weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (phrase, None))
        found.make_automaton()
        return found


def matches(automaton, whole: frozenset[str], folded: str) -> list[tuple[int, int, str, float]]:
    """Where entries match, without those inside an exception phrase and those inside a longer match."""
    hits, spared = [], []
    for end, (word, weight) in automaton.iter(folded):
        start, stop = end - len(word) + 1, end + 1
        if folded[start - 1].isalnum():
            continue
        ends = not folded[stop].isalnum()
        if weight is None:
            if ends:
                spared.append((start, stop))
        elif ends or word not in whole:
            hits.append((start, stop, word, weight))
    if spared:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spared)]
    longest: dict[int, tuple[int, int, str, float]] = {}
    for h in hits:
        if h[0] not in longest or longest[h[0]][1] < h[1]:
            longest[h[0]] = h
    return list(longest.values())


def strength(found: list[tuple[int, int, str, float]], n_words: int) -> float:
    """Summed weights, normalised by the length's square root: long texts need more, but one clear insult still counts."""
    if not found:
        return 0.0
    total = sum(h[3] for h in found)
    return total / math.sqrt(1 + n_words / 200)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most: int = 4000,
    least: int = 8,
    support: float = 0.04,
    odds: float = 5.0,
) -> Lexicon:
    """A lexicon from labelled rows outside the held-out fold.

    At most ``most`` ids of either label are read (those with the smallest
    hashes, so the sample doesn't depend on order), of several rows of one id the
    smallest text; an id with both labels counts once for each.  The lexicon grows by
    covering: of the toxic rows that no entry matches yet, words and starts of
    four or five letters that ``support`` of them hold get these odds as weights and
    become entries.  Where none has that support it is halved, down to ``least`` rows,
    whatever share of all toxic rows these are; learning ends when no entry reaches
    ``least`` rows and the odds.  Equal texts count as one row, and common entries
    come first, so words that copies of one toxic text share are learned only where
    nothing else explains them.  The number of entries is bounded by the words of the
    sample.  With no labels the hand-written lexicon stays.
    """
    spark = docs.sparkSession
    known = labels.where(~held_out(id) & F.col(id).isNotNull()).selectExpr(f"`{id}` AS doc_id", f"CAST(`{label}` AS int) AS y").where("y IN (0, 1)")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon()
    rank = F.xxhash64("doc_id", F.lit("toxic"))
    of = lambda y: known.where(F.col("y") == y).dropDuplicates(["doc_id"]).orderBy(rank, "doc_id").limit(most)
    # at most two times ``most`` ids and labels, so that the texts stay where they are
    chosen = F.broadcast(of(1).unionByName(of(0)))
    scratch = Scratch(spark, "toxic")
    sample = docs.selectExpr(f"`{id}` AS doc_id", f"`{text}` AS text").join(chosen, "doc_id")
    sample = scratch.keep(sample.groupBy("doc_id", "y").agg(F.min("text").alias("text")).dropDuplicates(["text", "y"]))
    make = batches({"feature": pa.string(), "y": pa.int32(), "n": pa.int64()})
    lexicon, left = Lexicon(), None
    while True:
        key = lexicon.key()

        def count(stream: Iterator[pa.RecordBatch], key: tuple = key) -> Iterator[pa.RecordBatch]:
            automaton, whole = _ready(key)
            for batch in stream:
                seen = {0: Counter(), 1: Counter()}
                for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    folded = fold(t or "")
                    if y and matches(automaton, whole, folded):
                        continue
                    words = {w.strip(".,;:!?\"'()[]$%&#*|") for w in set(folded.split())} - {""}
                    seen[y].update({"=" + w for w in words} | {"^" + w[:k] for w in words for k in (4, 5) if len(w) > k})
                    seen[y]["#"] += 1
                for y, c in seen.items():
                    yield make({"feature": list(c), "y": [y] * len(c), "n": list(c.values())})

        held = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
        counts = scratch.keep(
            map_batches(sample, count, "feature string, y int, n long").groupBy("feature").agg(held(1).alias("p"), held(0).alias("q")).where(F.col("p") >= least)
        )
        total = counts.where("feature = '#'").first()
        if not total:
            break
        if total["p"] == left:
            # nothing was covered by the last entries: rarer ones come next
            if support * left <= least:
                break
            support /= 2
        left = total["p"]
        weight = F.log((F.col("p") + 0.5) / (total["p"] + 1)) - F.log((F.col("q") + 0.5) / (total["q"] + 1))
        strong = counts.where((F.col("feature") != "#") & (F.col("p") >= support * total["p"])).withColumn("w", weight).where(F.col("w") > odds)
        rows = strong.orderBy(F.desc("w"), "feature").collect()
        starts = {r["feature"][1:] for r in rows if r["feature"][0] == "^"}
        whole = set()
        for r in rows:
            kind, word = r["feature"][0], r["feature"][1:]
            if any(word[:k] in starts and word[:k] != word for k in (4, 5)):
                continue  # a shorter start has it
            lexicon.weights[word] = max(lexicon.weights.get(word, 0.0), float(r["w"]))
            if kind == "=" and word not in starts:
                whole.add(word)
        lexicon.whole |= frozenset(whole)
    ys, xs = _strengths(sample, lexicon)
    lexicon.bias, lexicon.slope = _logistic(xs, ys)
    return lexicon


def _strengths(sample: DataFrame, lexicon: Lexicon) -> tuple[list[int], list[float]]:
    """Labels and strengths of the (bounded) sample."""
    rows = score(sample, lexicon, keep=("y",)).select("y", "strength").collect()
    return [r["y"] for r in rows], [r["strength"] for r in rows]


def _logistic(xs: list[float], ys: list[int]) -> tuple[float, float]:
    """Slope and bias by Newton's method with a small ridge, on classes of equal weight."""
    import numpy as np

    x, y = np.log1p(np.array(xs)), np.array(ys, dtype=float)
    if len(set(ys)) < 2 or not x.any():
        # nothing to learn from: what the hand-written lexicon starts with
        return -3.0, 3.0
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    a, b = 0.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(w * (y - p)).sum(), (w * (y - p) * x).sum() - 1e-4 * b])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 1e-9, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-4]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


@lru_cache(4)
def _ready(key: tuple) -> tuple:
    weights, whole, exceptions = key
    return Lexicon(dict(weights), frozenset(whole), exceptions).automaton(), frozenset(whole)


def score(docs: DataFrame, lexicon: Lexicon, *, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Toxicity of every whole text: ``doc_id, strength, hits, score``.

    ``score`` is a logistic function of the normalised strength, from 0 to 1.  Null
    and empty texts have no hits and the score of clean texts; a text of any length
    is folded and matched whole; repeated rows are scored once each.  Ids are passed
    on as they are; ``keep`` names whole-number columns to pass on; others are
    ignored; an empty table gives an empty table.
    """
    source = docs.selectExpr(f"`{id}` AS doc_id", f"`{text}` AS text", *[f"CAST(`{k}` AS long) AS `{k}`" for k in keep])
    key = lexicon.key()
    bias, slope = lexicon.bias, lexicon.slope
    make = batches(
        {"doc_id": pa.int64()} | {k: pa.int64() for k in keep} | {"strength": pa.float64(), "hits": pa.int64(), "score": pa.float64()}
    )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, whole = _ready(key)
        for batch in small_slices(stream, "text"):
            power, hits = [], []
            for t in batch.column("text").to_pylist():
                folded = fold(t or "")
                found = matches(automaton, whole, folded)
                hits.append(len(found))
                power.append(strength(found, folded.count(" ") - 1))
            data = {k: batch.column(k) for k in ("doc_id", *keep)}
            score = [1 / (1 + math.exp(-max(-500.0, min(500.0, bias + slope * math.log1p(x))))) for x in power]
            yield make({k: v.to_pylist() for k, v in data.items()} | {"strength": power, "hits": hits, "score": score})

    return map_batches(source, run, "".join(f"{k} long, " for k in ("doc_id", *keep)) + "strength double, hits long, score double")
