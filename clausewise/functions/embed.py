"""Vectors of texts by a provider that each worker loads once."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.session import ship


class Embedder(Protocol):
    """What makes vectors.  It travels to the workers, so it should be small: weights are loaded by ``load``, once a worker."""

    #: Equal keys share what a worker has loaded.
    key: str
    dims: int

    def load(self): ...

    def vectors(self, loaded, texts: Sequence[str]) -> np.ndarray: ...


_WORD = regex.compile(r"[\p{L}\p{N}_]+")


class SignedProjection:
    """Signed random projections of term weights, so no model is needed.

    A term's weight is 1 + ln of its count; each term adds its weight to or takes it from every dimension,
    by the bits of a hash of the term.  Cosines of these vectors estimate those of
    the term weights.  ``load`` gives the bits of terms met before, a cache of bounded size:
    each term's row in one table of signs, so that a text is one product.
    """

    MOST = 200_000

    def __init__(self, dims: int = 256, seed: int = 0):
        self.dims, self.seed, self.key = dims, seed, f"signed-{dims}-{seed}"

    def load(self) -> tuple[dict[str, int], np.ndarray]:
        return {}, np.zeros((self.MOST, self.dims), np.int8)

    def signs(self, term: str) -> np.ndarray:
        salt = self.seed.to_bytes(8, "little")
        bits = hashlib.shake_128(salt + term.encode()).digest(-(-self.dims // 8))
        return np.unpackbits(np.frombuffer(bits, np.uint8))[: self.dims].astype(np.int8) * 2 - 1

    def vectors(self, loaded: tuple[dict[str, int], np.ndarray], texts: Sequence[str]) -> np.ndarray:
        known, table = loaded
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            counts = Counter(_WORD.findall(text.lower().replace("̇", "")))
            terms = list(counts)
            # a text's terms are in the table together, if need be a part at a time
            for start in range(0, len(terms), self.MOST):
                part = terms[start : start + self.MOST]
                if len(known) + len(part) > self.MOST:
                    known.clear()
                for term in part:
                    if term not in known:
                        table[len(known)] = self.signs(term)
                        known[term] = len(known)
                weights = 1 + np.log([counts[t] for t in part])
                row += weights @ table[[known[t] for t in part]]
        return out


#: What this worker has loaded, by the provider's key.
_loaded: dict[str, object] = {}


def embed(rows: DataFrame, text: str, provider: Embedder | None = None, out: str = "vector") -> DataFrame:
    """``rows`` with the vector (array<double>) of a text column; null for a null text and a text without terms."""
    provider = provider or SignedProjection()
    ship(rows.sparkSession)

    @F.pandas_udf("array<double>")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if provider.key not in _loaded:
            _loaded[provider.key] = provider.load()
        for texts in batches:
            # a null text's vector is no vector
            known = texts.fillna("")
            made = provider.vectors(_loaded[provider.key], list(known))
            yield pd.Series([v.tolist() if t and v.any() else None for t, v in zip(known, made, strict=True)])

    return rows.withColumn(out, make(F.col(text)))
