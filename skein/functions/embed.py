"""Embedders: a pluggable batch model, with a deterministic one that needs no weights."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Maps a batch of texts to one row of floats each.
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(size: int = 64) -> Embedder:
    """Signed hashing of lower-case words, scaled to length 1; a text without words is all zero."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % size] += 1.0 if h >> 31 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return embed


def embed(c: Column, model: Callable[[], Embedder] = hashing_embedder, batch: int = 64) -> Column:
    """array<float> of each text by the model that ``model()`` makes once per worker; null stays null."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = model()
        for s in parts:
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            known = s[s.notna()]
            for i in range(0, len(known), batch):
                part = known.iloc[i : i + batch]
                for at, vector in zip(part.index, embedder(part.tolist()), strict=True):
                    out.at[at] = vector
            yield out

    return F.pandas_udf(run, ArrayType(FloatType()))(c)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1, over at least one token."""
    kept = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), kept[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1.0))
    return F.transform(total, lambda x: x / n)
