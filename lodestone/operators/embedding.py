"""Embedding texts: a model is made once for each task and sees batches; without one, hashed bigrams serve."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType

Encoder = Callable[[list[str]], np.ndarray]


def hashed_bigrams(dimensions: int = 64) -> Callable[[], Encoder]:
    """An encoder without a model: signed counts of hashed letter pairs, the same on every machine."""

    def make() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions))
            for row, text in zip(out, texts, strict=True):
                low = "".join(text.lower().split())
                for pair in {low[k : k + 2] for k in range(max(1, len(low) - 1))} - {""}:
                    h = zlib.crc32(pair.encode())
                    row[h // 2 % dimensions] += 1 if h % 2 else -1
            return out

        return encode

    return make


def embedded(df: DataFrame, encoder: Callable[[], Encoder] | None = None, *, text: str = "content", out: str = "vec", batch: int = 16) -> DataFrame:
    """``df`` with ``out``, the text's vector of unit length (zeros stay zeros); null counts as empty.

    ``encoder`` makes a function from a list of texts to a matrix of their vectors.
    """
    make = encoder or hashed_bigrams()
    keep = [c for c in df.columns if c != out]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for f in frames:
            encode = encode or make()
            texts = [x or "" for x in f[text].tolist()]
            parts = [np.asarray(encode(texts[k : k + batch]), np.float32) for k in range(0, len(texts), batch)]
            if parts:
                vectors = np.concatenate(parts)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                f = f.assign(**{out: list(vectors / np.where(norms > 0, norms, 1))})
                yield f

    return df.select(*keep).mapInPandas(run, df.select(*keep).schema.add(out, ArrayType(FloatType())))
