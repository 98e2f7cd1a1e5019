"""Vectors of texts by a pluggable encoder, built once per text and model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An encoder takes texts and returns a matrix of a row per text.
Encoder = Callable[[list[str]], np.ndarray]
_WORD = re.compile(r"[a-z0-9]+|[㐀-䶿一-鿿]")


def hashing_encoder(dimension: int = 256) -> Encoder:
    """The offline default: words and pairs of words hashed into signed places, of unit length; an empty text is a zero vector."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            w = _WORD.findall(t.lower())
            h = np.array([xxhash.xxh3_64_intdigest(x) for x in (*w, *map(" ".join, zip(w, w[1:])))], np.uint64)
            if len(h):
                np.add.at(out[i], (h % np.uint64(dimension)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    return encode


def embed(df: DataFrame, key: str, text: str, encoder: Encoder, model: str) -> DataFrame:
    """``key, model, embedding``; null counts as empty.  The encoder is made once per batch stream, texts never leave their partition."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = encoder([t or "" for t in batch.column("_text").to_pylist()]).astype(np.float32)
            offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([model] * len(m)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))], [key, "model", "embedding"]
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(go, f"`{key}` {kind}, model string, embedding array<float>")


def missing(df: DataFrame, key: str, text: str, done: DataFrame, encoder: Encoder, model: str) -> DataFrame:
    """The vectors that ``done`` does not have for this model yet."""
    return embed(df.join(done.where(F.col("model") == model).select(key), key, "left_anti"), key, text, encoder, model)
