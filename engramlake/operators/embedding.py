"""Embedders: anything that turns a batch of texts into vectors. The default needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], np.ndarray]


def byte_histogram(texts: list[str], dim: int = 24) -> np.ndarray:
    """Counts of bytes modulo ``dim``, of unit length; an empty text is the zero vector."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        b = np.frombuffer((t or "").encode(), np.uint8)
        out[i] = np.bincount(b % dim, minlength=dim)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def embed(df: DataFrame, key: str, text: str, embedder: Embedder = byte_histogram, batch: int = 512) -> DataFrame:
    """``vec_id, embedding`` of each row, Arrow batch by batch; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vec = np.asarray(embedder([x or "" for x in part.column(1).to_pylist()]), np.float32)
                flat = pa.array(vec.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1) * vec.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists], names=["vec_id", "embedding"])

    return df.select(key, text).mapInArrow(run, "vec_id long, embedding array<float>")
