"""Encoders turn items into vectors. A new one is a function from a list of items to a matrix, and its width."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def hashing(dim: int) -> Callable[[list], np.ndarray]:
    """Signed sums of hashed words; needs no model."""
    def encode(items: list) -> np.ndarray:
        out = np.zeros((len(items), dim), np.float32)
        for i, item in enumerate(items):
            for word in (item if isinstance(item, bytes) else (item or "").encode()).split():
                h = zlib.crc32(word)
                out[i, h % dim] += 1.0 if h >> 31 else -1.0
        return out

    return encode


def encode(items: DataFrame, make: Callable[[], Callable[[list], np.ndarray]], dim: int, column: str = "text", normalise: bool = False, batch: int = 256) -> DataFrame:
    """asset_id and embedding. make runs once a task, so a model is loaded once; a wrong width is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                some = rows.slice(at, batch)
                matrix = np.asarray(encoder(some.column(column).to_pylist()), np.float32)
                if matrix.shape != (some.num_rows, dim):
                    raise ValueError(f"the encoder gave {matrix.shape}, not {(some.num_rows, dim)}")
                if normalise:
                    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, dim), pa.int32()), pa.array(matrix.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([some.column("asset_id"), vectors], ["asset_id", "embedding"])

    return items.select("asset_id", column).mapInArrow(run, "asset_id string, embedding array<float>")
