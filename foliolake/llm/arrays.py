"""Sums of numpy arrays over all tasks, added up on executors block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_SCHEMA = "block int, payload binary"


def blocks_of(array: np.ndarray, size: int) -> Iterator[tuple[int, bytes]]:
    """The non-zero blocks of a flat array, compressed."""
    import zstandard

    flat, pack = array.reshape(-1), zstandard.ZstdCompressor(level=1)
    for k in range(0, len(flat), size):
        part = flat[k : k + size]
        if part.any():
            yield k // size, pack.compress(part.tobytes())


def record(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "payload"])


def total(df: DataFrame, length: int, size: int, dtype: str) -> np.ndarray:
    """The sum of the arrays whose blocks df holds (columns block, payload).

    A task streams the blocks dealt to it and keeps one running sum for each,
    so its memory doesn't grow with the number of tasks before it. The driver
    receives one array of `length` values, whatever the input.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("payload")):
                part = np.frombuffer(unpack.decompress(raw.as_py()), dtype)
                sums[k] = part.copy() if k not in sums else sums[k] + part
        if sums:
            yield record([(k, v.tobytes()) for k, v in sums.items()])

    n_blocks = -(-length // size)
    out = np.zeros(length, dtype)
    for row in df.select("block", "payload").repartition(min(n_blocks, 64), "block").mapInArrow(add, BLOCK_SCHEMA).toLocalIterator():
        out[row.block * size : row.block * size + size] = np.frombuffer(row.payload, dtype)
    return out
