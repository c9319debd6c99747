"""A bit table of keys: a filter that lets every key of a set through and few others, small enough to broadcast.

Its size follows the number of keys, 16 bits each, and stops at 2^30 bits (128 MB); beyond that more rows pass.
It only spares a shuffle: what passes meets an exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16
MAX_BITS = 1 << 30


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, number = np.zeros(BLOCK, bool), None
    for b in batches:
        cell = np.asarray(b.column(0))
        if len(cell):
            number = int(cell[0]) // BLOCK
            seen[cell % BLOCK] = True
    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["block", "bits"])


def build(keys: DataFrame, n: int) -> np.ndarray:
    """Packed bits over the long column ``key`` of about ``n`` rows."""
    size = 1 << max(18, min(MAX_BITS.bit_length() - 1, (16 * n).bit_length()))
    cells = keys.select(F.col("key").bitwiseAND(size - 1).alias("cell"), F.floor(F.col("key").bitwiseAND(size - 1) / BLOCK).alias("b")).distinct()
    bits = np.zeros((size // BLOCK, BLOCK // 8), np.uint8)
    for row in cells.groupBy("b").applyInArrow(pack, "block long, bits binary").toLocalIterator():
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(-1)


def hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys & (len(bits) * 8 - 1)
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
