"""Keys of document rows that need no unique doc_id, and filters by a broadcast bit table of such keys."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from lumenqa.llm import bitset
from lumenqa.llm import words as W
from lumenqa.llm.workspace import text_bytes, text_slices

#: Stands for a null doc_id, which is last in any order; the largest long itself therefore reads as null.
NO_ID = (1 << 63) - 1
U = np.uint64


def text_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 63-bit halves of a BLAKE2b digest of each whole text."""
    raw, cuts = data.tobytes(), offsets.tolist()
    digests = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    halves = (np.frombuffer(digests, "<u8").reshape(-1, 2) >> U(1)).astype(np.int64)
    return halves[:, 0].copy(), halves[:, 1].copy()


def ids_of(part: pa.RecordBatch) -> np.ndarray:
    """doc_id with nulls last."""
    return np.asarray(pa.compute.fill_null(part.column("doc_id").cast(pa.int64()), NO_ID))


def keys_of(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id with nulls last, hash of the whole text): equal for repeated rows alone."""
    return ids_of(part), text_keys(data, offsets)[0]


def hashed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row keys of (d, k) columns."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(row_key(np.asarray(b.column(0)), np.asarray(b.column(1))))], names=["key"])


def row_key(d: np.ndarray, k: np.ndarray) -> np.ndarray:
    return (W.mix(d.astype(U) * U(0x9E3779B97F4A7C15) ^ k.astype(U)) >> U(1)).astype(np.int64)


def rows_hit(bits, columns: list[str], keep: bool, by_text: bool = False):
    """Rows whose row key (or text key) the bit table has (keep) or has not; columns may name __d, __k and __k2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                d, (k, k2) = ids_of(part), text_keys(data, offsets)
                hit = bitset.hits(table, k if by_text else row_key(d, k))
                made = {"__d": d, "__k": k, "__k2": k2}
                whole = pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, made.values())], names=[*part.schema.names, *made])
                yield whole.filter(pa.array(hit if keep else ~hit)).select(columns)

    return run
