"""Texts as lower-case words of letters, each in single spaces, in bytes: the common ground of the classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lumenqa.llm import words as W
from lumenqa.llm.templates import ALNUM, DIGIT, lowered

LETTER = ALNUM & ~DIGIT


@dataclass
class Spelled:
    """flat holds `` w1 w2 ... wn `` of all texts; words are the words in it, by text."""

    flat: np.ndarray
    words: W.Words


def spelled(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> Spelled:
    raw = W.split(data, offsets, LETTER, hashed)
    low = lowered(data)
    lengths = raw.ends - raw.starts
    starts = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
    flat = np.full(int(starts[-1]) if len(lengths) else 1, 0x20, np.uint8)
    before = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    within = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    flat[np.repeat(starts[:-1], lengths) + within] = low[np.repeat(raw.starts, lengths) + within]
    return Spelled(flat, W.Words(starts[:-1], starts[:-1] + lengths, raw.first, raw.hashes, flat))


def gram_hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n bytes of ``flat``, n up to 8: the bytes themselves, mixed."""
    out = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | flat[i : i + len(out)].astype(np.uint64)
    return W.mix(out + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
