"""Canonical templates of texts: literal words, and typed slots for numbers, units and names.

Tokens are runs of ASCII letters, digits and non-ASCII bytes; a dot or comma between two digits belongs to
the number. A token that begins with a digit is a number; a unit word right after a number is a unit; a
capitalised word (capital, then no further ASCII capital) inside a sentence is a name. All else is a literal, lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lumenqa.llm import words as W

U = np.uint64
LITERAL, NUMBER, UNIT, NAME = range(4)

UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces "
    "ml l liter liters litre litres meter meters metre metres second seconds sec minute minutes min hour hours day days week weeks "
    "month months year years percent degree degrees dollar dollars cent cents euro euros"
).split()

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?:;\n|"]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, in UTF-8 bytes; other letters as they are."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[latin] += 32
    return low


@dataclass
class Templates:
    """Tokens of a run of texts: first[d]:first[d + 1] are text d's; keys are template hashes, values those of the words."""

    first: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    kinds: np.ndarray


def unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.unique(W.split(data, np.array([0, len(data)])).hashes)


def slot_keys() -> np.ndarray:
    """The template hash of each kind of slot; that of LITERAL stands for nothing."""
    return W.mix(np.arange(1, 5, dtype=U) * U(0xA0761D6478BD642F))


def canonical(data: np.ndarray, offsets: np.ndarray) -> Templates:
    low = lowered(data)
    marks = data.copy()
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & DIGIT[data[:-2]] & DIGIT[data[2:]]
    marks = np.where(ALNUM[data] | inner, 1, 0).astype(np.uint8)
    table = np.array([False, True] + [False] * 254)
    shape = W.split(marks, offsets, table)
    starts, ends = shape.starts, shape.ends
    values = W.byte_hashes(low, starts, ends)
    kinds = np.zeros(len(starts), np.int8)
    if len(starts):
        number = DIGIT[data[starts]]
        kinds[number] = NUMBER
        same_text = np.ones(len(starts), bool)
        same_text[shape.first[:-1][np.diff(shape.first) > 0]] = False
        after = np.zeros(len(starts), bool)
        after[1:] = number[:-1] & same_text[1:]
        kinds[after & np.isin(values, unit_hashes()) & ~number] = UNIT
        stops = np.concatenate([[0], np.cumsum(STOPS[data])])
        gap = np.zeros(len(starts), np.int64)
        gap[1:] = stops[starts[1:]] - stops[ends[:-1]]
        capital = low[starts] != data[starts]
        latin = (data[starts] == 0xC3) & (ends - starts > 1)
        capital |= latin & (low[np.minimum(starts + 1, len(data) - 1)] != data[np.minimum(starts + 1, len(data) - 1)])
        capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        only = capitals[ends] - capitals[starts] - ((data[starts] >= 65) & (data[starts] <= 90)) == 0
        kinds[capital & only & same_text & (gap == 0) & (ends - starts > 1) & (kinds == 0)] = NAME
    return Templates(shape.first, np.where(kinds == LITERAL, values, slot_keys()[kinds]), values, kinds)
