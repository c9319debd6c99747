"""Toxicity by compression distance: one zstandard dictionary of ordinary and one of toxic text.

A window is WINDOW consecutive words of the lower-case text; every one of a text is compared. Its margin is its
compressed length under the ordinary dictionary less that under the toxic one. Both are used as raw content, padded
to one size, so that only their content tells them apart.

Training takes a bounded sample of labelled documents (``per_class`` of each class, in hash order of doc_id), whole
texts; a stretch of PIECE words that repeats in it, as in near copies, counts once. Two thirds of each class train:

1. The ordinary dictionary is trained on the ordinary texts. The toxic texts are dealt into FOLDS parts, each of
   which trains a dictionary.
2. Most of a toxic text is ordinary wording, so these dictionaries are distilled: of each part the windows that
   every other part's dictionary shortens by CUT bytes against the ordinary one are kept. What only one document
   says is not in the other parts' dictionaries; what toxic texts have in common is. Each part's windows train its
   next dictionary, for ROUNDS rounds; those of all parts train the toxic dictionary.
3. The ordinary windows that the toxic dictionary shortens train a further part of the ordinary one.

The last third calibrates: thresholds are quantiles of the margins of ordinary windows, and the largest margin, the
mean of the three largest, the mean of all, and the numbers and shares of windows at each threshold go through a
logistic regression in which toxic documents weigh TOXIC_SHARE of all.

A task compresses a window once and remembers its margin by two independent hashes of its bytes, at most REMEMBERED
windows at a time; what it remembers changes no score.

Repeated rows get equal scores. Rows with null or empty text, or text without letters, have no windows and get the
score of no evidence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenqa.llm import letters
from lumenqa.llm import words as W
from lumenqa.llm.workspace import bounded_batches, extended, text_bytes, text_slices

WINDOW, PIECE = 2, 8
FOLDS, ROUNDS, CUT = 3, 2, 3
ORDINARY_BYTES, HARD_BYTES, PART_BYTES, TOXIC_BYTES = 1 << 18, 1 << 15, 1 << 15, 1 << 13
#: Two bytes repeated: pays for the headers of a match, so that one more match shows in full.
CARRIER = b"\x01\x02" * 8
QUANTILES = (0.95, 0.99, 0.999, 0.9999)
FEATURES = 3 + 2 * len(QUANTILES)
TOXIC_SHARE = 0.25
#: Bytes of text whose windows are looked up at once.
SLICE = 2_000_000
#: Windows whose margins a task remembers, 19 bytes each; beyond that it forgets those it did not meet again.
REMEMBERED = 2_000_000
#: Windows compressed in one call.
CALL = 10_000


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    thresholds: np.ndarray
    weights: np.ndarray  # of the features, then the intercept
    scale: np.ndarray  # mean and deviation of each feature


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """Dictionary content of at most ``size`` bytes by zstandard's trainer; samples of no more than that are it themselves."""
    whole = b"".join(samples)
    if len(whole) <= size:
        return whole
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples for the trainer
        return whole[-size:]


def word_lists(texts: list[str]) -> list[list[bytes]]:
    out = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        out.append(bytes(letters.spelled(raw, np.array([0, len(raw)])).flat).split())
    return out


def pieces(docs: list[list[bytes]], seen: set[tuple[bytes, ...]]) -> list[list[bytes]]:
    """The documents' stretches of PIECE words that were not seen before."""
    out = []
    for words in docs:
        for at in range(0, len(words), PIECE):
            piece = tuple(words[at : at + PIECE])
            if piece not in seen:
                seen.add(piece)
                out.append(list(piece))
    return out


def spelled(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def windows(words: list[bytes]) -> list[bytes]:
    """Every window of a text; fewer words than WINDOW are one."""
    return [spelled(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))] if words else []


class Lengths:
    """Compressed lengths under one dictionary, padded in front to ``size`` bytes."""

    def __init__(self, content: bytes, size: int):
        rule = zstandard.ZstdCompressionParameters.from_level(
            3, source_size=64, dict_size=size, hash_log=20, chain_log=20, write_content_size=False, write_dict_id=False, write_checksum=False
        )
        known = zstandard.ZstdCompressionDict(bytes(size - len(content)) + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=rule)
        self.compressor = zstandard.ZstdCompressor(dict_data=known, compression_params=rule)

    def of(self, windows: list[bytes]) -> np.ndarray:
        out = np.zeros(len(windows), np.int64)
        for at in range(0, len(windows), CALL):
            out[at : at + CALL] = self.carried([CARRIER + w for w in windows[at : at + CALL]])
        return out

    def carried(self, windows: list[bytes] | zstandard.BufferWithSegments) -> np.ndarray:
        """The lengths of windows that have the carrier in front already."""
        found = self.compressor.multi_compress_to_buffer(windows, threads=1)  # one frame each
        return np.fromiter(map(len, found), np.int64, len(found))


def carried(eight: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> zstandard.BufferWithSegments:
    """Each window of places starts to ends with the carrier in front, packed; eight[i] holds the 8 bytes from place i on."""
    head = np.frombuffer(CARRIER, "<u8")
    blocks = ((ends - starts + 7) >> 3) + len(head)
    begins = np.cumsum(blocks) - blocks
    place = 8 * np.arange(int(blocks.sum())) + np.repeat(starts - 8 * (begins + len(head)), blocks)
    data = eight[np.maximum(place, 0)]
    data[begins[:, None] + np.arange(len(head))] = head
    segments = np.column_stack([8 * begins, ends - starts + len(CARRIER)]).astype("<u8")
    return zstandard.BufferWithSegments(data.tobytes(), segments.tobytes())


def distilled(parts: list[list[list[bytes]]], ordinary: bytes) -> bytes:
    """The toxic dictionary from the pieces of each part."""
    size = max(len(ordinary), PART_BYTES)
    plain = Lengths(ordinary, size)
    found = [[w for p in part for w in windows(p)] for part in parts]
    before = [plain.of(w) for w in found]
    content = [trained([spelled(p) for p in part], PART_BYTES, 16) for part in parts]
    kept = found
    for _ in range(ROUNDS):
        lengths = [Lengths(c, size) for c in content]
        kept = []
        for i, w in enumerate(found):
            margin = np.min([before[i] - x.of(w) for j, x in enumerate(lengths) if j != i], axis=0)
            kept.append([w[at] for at in np.flatnonzero(margin >= CUT)])
        content = [trained(k, TOXIC_BYTES, 16) if k else b"" for k in kept]
    return trained([w for k in kept for w in k], TOXIC_BYTES, 16)


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from two thirds of each class, thresholds and calibration from the rest."""
    (fit_toxic, held_toxic), (fit_ordinary, held_ordinary) = [(x[: 2 * len(x) // 3], x[2 * len(x) // 3 :]) for x in (word_lists(toxic), word_lists(ordinary))]
    seen: set[tuple[bytes, ...]] = set()
    parts = [pieces(fit_toxic[i::FOLDS], seen) for i in range(FOLDS)]
    plain = pieces(fit_ordinary, seen)
    good = trained([spelled(p) for p in plain], ORDINARY_BYTES, 32)
    bad = distilled(parts, good)
    size = max(len(good), len(bad))
    common = [w for p in plain for w in windows(p)]
    margin = Lengths(good, size).of(common) - Lengths(bad, size).of(common)
    if hard := [common[i] for i in np.flatnonzero(margin > 0)]:
        good += trained(hard, HARD_BYTES, 16)
    model = Model(good, bad, np.zeros(len(QUANTILES)), np.zeros(FEATURES + 1), np.array([[0.0], [1.0]]).repeat(FEATURES, 1))
    scorer = Scorer(model)
    margins = [scorer.margins(windows(w)) for w in (*held_toxic, *held_ordinary)]
    of_ordinary = np.concatenate([np.zeros(1, np.int64), *margins[len(held_toxic) :]])
    model.thresholds = np.maximum(np.quantile(of_ordinary, QUANTILES), 1)
    if len(held_toxic) and len(held_ordinary):
        x = np.array([scorer.features(m) for m in margins])
        y = np.repeat([1.0, 0.0], [len(held_toxic), len(held_ordinary)])
        model.scale = np.array([x.mean(axis=0), x.std(axis=0) + 1e-9])
        model.weights = logistic((x - model.scale[0]) / model.scale[1], y, np.where(y > 0, TOXIC_SHARE / len(held_toxic), (1 - TOXIC_SHARE) / len(held_ordinary)))
    return model


def logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last weight is the intercept."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (each * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w)), design.T @ (each * (p - y)) + ridge * np.append(w[:-1], 0))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    """The compressors of a model; made once a task."""

    def __init__(self, model: Model):
        self.model = model
        size = max(len(model.ordinary), len(model.toxic))
        self.plain, self.bad = Lengths(model.ordinary, size), Lengths(model.toxic, size)
        #: Two hashes of each window remembered, in order of the first, its margin, and whether it was met again.
        self.first, self.second, self.known, self.met = (np.zeros(0, kind) for kind in (np.uint64, np.uint64, np.int16, bool))

    def margins(self, windows: list[bytes]) -> np.ndarray:
        return self.plain.of(windows) - self.bad.of(windows)

    def features(self, margins: np.ndarray) -> np.ndarray:
        if not len(margins):
            return np.zeros(FEATURES)
        top = np.sort(margins)[::-1]
        n = np.array([(margins >= t).sum() for t in self.model.thresholds])
        return np.concatenate([[top[0], top[:3].mean(), margins.mean()], np.log1p(n), n / len(margins)])

    def score(self, features: np.ndarray) -> float:
        mean, deviation = self.model.scale
        return float(1 / (1 + np.exp(-np.clip((features - mean) / deviation @ self.model.weights[:-1] + self.model.weights[-1], -30, 30))))

    def margins_in(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The margin of each window flat[start:end]; those that are not remembered are compressed."""
        one, two = (W.byte_hashes(flat, starts, ends, key) for key in W.WORD_KEYS)
        order = np.argsort(one)
        one, two = one[order], two[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        one, two, each = one[fresh], two[fresh], order[fresh]
        place = np.searchsorted(self.first, one)
        place[place == len(self.first)] = 0
        old = (self.first[place] == one) & (self.second[place] == two) if len(self.first) else np.zeros(len(one), bool)
        margins = np.zeros(len(one), np.int64)
        margins[old] = self.known[place[old]]
        self.met[place[old]] = True
        new = np.flatnonzero(~old)
        eight = np.ndarray(len(flat) + 1, "<u8", np.concatenate([flat, np.zeros(8, np.uint8)]), strides=(1,))
        for at in range(0, len(new), CALL):
            part = new[at : at + CALL]
            packed = carried(eight, starts[each[part]], ends[each[part]])
            margins[part] = self.plain.carried(packed) - self.bad.carried(packed)
        self.remember(one[new], two[new], margins[new])
        return margins[number]

    def remember(self, one: np.ndarray, two: np.ndarray, margins: np.ndarray) -> None:
        """Keep the margins of windows by their hashes, given in order of the first; one of more than 16 bits is not kept."""
        if len(self.first) + len(one) > REMEMBERED:
            keep = self.met if self.met.sum() <= REMEMBERED // 2 else np.zeros(len(self.met), bool)
            self.first, self.second, self.known = self.first[keep], self.second[keep], self.known[keep]
            self.met = np.zeros(len(self.first), bool)
        fits = np.flatnonzero(np.abs(margins) < 1 << 15)[: max(0, REMEMBERED - len(self.first))]
        place = np.searchsorted(self.first, one[fits])
        self.first, self.second = np.insert(self.first, place, one[fits]), np.insert(self.second, place, two[fits])
        self.known, self.met = np.insert(self.known, place, margins[fits]), np.insert(self.met, place, False)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each text."""
        text = letters.spelled(data, offsets, hashed=False)
        first, starts, ends = text.words.first, text.words.starts, text.words.ends
        words = np.diff(first)
        counts = np.where(words > 0, np.maximum(words - WINDOW + 1, 1), 0)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(first[:-1], counts) + np.arange(cuts[-1]) - np.repeat(cuts[:-1], counts)
        last = np.minimum(at + WINDOW, np.repeat(first[1:], counts)) - 1
        margins = self.margins_in(text.flat, starts[at] - 1, ends[last] + 1)  # with the spaces around
        return np.array([self.score(self.features(margins[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])


def held_out(doc_id: Column, folds: int = 3, out: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the fold that trains nothing; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == out


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2400) -> Model:
    """Train on at most ``per_class`` labelled documents of each class outside the held-out fold.

    A document labelled twice is toxic if any label says so; null labels say nothing.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.checkpoint()
    texts = {}
    for label in (True, False):
        chosen = known.where((F.col("toxic") > 0) == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id")
        found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").where("text is not null")
        rows = found.groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # at most per_class texts
        texts[label] = [r["text"] for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"])))]
    return train(texts[True], texts[False])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its rows and columns and ``tox_score`` in 0..1; a column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("tox_score").withColumn("text", F.col("text").cast("string"))
    names = [*docs.columns, "tox_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.scores(*text_bytes(part.column("text"))))], names=names)

    return docs.mapInArrow(run, extended(docs, tox_score="double"))
