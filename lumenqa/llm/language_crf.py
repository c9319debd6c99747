"""Word-level language identification of code-switched text by a linear-chain conditional random field.

A document's words are one chain. For speed its blocks of CHAIN words are solved side by side: the product of a
block's transitions carries the forward and backward messages over it, so cuts change nothing but the order of
arithmetic. With more than MATRIX_LANGUAGES languages the products cost more than they save, and a chain is one block.
A word's score for a
language is the sum of learned weights of its affixes (first and last one to four bytes), its byte n-grams
with word boundaries, and a lexicon feature (the whole word, if training saw it often enough); learned
transitions say how likely a switch is. Forward-backward gives each word's distribution over languages; their sum
over the document decides its language, and the mean probability of that language is the score.

Training is maximum likelihood (AdaGrad) on a bounded sample: ``per_language`` documents of each language in
hash order, with the document's language as the label of its words, spliced at random into chains that switch
between documents, so that transitions are learned from code-switched text. Features are hashed to BUCKETS weights
a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenqa.llm import letters
from lumenqa.llm import words as W
from lumenqa.llm.workspace import bounded_batches, extended, text_bytes, text_slices

BUCKETS = 1 << 17
CHAIN = 128
LEXICON_COUNT = 3
MATRIX_LANGUAGES = 16
U = np.uint64


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS + 1, languages; the last row stays nil
    switch: np.ndarray  # languages, languages: log-scores of label to next label
    lexicon: np.ndarray  # sorted hashes of known words


def feature_ids(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words one after another, number of each word's features) for words spelled as `` w `` in flat."""
    n = len(starts)
    size = ends - starts
    parts, owners = [], []
    for k in (2, 3, 4):  # n-grams within `` w ``
        grams = letters.gram_hashes(flat, k)
        count = np.maximum(size + 2 - k + 1, 0)
        owner = np.repeat(np.arange(n), count)
        first = np.cumsum(count) - count
        parts.append(grams[np.repeat(starts - 1 - first, count) + np.arange(len(owner))])
        owners.append(owner)
    for k in (1, 2, 3, 4):  # affixes
        grams = letters.gram_hashes(flat, k)
        long = np.flatnonzero(size >= k)
        parts += [W.mix(grams[starts[long]] + U(101)), W.mix(grams[ends[long] - k] + U(202))]
        owners += [long, long]
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == hashes)
        parts.append(W.mix(hashes[known] + U(303)))
        owners.append(known)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate(parts) & U(BUCKETS - 1)).astype(np.int64)[order]
    return ids, np.bincount(owner, minlength=n)


def word_scores(model: Model, text: letters.Spelled) -> np.ndarray:
    """Emission scores of every word; equal words are scored once."""
    words = text.words
    _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    ids, counts = feature_ids(text.flat, words.starts[first], words.ends[first], words.hashes[first], model.lexicon)
    ends = np.cumsum(counts)
    return np.add.reduceat(model.weights[ids], ends - counts, axis=0)[back] if len(ids) else np.zeros((0, len(model.languages)))


def chains(counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, length) of each chain, for documents of ``counts`` words."""
    per = -(-counts // length)
    doc = np.repeat(np.arange(len(counts)), per)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(counts) - counts, per) + part * length
    return start, np.minimum(counts[doc] - part * length, length)


def marginals(scores: np.ndarray, start: np.ndarray, size: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals by forward-backward, and for training the expected label pairs; chains run side by side."""
    n, k = len(start), scores.shape[1]
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    longest = int(size[0]) if n else 0
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]  # chains longer than t
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    a = np.exp(switch)
    alpha, beta = np.zeros_like(scores), np.ones_like(scores)
    for t in range(longest):
        at = start[: live[t]] + t
        x = e[at] * (alpha[at - 1] @ a) if t else e[at] / k
        alpha[at] = x / x.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(longest - 1, 0, -1):
        at = start[: live[t]] + t
        x = e[at] * beta[at]
        y = x @ a.T
        scale = (alpha[at - 1] * y).sum(axis=1, keepdims=True)
        pairs += (alpha[at - 1] / scale).T @ x * a
        beta[at - 1] = y / y.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300), pairs


def chain_marginals(scores: np.ndarray, counts: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """Word marginals of whole documents of ``counts`` words by forward-backward over blocks."""
    n, k = scores.shape
    if not n or not k:
        return np.zeros((n, k))
    length = CHAIN if k <= MATRIX_LANGUAGES else int(counts.max())
    start, size = chains(counts, length)
    blocks = -(-counts // length)
    first = np.cumsum(blocks) - blocks  # the first block of each document
    opens = np.zeros(len(start), bool)
    opens[first[blocks > 0]] = True
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(switch - switch.max())
    order = np.argsort(-size, kind="stable")
    live = [int(np.searchsorted(-size[order], -t, side="left")) for t in range(int(size.max()))]  # blocks longer than t, in order
    scaled = lambda x, axis: x / np.maximum(x.sum(axis=axis, keepdims=True), 1e-300)
    into, after = np.full((len(start), k), 1 / k), np.ones((len(start), k))
    if int(blocks.max()) > 1:
        product = np.broadcast_to(np.eye(k), (len(start), k, k)).copy()
        for t, m in enumerate(live):
            at = order[:m]
            moved = product[at] @ a
            if t == 0:
                moved[opens[at]] = product[at][opens[at]]
            product[at] = scaled(moved * e[start[at] + t][:, None, :], (1, 2))
        for j in range(1, int(blocks.max())):
            b = first[blocks > j] + j
            into[b] = scaled(np.einsum("bi,bij->bj", into[b - 1], product[b - 1]), 1)
        for j in range(int(blocks.max()) - 1, 0, -1):
            b = first[blocks > j] + j
            after[b - 1] = scaled(np.einsum("bij,bj->bi", product[b], after[b]), 1)
    alpha, beta = np.empty_like(scores), np.empty_like(scores)
    for t, m in enumerate(live):
        at = order[:m]
        if t == 0:
            came = np.where(opens[at][:, None], into[at], into[at] @ a)
        else:
            came = alpha[start[at] + t - 1] @ a
        alpha[start[at] + t] = scaled(came * e[start[at] + t], 1)
    beta[start + size - 1] = after
    for t in range(len(live) - 1, 0, -1):
        at = start[order[: live[t]]] + t
        beta[at - 1] = scaled((e[at] * beta[at]) @ a.T, 1)
    return scaled(alpha * beta, 1)


def learn_weights(texts: list[str], labels: list[int], languages: list[str], rounds: int = 4, seed: int = 11) -> Model:
    """AdaGrad on spliced chains. Deterministic for a given sample."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    text = letters.spelled(data, offsets)
    words = text.words
    kinds, first, back, counts = np.unique(words.hashes, return_index=True, return_inverse=True, return_counts=True)
    model = Model(languages, np.zeros((BUCKETS + 1, k)), np.zeros((k, k)), kinds[counts >= LEXICON_COUNT])
    if not len(kinds):
        return model
    ids, sizes = feature_ids(text.flat, words.starts[first], words.ends[first], words.hashes[first], model.lexicon)
    at = np.cumsum(sizes) - sizes
    gold = np.asarray(labels)[words.doc_of()]
    # stretches of 4 to 40 words, shuffled, then chained: a chain switches where its stretches do
    cuts = np.unique(np.concatenate([words.first, np.cumsum(rng.integers(4, 41, size=len(gold) // 4 + 1))]))
    cuts = cuts[cuts <= len(gold)]
    stretches = [np.arange(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    squares, switch_squares = np.full((BUCKETS + 1, k), 1e-2), np.full((k, k), 1.0)
    for _ in range(rounds):
        rng.shuffle(stretches)
        sequence = np.concatenate(stretches)
        for lo in range(0, len(sequence), 64 * 256):
            part = sequence[lo : lo + 64 * 256]
            kind, inner = np.unique(back[part], return_inverse=True)
            own = sizes[kind]
            spread = np.repeat(at[kind] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            feats = ids[spread]
            ends = np.cumsum(own)
            score = np.add.reduceat(model.weights[feats], ends - own, axis=0)[inner]
            start, size = chains(np.array([len(part)]), 64)
            p, pairs = marginals(score, start, size, model.switch)
            p[np.arange(len(part)), gold[part]] -= 1
            true = np.zeros((k, k))
            inside = np.setdiff1d(np.arange(1, len(part)), start)
            np.add.at(true, (gold[part][inside - 1], gold[part][inside]), 1)
            per_kind = np.zeros((len(kind), k))
            np.add.at(per_kind, inner, p)
            touched, slot = np.unique(feats, return_inverse=True)
            grad = np.zeros((len(touched), k))
            np.add.at(grad, slot, np.repeat(per_kind, own, axis=0))
            grad = grad / len(start) + 1e-4 * model.weights[touched]
            squares[touched] += grad**2
            model.weights[touched] -= 0.1 * grad / np.sqrt(squares[touched])
            turn = (pairs - true) / len(start)
            switch_squares += turn**2
            model.switch -= 0.1 * turn / np.sqrt(switch_squares)
    return model


def label_words(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[letters.Spelled, np.ndarray]:
    """The words of texts and their distributions over the languages."""
    text = letters.spelled(data, offsets)
    if not model.languages:
        return text, np.zeros((len(text.words.starts), 0))
    return text, chain_marginals(word_scores(model, text), np.diff(text.words.first), model.switch)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for d in np.flatnonzero(~out):
        out[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


def decide(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; ``und`` and 0 without a letter."""
    text, p = label_words(model, data, offsets)
    first, counts = text.words.first, np.diff(text.words.first)
    share = np.zeros((len(counts), len(model.languages)))
    if len(p):  # each document's sum by itself, so its score does not hang on its neighbours
        share[counts > 0] = np.add.reduceat(p, first[:-1][counts > 0], axis=0) / counts[counts > 0, None]
    share = np.round(share, 9)
    known = has_letter(data, offsets) & (counts > 0)
    best = share.argmax(axis=1) if model.languages else np.zeros(len(known), int)
    names = [model.languages[b] if ok and model.languages else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
    return names, np.where(known, share.max(axis=1, initial=0.0), 0.0).clip(0, 1)


def held_out(doc_id: Column, folds: int = 4, out: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the fold that trains nothing; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == out


def learn(docs: DataFrame, per_language: int = 300) -> Model:
    """Train on at most ``per_language`` documents of every language outside the held-out fold.

    The model has BUCKETS weights a language, so memory and time grow with the number of languages, and none is left out.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    chosen = ids.select("doc_id", "lang").distinct()  # at most per_language rows a language
    rows = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"]).where("text is not null")
    found = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["lang"], str(r["doc_id"])))
    return learn_weights([r["text"] for r in found], [languages.index(r["lang"]) for r in found], languages)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its rows and columns, lang_pred and lang_score; columns of these names are replaced.

    Null, empty and letterless texts are ``und`` with score 0. Ties take the first language by name. Without any
    training text every document is ``und``.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score").withColumn("text", F.col("text").cast("string"))
    names = [*docs.columns, "lang_pred", "lang_score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages weights: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                said, score = decide(shared.value, *text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string()), pa.array(score, pa.float64())], names=names)

    return docs.mapInArrow(run, extended(docs, lang_pred="string", lang_score="double"))


def word_labels(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each word of each document: doc_id, place, word (lower case), language, probability."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                text, p = label_words(shared.value, *text_bytes(part.column("text")))
                doc, raw = text.words.doc_of(), text.flat.tobytes()
                best = p.argmax(axis=1) if p.size else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)), pa.array((np.arange(len(doc)) - text.words.first[doc]).astype(np.int32)),
                        pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(text.words.starts.tolist(), text.words.ends.tolist(), strict=True)], pa.string()),
                        pa.array([shared.value.languages[b] if p.size else "und" for b in best.tolist()], pa.string()), pa.array(p.max(axis=1, initial=0) if p.size else np.zeros(len(doc))),
                    ],
                    names=["doc_id", "place", "word", "language", "probability"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, place int, word string, language string, probability double")
