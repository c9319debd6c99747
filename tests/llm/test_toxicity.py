import random
import zlib

import numpy as np
import pytest

from lumenqa.llm import letters, toxicity


def auc(score, y):
    pos, neg = [s for s, t in zip(score, y) if t], [s for s, t in zip(score, y) if not t]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(docs, labels)
    rows = toxicity.scored(docs.join(labels, "doc_id"), model).select("doc_id", "toxic", "tox_score").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    y, s = [r.toxic for r in held], [r.tox_score for r in held]
    assert auc(s, y) > 0.85
    said = [t for t, x in zip(y, s) if x >= 0.7]
    assert sum(said) / len(said) > 0.85


def test_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeiost") for _ in range(rng.randint(2, 6)))
    rows = [(i, " ".join(word() for _ in range(30)) + (" vilewordhere " if i % 2 else " "), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100, None), (101, ""), (None, "x"), (102, "12 34"), (103, "é" * 400_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    out = {r.doc_id: r.tox_score for r in toxicity.scored(docs, model).collect()}
    assert len(out) == 65 and all(0 <= v <= 1 for v in out.values())
    assert out[100] == out[101] == out[102]
    assert np.mean([out[i] for i in range(1, 60, 2)]) > np.mean([out[i] for i in range(0, 60, 2)])
    none = toxicity.learn(docs, labels.limit(0))
    assert toxicity.scored(docs.limit(0), none).collect() == []
    assert set(toxicity.scored(docs, none).columns) == {"doc_id", "text", "tox_score"}


@pytest.mark.parametrize("text", ["", "a", "Ünïcode Wörter", "tab\tand\nline"])
def test_margins_of_any_text(text):
    model = toxicity.train(["bad bad words"] * 5, ["good fine words"] * 5)
    raw = np.frombuffer(text.encode(), np.uint8)
    assert 0 <= toxicity.Scorer(model).scores(raw, np.array([0, len(raw)]))[0] <= 1


def by_hand(model, text):
    """Every window of a text, compressed one by one."""
    words = bytes(letters.spelled(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])).flat).split()
    scorer = toxicity.Scorer(model)
    margins = []
    for i in range(max(1, len(words) - toxicity.WINDOW + 1)) if words else []:
        w = b" " + b" ".join(words[i : i + toxicity.WINDOW]) + b" "
        margins.append(len(scorer.plain.compressor.compress(toxicity.CARRIER + w)) - len(scorer.bad.compressor.compress(toxicity.CARRIER + w)))
    return scorer.score(scorer.features(np.array(margins)))


def test_every_window_is_compared():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ka", "to", "ri", "me", "su", "no", "é"]) for _ in range(rng.randint(1, 4)))
    plain = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    toxic = [t + " vilewordhere nastyone " + word() for t in plain[:40]]
    model = toxicity.train(toxic, plain)
    texts = [*plain, *toxic, "", "12 34", "a", "Ünïcode Wörter", "tab\tand\nline", "vilewordhere"]
    raw = [t.encode() for t in texts]
    got = toxicity.Scorer(model).scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert np.allclose(got, [by_hand(model, t) for t in texts], atol=1e-12)
    assert got[len(plain) : len(plain) + 40].mean() > got[: len(plain)].mean()


def test_repeated_rows_and_a_clashing_column(spark):
    model = toxicity.train(["bad vile words here"] * 9, ["good fine words here"] * 9)
    docs = spark.createDataFrame([(1, "bad vile words", "x"), (1, "bad vile words", "x"), (2, "fine", None)], "doc_id long, text string, tox_score string")
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == 3 and rows[0].tox_score == rows[1].tox_score and isinstance(rows[2].tox_score, float)


class Counted:
    """A compressor that notes how many frames it made."""

    def __init__(self, compressor):
        self.compressor, self.frames = compressor, 0

    def compress(self, window):
        return self.compressor.compress(window)

    def multi_compress_to_buffer(self, windows, **options):
        self.frames += len(windows)
        return self.compressor.multi_compress_to_buffer(windows, **options)


def slices_of_words(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "to", "ri", "é"]) for _ in range(rng.choice([1, 1, 1, 2, 2, 20])))
    return [[" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(15)] for _ in range(8)]


def score_slices(scorer, slices):
    out = []
    for texts in slices:
        raw = [t.encode() for t in texts]
        out += scorer.scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])).tolist()
    return out


def test_a_window_is_compressed_once_a_task():
    slices = slices_of_words(3)
    model = toxicity.train([t + " vilewordhere nastyone" for t in slices[0]], slices[1])
    scorer = toxicity.Scorer(model)
    scorer.plain.compressor, scorer.bad.compressor = plain, bad = Counted(scorer.plain.compressor), Counted(scorer.bad.compressor)
    got = score_slices(scorer, slices)
    windows = [w for texts in slices for words in toxicity.word_lists(texts) for w in toxicity.windows(words)]
    assert plain.frames == bad.frames == len(set(windows)) < len(windows)
    assert np.allclose(got, [by_hand(model, t) for texts in slices for t in texts], atol=1e-12)


@pytest.mark.parametrize("remembered", [0, 1, 50, 400])
def test_scores_do_not_depend_on_what_is_remembered(monkeypatch, remembered):
    slices = slices_of_words(4)
    model = toxicity.train([t + " vilewordhere nastyone" for t in slices[0]], slices[1])
    expected = score_slices(toxicity.Scorer(model), slices)
    monkeypatch.setattr(toxicity, "REMEMBERED", remembered)
    scorer = toxicity.Scorer(model)
    assert score_slices(scorer, slices) == expected and len(scorer.first) <= remembered
