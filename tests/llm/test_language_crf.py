import itertools
import zlib

import numpy as np

from lumenqa.llm import language_crf as crf


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    scores, switch = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    start, size = np.array([0, 4]), np.array([4, 3])
    p, pairs = crf.marginals(scores, start, size, switch)
    want, want_pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for s, n in zip(start, size):
        z, m, q = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(scores[s + t, y] for t, y in enumerate(path)) + sum(switch[a, b] for a, b in zip(path, path[1:])))
            z += w
            for t, y in enumerate(path):
                m[t, y] += w
            for a, b in zip(path, path[1:]):
                q[a, b] += w
        want[s : s + n] = m / z
        want_pairs += q / z
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_chains_are_whole_documents(monkeypatch):
    """Blocks solved side by side give what one pass over each document gives, and enumeration on short ones."""
    rng = np.random.default_rng(4)
    counts = np.array([3, 0, 7, 1, 130, 6, 0])
    scores, switch = rng.normal(size=(counts.sum(), 3)) * 3, rng.normal(size=(3, 3))
    start, size = crf.chains(counts, 10_000)
    whole, _ = crf.marginals(scores, start, size, switch)
    for length in (2, 3, 128):
        monkeypatch.setattr(crf, "CHAIN", length)
        assert np.allclose(crf.chain_marginals(scores, counts, switch), whole, atol=1e-12)
    monkeypatch.setattr(crf, "MATRIX_LANGUAGES", 2)
    assert np.allclose(crf.chain_marginals(scores, counts, switch), whole, atol=1e-12)


def test_scores_do_not_hang_on_neighbours():
    texts = ["the of and to in that is was " * 40, "le la des les une est dans que " * 30, "der die und das ist nicht ein " * 50, ""]
    model = crf.learn_weights(texts[:3], [0, 1, 2], ["en", "fr", "de"])

    def said(some):
        raw = [t.encode() for t in some]
        names, score = crf.decide(model, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
        return list(zip(names, score.tolist()))

    assert said(texts) == [x for t in texts for x in said([t])]


def test_every_language_can_be_predicted(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 6, f"l{i % 90:02d}") for i in range(720)]
    rows = [(i, f"{chr(97 + i % 90 % 26) * 3}{chr(97 + i % 90 // 26) * 3} " * 6, lang) for i, _, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf.learn(docs)
    assert len(model.languages) == 90
    out = crf.identified(docs, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.9


def test_held_out_accuracy_and_code_switching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = crf.learn(docs)
    rows = crf.identified(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    by = {}
    for r in held:
        if r.lang == r.lang_pred and r.lang_score > 0.95:
            by.setdefault(r.lang_pred, r.text)
    a, b = list(by.items())[:2]
    mixed = spark.createDataFrame([(1, " ".join(a[1].split()[:30]) + " " + " ".join(b[1].split()[:30]))], "doc_id long, text string")
    words = sorted(crf.word_labels(mixed, model).collect(), key=lambda r: r.place)
    third = len(words) // 3
    assert np.mean([w.language == a[0] for w in words[:third]]) > 0.8
    assert np.mean([w.language == b[0] for w in words[-third:]]) > 0.8


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !", None), (4, "the of and", "en"), (4, "the of and", "en"), (None, "le la des", "fr"), (5, "λόγος", None), (6, "a" * 700_000, "en"), (7, "the of " * 5, "en"), (8, "le des " * 5, "fr"), (9, "€ …", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf.learn(docs)
    out = crf.identified(docs.withColumn("lang_pred", docs.lang), model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[k].lang_pred == "und" and by[k].lang_score == 0 for k in (1, 2, 3, 9))
    assert by[5].lang_pred in model.languages and by[4].lang_pred == "en"
    empty = crf.learn(docs.limit(0))
    assert {r.lang_pred for r in crf.identified(docs, empty).collect()} == {"und"}
    assert crf.identified(docs.limit(0), model).collect() == []
