import random
import re

import numpy as np
import pytest

from lumenqa.llm import ngram_join
from lumenqa.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (1 << 62)), d)
    return sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.choice([1, 2, 3, 25])):
            copy = list(text)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
        if base % 3 == 0:
            rows.append((len(rows), rows[-1][1]))
    rows += [(len(rows), "one two"), (len(rows) + 1, "one two"), (len(rows) + 2, ""), (len(rows) + 3, None), (len(rows) + 4, " ")]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 1000), (2, 20)])
def test_classes_and_links_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 8)
    rows = corpus(seed)
    work = Workspace(spark)
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), work).collect()
    work.drop()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == brute(rows)


def test_one_of_each_and_edges(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = [(5, text, "en"), (3, text, "de"), (3, text, "de"), (None, text, None), (7, None, "a"), (7, None, "a"), (8, "", "b")]
    work = Workspace(spark)
    left = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, key string"), work).collect()
    assert sorted((r.doc_id, r.key) for r in left) == [(3, "de"), (7, "a"), (7, "a"), (8, "b")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(none, work).collect() == []
    work.drop()


def test_pruning_keeps_the_threshold():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and all(m < 0.8 * n for m, n in zip(least, ngram_join.STEPS, strict=True))


def test_blocks_by_bytes_and_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", 20_000)
    rng = random.Random(5)
    text = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for d in range(260):
        copy = list(text)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(500)}"
        rows.append((d, " ".join(copy)))
    work = Workspace(spark)
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), work)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out.collect()) == brute(rows)
    assert out.where("doc_id >= 0").limit(3).count() == 3 and out.join(out, "doc_id").count() == len(rows)
    work.drop()


def test_shared_counts_equal_brute_force():
    rng = np.random.default_rng(3)
    for g, h in [(1, 1), (2, 3), (40, 30)]:
        left, right = ([np.unique(rng.integers(0, 200, size=rng.integers(1, 90))).astype(np.uint64) for _ in range(n)] for n in (g, h))
        got = ngram_join.shared_counts(left, right)
        assert (got == [[len(np.intersect1d(a, b)) for b in right] for a in left]).all()


def test_sets_that_share_a_node_are_told_apart(spark):
    rows = [(1, 7, 1), (2, 7, 2), (3, 7, 2), (4, 9, 5), (5, None, None)]
    got = {r.d: r.node for r in ngram_join.told_apart(spark.createDataFrame(rows, "d long, node long, node2 long")).collect()}
    assert got[1] == 7 and got[4] == 9 and got[5] is None and got[2] == got[3] not in (7, 9)


def test_very_long_texts(spark):
    rng = random.Random(8)
    text = [f"w{rng.randrange(100_000)}" for _ in range(150_000)]
    near = list(text)
    near[77_777] = "other"
    rows = [(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(text[:60_000])), (4, "x" * 2_000_000)]
    work = Workspace(spark)
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), work).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]
    work.drop()
