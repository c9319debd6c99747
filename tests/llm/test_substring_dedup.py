import hashlib
import random
import re

import pytest

from lumenqa.llm import substring_dedup
from lumenqa.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    docs = {(d is None, d, t or "") for d, t in rows}
    seen, first = {}, {}
    order = sorted(docs, key=lambda r: (r[0], r[1] or 0, r[2]))
    for key in order:
        w = WORD.findall(key[2])
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            win = tuple(w[i : i + size])
            if win in seen:
                gone[i : i + size] = [True] * size
            else:
                seen[win] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        first[key] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted((str(d), *first[(d is None, d, t or "")]) for d, t in rows)


def run(spark, rows, size, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup.remove_repeats(df, Workspace(spark), size, **options).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out)


@pytest.mark.parametrize("seed,size", [(1, 5), (2, 8), (3, 20)])
def test_equals_brute_force(spark, seed, size):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    passages = [[word() for _ in range(size + rng.randint(0, 9))] for _ in range(6)]
    rows = []
    for d in range(40):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(0, 40))]
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "é\xa0ü " * 30), (105, "a " * 60)]
    assert run(spark, rows, size) == brute(rows, size)
    assert run(spark, rows, size, max_cells=0) == brute(rows, size)  # the sketch dealt by cells


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (None, text), (2, "x" * 3_000_000 + " " + text), (3, " \n")]
    assert run(spark, rows, 20) == brute(rows, 20)
    empty = spark.createDataFrame([], "doc_id long, text string, n_words string, todo int")
    assert substring_dedup.remove_repeats(empty, Workspace(spark)).collect() == []
    more = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, lang string, todo int")
    row = substring_dedup.remove_repeats(more, Workspace(spark)).first()
    assert (row.lang, row.n_words, row.n_removed, row.kept_text) == ("x", 2, 0, "a b")


def test_thue_morse_words_differ(spark):
    """Hashes of such words by polynomials modulo 2^64 collide."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    rows = [(1, f"{word} " * 20), (2, f"{word.translate(str.maketrans('ab', 'ba'))} " * 20)]
    assert run(spark, rows, 20) == brute(rows, 20)
    assert [r[2] for r in run(spark, rows, 20)] == [0, 0]


def test_results_can_be_chained(spark):
    text = " ".join(f"w{i}" for i in range(50))
    out = substring_dedup.remove_repeats(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), Workspace(spark)).select("doc_id", "n_removed")
    import gc

    gc.collect()
    assert out.where("doc_id > 1").limit(3).first().n_removed == 50 and out.join(out, "doc_id").count() == 2
