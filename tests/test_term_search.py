import random

import duckdb
import numpy as np
import pytest

from lumenqa.operators import term_search as S
from lumenqa.plans import views as V
from lumenqa.plans.registry import QUERIES

DOCS, ITEMS = "doc_id long, text string, lang string, source string", "item_id long, text string"


def written(spark):
    """Bytes that all tasks so far have written for shuffles."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Passages that share terms with every query."""
    rng, folder = random.Random(3), str(tmp_path_factory.mktemp("large"))
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(4000)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, " ".join(texts[i * 50].split()[5:35])) for i in range(60)], ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", ["a12_hits_per_run", "w2_running_hits", "a25_hit_ratios", "a11_concordance", "f17_wide_by_run", "f9_f11_agreement_filters"])
def test_shuffles_less_than_a_row_for_each_pair(spark, large, name):
    before = written(spark)
    rows = QUERIES[name](spark, large).collect()
    assert rows and written(spark) - before < 4000 * 60 * 8  # 4000 passages, 60 queries that share a term with each


@pytest.fixture(scope="module")
def repeated(spark, large, tmp_path_factory):
    """The same passages, each id twice."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    twice = spark.read.parquet(f"{large}/documents.parquet").selectExpr("doc_id div 2 AS doc_id", "text", "lang", "source")
    twice.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{large}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", ["w2_running_hits", "a11_concordance", "a25_hit_ratios", "f17_wide_by_run", "f9_f11_agreement_filters"])
def test_repeated_ids_shuffle_little(spark, repeated, name):
    before = written(spark)
    rows = QUERIES[name](spark, repeated).collect()
    assert rows and written(spark) - before < 4000 * 60 * 20  # 4000 passages, 60 queries that share terms with each


def odd():
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(40)] + ["İx", "É", "--", "T1", "Kg"]
    texts = [None, "", "...", "t1", " ".join(f"t{i % 40}" for i in range(1024)), "x" * 3000]
    texts += [rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(1, 60))) for _ in range(300)]
    docs = [(i, t, "en", "s") for i, t in enumerate([*texts, *texts[100:160]])]
    items = [(0, None), (1, ""), (2, "t1"), (3, "t2 t3"), (4, "nowhere to be found"), (5, "--"), *((i, " ".join((texts[i] or "").split(" ")[1:6])) for i in range(6, 30))]
    return docs, items


@pytest.mark.parametrize("bound", [8 << 20, 150])
def test_runs_and_relevance_equal_sql(spark, monkeypatch, bound):
    docs, items = odd()
    monkeypatch.setattr(S, "QUERY_BYTES", bound)  # one share, and several
    monkeypatch.setattr(S, "CELLS", 500)
    assert_equal_sql(spark, docs, items)


def test_repeated_and_missing_ids(spark):
    docs, items = odd()
    again = [(None if d == 50 else d - 206 if d >= 306 else d, *x) for d, *x in docs]  # copies have the id of the first
    assert_equal_sql(spark, again, [*items, (7, "t5 t6 t7"), (None, "t5 t6 t7")])


def assert_equal_sql(spark, docs, items):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [d[:2] for d in docs])
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    table = {"documents": spark.createDataFrame(docs, DOCS).repartition(5), "benchmark": spark.createDataFrame(items, ITEMS)}.get
    want = con.execute(f"WITH {V.RUN_QRELS} SELECT * FROM qrels").fetchall()
    assert sorted(map(str, map(tuple, V.contained(table).collect()))) == sorted(map(str, want))
    want = con.execute(f"WITH {V.RUNS} SELECT run, qid, docid, rank, score FROM runs").fetchall()
    exact = lambda rows: sorted(str((*r[:4], format(r[4], ".9f"))) for r in rows)
    assert exact(V.runs(table).collect()) == exact(want)


def test_repeated_ids_of_several_sizes(spark):
    docs, items = odd()
    again = [(None if d % 9 == 0 else d % 120, *x) for d, *x in docs]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [d[:2] for d in again])
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    table = {"documents": spark.createDataFrame(again, DOCS).repartition(5), "benchmark": spark.createDataFrame(items, ITEMS)}.get
    want = con.execute(f"WITH {V.RUNS} SELECT run, qid, docid, rank, score FROM runs").fetchall()
    exact = lambda rows: sorted(str((*r[:4], format(r[4], ".9f"))) for r in rows if r[0] != "run3")  # noqa: E731  run3 divides by any of the sizes
    assert exact(V.runs(table).collect()) == exact(want)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_passages_dealt_by_id_do_not_hang_on_batches(monkeypatch, rows):
    import pyarrow as pa

    rng = random.Random(9)
    words = [f"t{i}" for i in range(30)]
    asked = S.Asked([(q, " ".join(rng.choices(words, k=5)).encode()) for q in range(7)])
    box = type("Box", (), {"value": asked})
    texts = [" ".join(rng.choices([*words, "else"], k=rng.randrange(0, 5))).encode() for _ in range(90)]
    pids = [None if i < 10 else i // 8 for i in range(90)]
    packed = pa.Table.from_batches(S.packing(box)([pa.record_batch([pa.array(pids, pa.int64()), pa.array(texts, pa.binary())], names=["pid", "low"])]))
    packed = packed.sort_by([("size", "ascending")])
    order = sorted(range(90), key=lambda i: (packed["pid"][i].as_py() is not None, packed["pid"][i].as_py() or 0))
    packed = packed.take(order).combine_chunks()

    want: dict = {}  # (pid, size): terms and how often
    for pid, text in zip(pids, texts):
        found = text.split()
        unit = want.setdefault((pid, len(found)), {})
        for w in found:
            unit[w] = unit.get(w, 0) + 1
    df = [sum(w in unit for unit in want.values()) for w in asked.ids]
    monkeypatch.setattr(S, "CELLS", 7 * rows)
    counted = pa.Table.from_batches(S.counting(box, S.together)(packed.to_batches(rows))).to_pydict()
    counted = dict(zip(counted["term"], counted["n"]))
    assert [counted.get(i, 0) for i in range(len(df))] == df and (counted[-1], counted[-2]) == (90, sum(len(t.split()) for t in texts))

    box = type("Box", (), {"value": (asked, np.array(df), 90, 2.0)})
    got = pa.Table.from_batches(S.scoring(box, 20, S.together)(packed.to_batches(rows))).to_pylist()
    shared = {}
    for (pid, _), unit in want.items():
        for q, low in ((q, asked.queries == n) for n, q in enumerate(asked.qids.tolist())):
            terms = np.repeat(np.arange(len(df)), np.diff(asked.starts))[low]
            n = sum(w in unit for w, i in asked.ids.items() if i in terms)
            if n:
                shared[q, pid] = shared.get((q, pid), 0) + n
    terms = dict(zip(asked.qids.tolist(), asked.terms.tolist()))
    assert {(r["qid"], r["pid"]): r["score"] for r in got if r["list"] == 2} == {k: round(n / terms[k[0]], 9) for k, n in shared.items()}
