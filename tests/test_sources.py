import json

import pytest
from pyspark.sql import functions as F

from lumenqa.sources import readers, writers

SCHEMA = "id string, n int"


@pytest.fixture
def lines(tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n{broken\n{"id": null}\n{"id": "", "n": 2}\n')
    return str(p)


def test_json_lines(spark, lines, tmp_path):
    assert sorted((r.id, r.n) for r in readers.jsonl(spark, lines, SCHEMA).where("id is not null").collect()) == [("", 2), ("a", 1)]
    assert readers.jsonl(spark, lines, SCHEMA).count() == 3
    assert readers.jsonl(spark, lines, SCHEMA).select("id").count() == 3
    with pytest.raises(Exception):
        readers.jsonl(spark, lines, SCHEMA, "strict").collect()
    good, bad = readers.jsonl_with_bad_lines(spark, lines, SCHEMA)
    assert good.count() == 3 and [r.value for r in bad.collect()] == ["{broken"]
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), SCHEMA, missing_ok=True).count() == 0
    (tmp_path / "x.json").write_text('[{"id": "a"}, {"id": "b"}]')
    assert readers.json_by_extension(spark, str(tmp_path / "x.json"), SCHEMA).count() == 2


def test_documents_and_manifest(spark, tmp_path):
    item = {"ID": "1", "DocumentID": 3, "PassageID": "p", "Passage": "text"}
    (tmp_path / "a b.json").write_text(json.dumps([item, {"ID": "1", "Passage": "again"}]))
    (tmp_path / "c.json").write_text(json.dumps({"items": [{"ID": "2", "Passage": ""}]}))
    (tmp_path / "d.json").write_text(json.dumps({"other": 1}))
    rows = readers.documents(spark, f"{tmp_path}/*.json").collect()
    assert {r.status for r in rows} == {"ok", "bad_structure"}
    manifest = spark.createDataFrame([(3, "A", "x/a b.json"), (4, "C", "c.json"), (5, "D", "d.json"), (6, "E", "e.json")], "DocumentID int, title string, json_file_path string")
    passages, problems = readers.manifest_documents(spark, manifest, str(tmp_path))
    assert [(r.pid, r.document_id) for r in passages.collect()] == [("1", 3)]
    assert {r.title: r.problem for r in problems.collect()} == {"C": "no_valid_passage", "D": "bad_structure", "E": "missing"}


def test_csv_aliases(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Reference Type,B\nNA,""\n"two\nlines",x\n')
    df = readers.csv_strings(spark, f"{tmp_path}/x.csv", {"reference type": "ReferenceType"}, ["ReferenceType", "B"])
    assert sorted(map(tuple, df.collect())) == [("NA", ""), ("two\nlines", "x")]
    with pytest.raises(ValueError, match="C"):
        readers.csv_strings(spark, f"{tmp_path}/x.csv", required=["C"])


RUN = "q1 Q0 d1 1 0.9 t\nq1 Q0 d2 x 0.8 t\nq1 Q0 d3 3 0.7\nq1 Q0 d1 4 0.6 t\n"


def test_run_variants(spark, tmp_path):
    (tmp_path / "r").write_text(RUN)
    rank = lambda v: sorted(str(r["rank"]) for r in readers.run(spark, f"{tmp_path}/r", v).collect())
    assert rank("concordance") == ["0", "1", "4"] and rank("extrinsic") == ["1", "4"] and rank("fusion") == ["1", "4", "None"]
    (tmp_path / "s").write_text(RUN + "q1 Q0 d1 1 0.9 t more\n")
    assert readers.run(spark, f"{tmp_path}/s", "extrinsic").count() == 3 and readers.run(spark, f"{tmp_path}/s", "fusion").count() == 3
    with pytest.raises(Exception, match="more than six"):
        readers.run(spark, f"{tmp_path}/s", "eval").collect()


def test_qrels_and_queries(spark, tmp_path):
    (tmp_path / "q").write_text("a 0 d 1\na 0 e 0\na 0 f x\nshort 0\n")
    assert readers.qrels(spark, f"{tmp_path}/q").count() == 1 and readers.qrels(spark, f"{tmp_path}/q", "all").count() == 3
    (tmp_path / "t").write_text(" a \t what\tis it \nno tab\n")
    assert [tuple(r) for r in readers.query_tsv(spark, f"{tmp_path}/t").collect()] == [("a", "what\tis it")]


def test_run_names(spark):
    names = ["x_hybrid_rrf_bm25_e5", "oracle_e5", "bm25_e5_rerank", "bge", "E5", "bm25", "z"]
    got = [r.n for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, p string").orderBy("i").select(readers.run_name(F.col("p")).alias("n")).collect()]
    assert got == ["HYBRID_RRF", "ORACLE", "BM25_E5_RERANK", "BGE", "E5", "BM25", "UNKNOWN"]


def test_entity_readers(spark):
    rows = spark.createDataFrame([("1", "", "t1", 0), ("1", "", "t2", 1), ("", "2", "", 2)], "pid string, id string, text string, pos int")
    assert [(r.pid, r.text) for r in readers.corpus(rows).collect()] == [("1", "t2")]
    with pytest.raises(ValueError):
        readers.corpus(rows.limit(0))
    q = spark.createDataFrame([(None, "what", 5), ("x", " ", 6)], "id string, question string, pos int")
    assert [tuple(r) for r in readers.questions(q).collect()] == [("5", "what")]
    items = spark.createDataFrame([("q", "s", "t", "s")], "id string, source_passage_id string, target_passage_id string, source_pid string")
    assert sorted(r.docid for r in readers.test_set_qrels(items).collect()) == ["s", "t"]
    got = spark.createDataFrame([("q", [("a", 1, 0.5), ("a", 2, 0.9), ("b", 3, 0.1)])], "qa_id string, retrieved array<struct<pid:string,rank:int,score:double>>")
    assert sorted((r.docid, r.score) for r in readers.retrieved_run(got, 2).collect()) == [("a", 0.9)]
    keyed = spark.createDataFrame([("a", None, 1), (None, "a", 2), (None, None, 3)], "qa_id string, qid string, pos int")
    assert [(r.key, r.pos) for r in readers.keyed_lookup(keyed).collect()] == [("a", 2)]


def test_split_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n{"id": "2", "split": "dev"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": "3"}\n')
    df = readers.split_files(spark, {"train": f"{tmp_path}/a.jsonl", "test": f"{tmp_path}/b.jsonl"}, "id string, split string")
    assert {r.id: r.split for r in df.collect()} == {"1": "train", "2": "dev", "3": "test"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("q", "d", 1, 0.1234567), ("q", "e", 2, 0.1)], "qid string, docid string, rank int, score double")
    writers.trec_run(df, f"{tmp_path}/run", "tag")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/run").collect()) == ["q Q0 d 1 0.123457 tag", "q Q0 e 2 0.100000 tag"]
    assert readers.run(spark, f"{tmp_path}/run").count() == 2
    writers.qrels(df.union(df), f"{tmp_path}/qrels")
    assert readers.qrels(spark, f"{tmp_path}/qrels").count() == 2
    writers.jsonl(df.withColumn("none", F.lit(None).cast("string")), f"{tmp_path}/j", by=["qid"])
    assert '"none":null' in spark.read.text(f"{tmp_path}/j/qid=q").first().value
    writers.csv(df, f"{tmp_path}/c", sorted_union=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == sorted(df.columns)
    assert writers.ragged([df.select("qid"), df.select("rank")]).columns == ["qid", "rank"]
    writers.pipe_table(df.select("qid", "rank"), f"{tmp_path}/p", ["rank"])
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/p").collect()) == ["----------", "q | 1", "q | 2", "qid | rank"]
    writers.report(df.limit(1), f"{tmp_path}/r")
    assert json.loads(spark.read.text(f"{tmp_path}/r").first().value)["docid"] == "d"
    writers.query_tsv(df.select("qid", F.lit("a\tb").alias("query")), f"{tmp_path}/t")
    assert readers.query_tsv(spark, f"{tmp_path}/t").first().query == "a b"
    writers.collection(df.select(F.col("docid").alias("pid"), F.col("qid").alias("text")), f"{tmp_path}/col")
    assert set(spark.read.json(f"{tmp_path}/col").columns) == {"id", "contents"}
    writers.markdown(df, f"{tmp_path}/m", F.col("docid"), {"Query": F.col("qid"), "None": F.lit("")}, ["rank"])
    assert "## None" not in "".join(r.value for r in spark.read.text(f"{tmp_path}/m").collect())
    assert writers.fixed_width(df, {"qid": 4, "rank": 3}).first().line == "q    1  "


def test_discovery_and_last_line(spark, tmp_path):
    for name in ("dpel_kept_bm25_x_per_qa.jsonl", "dpel_elim_e5_per_qa.jsonl", "notes.txt"):
        (tmp_path / name).write_text('{"qa_id": "a", "f1": "0.1"}\n{"qa_id": "a", "f1": "x"}\n{"qa_id": "a", "f1": "0.5"}\n')
    found = readers.discovered(spark, f"{tmp_path}/*_per_qa.jsonl").select(readers.run_meta(F.col("path")).alias("m"), readers.kept_run_meta(F.col("path")).alias("k")).collect()
    assert sorted((r.m.method, r.m.subset, r.m.retriever, r.k and r.k.retriever) for r in found) == [("DPEL", "eliminated", "E5", None), ("DPEL", "kept", "BM25", "BM25")]
    assert readers.discovered(spark, f"{tmp_path}/none*").count() == 0
    assert readers.per_qa_metrics(spark, f"{tmp_path}/dpel_kept_bm25_x_per_qa.jsonl", ["f1"]).first().f1 == 0.5
    assert readers.per_qa_metrics(spark, f"{tmp_path}/absent", ["f1"]).columns == ["qa_id", "f1"]
