import json

import pytest

from lumenqa.operators import construction as K
from lumenqa.sources import readers

LONG = "the firm, which holds client money for others, must keep records of every transaction that it makes for each client."


def test_candidates_and_reasons(spark):
    rows = [("1", "2", "a b", LONG, "Internal"), ("1", "1", "a b", LONG, "internal"), ("1", "3", "", LONG, "external"), ("1", "4", "a b", "PART 3", "internal"), ("1", "5", "a b", LONG, "other")]
    pairs = spark.createDataFrame(rows, "source_id string, target_id string, source_text string, target_text string, reference_type string")
    strict = {r.target_id: r.reason for r in K.candidate_pairs(pairs, True, True).collect()}
    assert strict == {"2": "kept", "1": "degenerate", "3": "empty", "4": "title", "5": "reference_type"}
    loose = {r.reason: r.n for r in K.reason_counts(K.candidate_pairs(pairs, False, False)).collect()}
    assert loose == {"kept": 3, "empty": 1, "reference_type": 1}


def test_schema_items(spark):
    reply = json.dumps({"semantic_hook": "record keeping under Rule 3.1", "citation_hook": "m", "source_item_type": "Scope", "target_item_type": "odd",
                        "answer_spans": [{"text": "the firm", "start": 0, "end": 8, "type": "TERM"}, {"text": "bad", "start": 1, "end": 4, "type": "TERM"}]})
    rows = [("1", "2", "some source", LONG, " Rule 3 ", f"```json\n{reply}\n```"), ("1", "3", "A phrase of the source text here", LONG, None, "nothing"), ("1", "2", "some source", LONG, " Rule 3 ", None)]
    pairs = spark.createDataFrame(rows, "source_id string, target_id string, source_text string, target_text string, reference_text string, reply string")
    items = {r.target_id: r for r in K.schema_items(pairs).collect()}
    assert len(items) == 2
    assert items["3"].target_item_type == "Other" and items["3"].citation_hook == "" and items["3"].answer_spans[0].type == "FREEFORM"
    assert items["3"].semantic_hook.startswith("A phrase of the source")
    only = K.schema_items(pairs.limit(1)).first()
    assert (only.semantic_hook, only.citation_hook, only.source_item_type, len(only.answer_spans)) == ("record keeping", "Rule 3", "Scope", 1)


def test_generated_questions(spark):
    tags = "yes [#SRC:s] and [#TGT:t]"
    rows = [("s", "t", i, "Basic", f"Question {i}?", tags) for i in range(4)] + [("s", "t", 4, "Basic", "question 0?", tags), ("s", "t", 5, "Basic", "Untagged?", "no"), ("s", "u", 6, "Basic", "QUESTION 1?", tags.replace(":t", ":u"))]
    df = spark.createDataFrame(rows, "source_id string, target_id string, pos int, persona string, question string, expected_answer string")
    got = K.generated_qas(df, "A", 2, True).collect()
    assert sorted(r.pos for r in got) == [0, 1] and len({r.qa_id for r in got}) == 2


def test_curation_and_recipes(spark):
    generated = spark.createDataFrame([(f"q{i}", "A") for i in range(40)], "qa_id string, method string")
    votes = [(f"q{i}", 0, False, 1) for i in range(40)] + [(f"q{i}", 1, i % 4 != 0, 8) for i in range(40)] + [("gone", 0, True, 9)]
    kept, eliminated, unmatched = K.curated(spark.createDataFrame(votes, "qa_id string, pos int, passed boolean, final_score int"), generated)
    assert (kept.count(), eliminated.count(), [r.qa_id for r in unmatched.collect()]) == (30, 10, ["gone"])
    ir = spark.createDataFrame([(f"q{i}", i % 6, i % 6 <= 1) for i in range(40)], "qid string, num_methods_hit_any int, low_concordance_any boolean")
    answers = spark.createDataFrame([(f"q{i}", 5) for i in range(40)], "qa_id string, num_methods_success int")
    a = K.recipe_thresholds(kept, ir, answers).collect()
    assert {r.qa_id for r in a} == {f"q{i}" for i in range(40) if i % 4 and i % 6 >= 4}
    b = K.recipe_drop_low(kept, ir).collect()
    assert {r.qa_id for r in b} == {f"q{i}" for i in range(40) if i % 4 and i % 6 > 1}
    assert sorted(r.id for r in b)[0] == "A_000001" and {r.split for r in b} == {"train", "dev", "test"}


def test_contexts_and_answers(spark):
    passages = spark.createDataFrame([("a", "ta"), ("b", "tb")], "pid string, text string")
    run = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "b", 3), ("q", "x", 4)], "qid string, docid string, rank int")
    assert [c.text for c in K.contexts(run, passages, 3).first().contexts] == ["tb", "ta"]
    qas = spark.createDataFrame([("q", "a", "a"), ("r", "b", "z")], "qa_id string, source_id string, target_id string")
    assert {r.qa_id: [c.text for c in r.contexts] for r in K.oracle_contexts(qas, passages).collect()} == {"q": ["ta"], "r": ["tb"]}
    rows = [("q", 0, "error", "x", "y"), ("q", 1, "ok", "x", "y"), ("r", 0, "ok", "the cat sat", "cat sat"), ("s", 0, "ok", " ", "y")]
    answers = K.scorable(spark.createDataFrame(rows, "qa_id string, pos int, status string, expected_answer string, rag_answer string"))
    got = K.answer_metrics(answers, "squad").collect()
    assert [(r.qa_id, r.f1, r.rouge_l_f1) for r in got] == [("r", 1.0, 1.0)]


@pytest.mark.parametrize("faith,contra,want", [(4.0, 0.1, True), (None, 0.1, False), (4.0, None, False)])
def test_missing_metrics_are_the_worst(spark, faith, contra, want):
    df = spark.createDataFrame([(0.9, faith, 0.9, contra)], "f1 double, faithfulness double, nli_entailment double, nli_contradiction double")
    assert df.select(K.successful().alias("s")).first().s is want


def test_metric_loader(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"qa_id": "a", "f1": 0.5}\n{"qa_id": "a", "f1": "bad"}\n{"qa_id": "b", "f1": 0.25}\n')
    assert {r.qa_id: r.f1 for r in readers.per_qa_metrics(spark, f"{tmp_path}/m.jsonl", ["f1"]).collect()} == {"a": None, "b": 0.25}
    assert readers.per_qa_metrics(spark, f"{tmp_path}/none.jsonl", ["f1"]).count() == 0
