"""Results of queries can be filtered, limited and joined at any time, whatever Python still refers to."""

import gc

import pytest

import corpus_pipeline
from lumenqa.llm import entry

QUERIES = {n: entry.QUERIES[n] for n in ("op2_audio_features", "op4_rans_token_store", "op9_bayes_ngram_join", "op10_countmin_substring_dedup")}


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_chained(spark, sf, name):
    query = QUERIES.get(name, corpus_pipeline.run)
    some = query(spark, sf).where("doc_id >= 0").limit(3)
    gc.collect()
    assert len(some.collect()) == 3
    left = some.select("doc_id")
    assert left.join(some, "doc_id").count() >= 1
