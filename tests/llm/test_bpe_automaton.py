import hashlib
import random

import pytest
from tokenizers import Tokenizer

from lumenqa.llm import bpe_automaton
from lumenqa.llm.entry import op8_automaton_bpe, tokenizer_path

ODD = [
    "", "  \n", "<|endoftext|> a<|startoftext|>B", "ΣΑΣ ΟΔΟΣ Σ", "İstanbul Iı", "é café", "日本語 テスト 123", "👩‍👩‍👧 emoji!! 😀😀", "don't I'LL we've 'S",
    "\x1c\x1d a\x1eb \x85 c\xa0d", "ǅ ǆ ﬀ ß ẞ", "½ ² ªº Ⅷ ①", "a​b ﻿ x", "<|endoftext", "a_b__c", "l" * 3001, "ab" * 2000, "\x00\x01a\x7f", "llllar aaaaa !!!!!!!", "aȺb Ⱦ1 Ɐ", "".join(map(chr, range(1, 0x250))),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_equals_the_library_on_odd_texts(library):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcdefghthein ' .,!?0123456789<>|_-ABCÉéàüÖñß́  \n日😀Σσς") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("al!o.") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    coder = bpe_automaton.codec(tokenizer_path())
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids, text
        assert coder.path(text)[2] == coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_merge_makes_a_token():
    automaton = bpe_automaton.codec(tokenizer_path()).automaton
    assert len(automaton.parts) == 49408 - 2 - 512


def test_query_equals_the_library(spark, library):
    rows = op8_automaton_bpe(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_and_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, "Some words", 9), (1, "Some words", 9), (None, "", 9)], "doc_id long, text string, n_tokens int")
    out = bpe_automaton.decoded(bpe_automaton.coded(docs, tokenizer_path()), tokenizer_path()).collect()
    assert sorted((r.n_tokens, r.decoded_text) for r in out) == [(0, ""), (0, ""), (2, "some</w> words</w>"), (2, "some</w> words</w>")]
    assert bpe_automaton.coded(docs.limit(0), tokenizer_path()).collect() == []
