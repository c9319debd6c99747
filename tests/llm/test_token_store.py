import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenqa.llm import token_store as T
from lumenqa.llm.entry import op4_rans_token_store, tokenizer_path
from lumenqa.llm.workspace import Workspace


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (5, 3), (1000, 2), (70_001, 300), (200_000, 20_000)])
def test_blocks_round_trip_and_checkpoints(n, kinds):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.geometric(0.01, size=n), kinds) - 1
    ids, counts = np.unique(np.append(x, 0), return_counts=True)
    table = T.Table.of_counts(ids, counts)
    assert table.freq.sum() == 1 << T.SCALE and table.freq.min() > 0
    symbols = np.searchsorted(ids, x)
    coded, final, places, saved = T.encode_block(symbols, table)
    slots = T.slot_table(table)
    assert (T.decode_block(coded, final, n, table, slots) == symbols).all()
    parts = [T.decode_block(coded, final, n, table, slots, places, saved, p) for p in range(len(places) + 1)]
    assert (np.concatenate(parts) == symbols).all()
    if n > 10_000:
        p = counts / counts.sum()
        assert 8 * len(coded) < 1.02 * n * -(p * np.log2(p)).sum() + 32 * T.LANES


def expected(rows, library):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op4_rans_token_store(spark, "/root/testdata/sf0.01").collect())
    assert got == expected(rows, Tokenizer.from_file(tokenizer_path()))


def test_edges_and_damage(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 64)
    rows = [(7, None), (3, ""), (5, "a <|endoftext|> b é 日本"), (5, "a <|endoftext|> b é 日本"), (4, "word " * 5000), (9, "z")]
    work = Workspace(spark)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    blocks, table = T.write_tokens(docs, work, tokenizer_path())
    want = expected(rows, Tokenizer.from_file(tokenizer_path()))
    assert sorted(tuple(r) for r in T.read_tokens(blocks, table).collect()) == want
    assert sum(len(r.token_ids) for r in T.read_tokens(blocks, table, with_ids=True).collect()) == sum(w[2] for w in want)
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="damaged"):
        T.read_tokens(blocks.withColumn("coded", F.concat("coded", F.lit(b"xxxx"))), table).collect()
    blocks, table = T.write_tokens(docs.limit(0), work, tokenizer_path())
    assert T.read_tokens(blocks, table).collect() == []
    work.drop()


def test_words_that_share_a_hash_are_told_apart():
    data = np.frombuffer(b"abcabdabcxy", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 11])
    first, back = T.told_apart(data, starts, ends, np.array([0]), np.zeros(4, np.int64))
    assert [(int(starts[first[b]]), int(ends[first[b]])) for b in back] == [(0, 3), (3, 6), (0, 3), (9, 11)]


def test_thue_morse_words_and_chained_results(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, f"{word} x {word}")]
    work = Workspace(spark)
    out = T.read_tokens(*T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), work, tokenizer_path()))
    assert sorted(tuple(r) for r in out.where("doc_id >= 0").collect()) == expected(rows, Tokenizer.from_file(tokenizer_path()))
    assert out.limit(2).count() == 2
    work.drop()


def test_ranges_of_ids_order_of_files_and_wide_ids(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 3000)
    monkeypatch.setattr(T, "LANES", 4)
    monkeypatch.setattr(T, "CHECKPOINT", 8)
    rows = [(d, " ".join(f"word{d * i % 97}" for i in range(d % 60))) for d in range(300)]
    work = Workspace(spark)
    blocks, table = T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), work, tokenizer_path(), partitions=5)
    library = Tokenizer.from_file(tokenizer_path())
    whole = [i for _, t in rows for i in [*library.encode(t, add_special_tokens=False).ids, 1]]
    for lo, hi in [(0, len(whole)), (17, 18), (2990, 6100), (len(whole) - 5, len(whole) + 9)]:
        got = sorted((r["at"], r.token_ids) for r in T.read_ids(blocks, table, lo, hi).collect())
        assert got[0][0] == lo and [i for _, x in got for i in x] == whole[lo:hi]
    from pyspark.sql import functions as F

    files = blocks.select(F.col("_metadata.file_name").alias("f"), "first", F.monotonically_increasing_id().alias("m")).orderBy("f", "m").collect()
    assert len({r.f for r in files}) > 1 and [r["first"] for r in files] == sorted(r["first"] for r in files)
    symbols = np.array([0, 1, 1, 2])
    wide = T.Table.of_counts(np.array([5, 70_000, 4_000_000_000]), np.array([1, 2, 1]))
    coded, final, places, saved = T.encode_block(symbols, wide)
    row = {"part": 0, "place": 0, "coded": coded, "states": final, "n": 4, "places": places, "saved": saved, "coded_crc32": zlib.crc32(coded)}
    row["ids_crc32"] = zlib.crc32(np.array([5, 70_000, 70_000, 4_000_000_000], "<u4").tobytes())
    assert T.decoded(row, wide, T.slot_table(wide)).tolist() == [5, 70_000, 70_000, 4_000_000_000]
    work.drop()


def same_as_library(coder, texts, library):
    ids, cut = coder.encode_slice(pa.array(texts, pa.string()), 1)
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


@pytest.mark.parametrize("buckets,most", [(2, 40), (4, 1 << 20), (1 << 10, 300), (1 << 16, 1 << 23)])
def test_word_table_of_any_size_equals_the_library(monkeypatch, buckets, most):
    monkeypatch.setattr(T, "BUCKETS", buckets)
    monkeypatch.setattr(T, "MOST_IDS", most)
    library, coder = Tokenizer.from_file(tokenizer_path()), T.LibraryEncoder(tokenizer_path(), limit=5)
    cuts = ["a" * k for k in range(1, 40)] + ["abcdefgh" + "x" * k for k in range(12)] + ["abcdefghijklmn" + c for c in "opqr"]
    zeros = ["!", "!\0", "!\0\0", "!!!!!!!!\0", "!!!!!!!!", "\0" * 8, "\0" * 15, "\0" * 16, "é" * 7, "é" * 7 + "o", "é" * 8]
    rng = np.random.default_rng(buckets)
    for _ in range(3):
        texts = [" ".join(rng.choice(cuts + zeros, 60).tolist()) for _ in range(9)]
        same_as_library(coder, [None, "", *texts, "it's <|endoftext|> odd 日本", *texts[:2], "", "12 3", None], library)
        same_as_library(coder, ["", None, " "], library)
        same_as_library(coder, ["it's"], library)
        same_as_library(coder, [], library)
        assert (coder.table.n <= T.SHORT).all() and len(coder.table.low) == 2 * buckets


def test_known_words_take_no_step_of_python_each():
    rng = np.random.default_rng(4)
    words = ["".join(w) for w in rng.choice(list("abcdefgh"), (5000, 7))]
    coder, texts, steps = T.LibraryEncoder(tokenizer_path()), pa.array([" ".join(words)], pa.string()), []
    coder.encode_slice(texts, 1)
    sys.setprofile(lambda frame, event, what: steps.append(event))
    try:
        coder.encode_slice(texts, 1)
    finally:
        sys.setprofile(None)
    assert len(steps) < 1000
