import zlib

import pytest

from lumenqa.llm import sharding
from lumenqa.llm.entry import op1_feistel_sharding


def test_query_places_every_row_once(spark):
    rows = op1_feistel_sharding(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_walks_cycles(spark, n):
    import math

    from pyspark.sql import functions as F

    b = math.ceil(math.sqrt(n))
    a = -(-n // b)
    rows = spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n), F.lit(a), F.lit(b), 5).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))


def test_order_depends_on_rows_alone_and_edges(spark):
    docs = [(i, f"text {i % 7}", "x") for i in range(300)] + [(None, None, "x"), (None, "", "x"), (5, "text 5", "x"), (5, "text 5", "x"), (6, "é" * 500_000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, slot string")
    one = sorted(map(str, sharding.shard_documents(df.repartition(1)).collect()))
    two = sorted(map(str, sharding.shard_documents(df.repartition(7, "text")).collect()))
    assert one == two and len(one) == len(docs)
    assert sorted(r.position for r in sharding.shard_documents(df).collect()) == list(range(len(docs)))
    assert sharding.shard_documents(df.limit(0)).collect() == []
