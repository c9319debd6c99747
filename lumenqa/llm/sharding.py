"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows get gapless numbers 0..N-1 from a fixed order (hash bucket, then doc_id, size and checksum), so the
numbering depends on the rows alone and not on files, partitions or the cluster. A keyed Feistel network
over Z_a x Z_b with a*b >= N permutes the numbers; outputs beyond N walk the cycle until they fall below it.
``shard = p mod shards`` and ``slot = p div shards`` are then computable from the row number, every shard
has at most one row more than any other, and ``p`` itself is the position in the global shuffle.

Everything is DataFrame expressions. Only slim rows are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
ROUNDS = 4
WALK = 64
CHUNK = 10_000


def feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the network: a bijection of 0..a*b-1."""
    keys = F.array(*[F.lit(seed * 1_000_003 + 2 * i) for i in range(ROUNDS)])

    def step(state: Column, key: Column) -> Column:
        left = F.pmod(state["l"] + F.pmod(F.xxhash64(state["r"], key), a), a)
        return F.struct(left.alias("l"), F.pmod(state["r"] + F.pmod(F.xxhash64(left, key + 1), b), b).alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])


def permuted(x: Column, n: Column, a: Column, b: Column, seed: int) -> Column:
    """Cycle walking. At most a*b - n < b steps are ever needed; beyond 64 the chance is under b/n to the 64th,
    and the row raises instead of getting a wrong place."""
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        feistel(x, a, b, seed),
        lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b, seed)),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Gapless ``row`` numbers 0..N-1 and ``total`` N over ``columns``, without a global sort.

    Repeated rows are counted before the shuffle and unfolded after it. The table of bucket offsets has
    BUCKETS rows at any input size, so it is broadcast.
    """
    # never null, so no filter sets the two uses apart and they share one scan and exchange
    keyed = df.withColumn("bucket", F.coalesce(F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)), F.lit(0)))
    counted = keyed.groupBy("bucket", *columns).agg(F.count(F.lit(1)).alias("n"))
    per_bucket = counted.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
    order = Window.orderBy("bucket")
    offsets = per_bucket.select(
        "bucket",
        (F.sum("in_bucket").over(order) - F.col("in_bucket")).alias("offset"),
        F.sum("in_bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    within = Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in columns])
    first = counted.withColumn("first", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    at = first.join(F.broadcast(offsets), "bucket").withColumn("from", F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))
    chunks = at.withColumn("lo", F.explode("from"))
    return chunks.withColumn("i", F.explode(F.sequence(F.col("lo"), F.least(F.col("n") - 1, F.col("lo") + CHUNK - 1)))).select(
        *columns, (F.col("offset") + F.col("first") + F.col("i")).alias("row"), "total"
    )


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """Deal every row of ``docs`` (doc_id, text) to a shard and a slot in it.

    Returns doc_id, size (UTF-8 bytes + 8), text_crc32, row, position, shard, slot. Null text: size 8 and the
    checksum of no bytes. Null or repeated doc_id and wholly equal rows are rows like any other; an empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    n = F.col("total")
    b = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("long"))
    sized = numbered(slim, ["doc_id", "size", "text_crc32"]).withColumn("b", b)
    sized = sized.withColumn("a", F.floor((n + F.col("b") - 1) / F.col("b")).cast("long"))
    placed = sized.withColumn("position", permuted(F.col("row"), n, F.col("a"), F.col("b"), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", "row", "position",
        F.pmod(F.col("position"), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
    )

