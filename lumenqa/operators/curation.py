"""Deduplication, joins of curation stages, ids, sampling and splits.

``pos`` is input order. Random choices are hash orders of integer keys, seeded and the same on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenqa.functions import text as T
from lumenqa.session import shared_dir


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; one row a key and task is shuffled."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(key, "r.*")


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def content_dedup(df: DataFrame, columns: list[str], *order: str) -> DataFrame:
    """First wins by the SHA-256 of the given fields."""
    keyed = df.withColumn("content_id", T.content_id(*[F.col(c).cast("string") for c in columns]))
    return first_wins(keyed, "content_id", *order)


def capped_per_group(df: DataFrame, by: list[str], cap: int, *order: str) -> DataFrame:
    """The first ``cap`` rows of each group."""
    return df.withColumn("n_in_group", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n_in_group") <= cap)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")


def degenerate(source_id: Column, target_id: Column, source: Column, target: Column) -> Column:
    """Both passages are the same, by id or by normalised text."""
    return source_id.eqNullSafe(target_id) | (T.collapse(source) == T.collapse(target))


def first_reason(**reasons: Column) -> Column:
    """The name of the first condition that holds, else kept."""
    out = None
    for name, condition in reasons.items():
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise("kept")


def shuffle_key(key: Column, seed: int) -> Column:
    """A seeded order by integer arithmetic that any engine reproduces; keys that differ by 2^31 tie."""
    return (key % F.lit(2147483648) * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296)


def sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows without replacement, in hash order."""
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(n)


def stratified_sample(df: DataFrame, strata: list[str], n: int, key: str, seed: int) -> DataFrame:
    return capped_per_group(df.withColumn("_h", shuffle_key(F.col(key), seed)), strata, n, "_h", key).drop("_h", "n_in_group")


def numbered_in_order(df: DataFrame, *order: str, by: list[str] | None = None, name: str = "n") -> DataFrame:
    """Numbers from 1, over the whole table or in each group of ``by``.

    The table is range-partitioned, sorted and checkpointed once; a row's number is its place in its partition and the
    rows before that, so neither the table nor a group is ever in one task. Rows equal in ``order`` are in any order.
    """
    shared_dir(df.sparkSession)
    keys = [*(by or []), *order]
    held = df.repartitionByRange(*keys).sortWithinPartitions(*keys).checkpoint()
    parted = held.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33).cast("int"))
    counts = parted.groupBy("_p").agg(F.count(F.lit(1)).alias("c")).orderBy("_p").collect()  # one row a partition
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["_p"], total))
        total += r["c"]
    table = F.create_map(*[F.lit(x) for pair in offsets for x in pair]) if offsets else F.create_map().cast("map<int,bigint>")
    place = (F.try_element_at(table, F.col("_p")) + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).cast("long")
    numbered = parted.withColumn(name, place).drop("_m", "_p")
    if not by:
        return numbered
    first = numbered.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min(name).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    return numbered.join(first, same).select(*df.columns, (F.col(name) - F.col("_first") + 1).alias(name))


def sequential_ids(df: DataFrame, prefix: str, *order: str, by: list[str] | None = None) -> DataFrame:
    """PREFIX_000001 and so on, in order."""
    return numbered_in_order(df, *order, by=by, name="_n").withColumn("id", F.format_string(f"{prefix}_%06d", "_n")).drop("_n")


def missing_ids(df: DataFrame, prefix: str, *order: str) -> DataFrame:
    """``df`` with every null or empty ``id`` filled: PREFIX_000001 and so on in order, leaving out the ids that other rows have.

    The r-th free number is r plus the taken numbers below it: the place of r in the merged order of the free rows and of
    each taken number less the taken ones up to it.
    """
    filled = F.coalesce(F.col("id"), F.lit("")) != ""
    number = F.regexp_extract("id", rf"^{prefix}_(\d{{6,18}})$", 1).try_cast("long")
    taken = df.where(filled).select(number.alias("t"), "id").where((F.col("t") >= 1) & (F.col("id") == F.format_string(f"{prefix}_%06d", "t"))).select("t").distinct()
    gaps = numbered_in_order(taken, "t", name="_i").select((F.col("t") - F.col("_i") + 1).alias("_v"), F.lit(0).alias("_kind"), F.col("t").alias("_tie"))
    free = numbered_in_order(df.where(~filled), *order, name="_v").withColumns({"_kind": F.lit(1), "_tie": F.lit(0).cast("long")})
    placed = numbered_in_order(free.unionByName(gaps, allowMissingColumns=True), "_v", "_kind", "_tie", name="_n").where("_kind = 1")
    new = placed.withColumn("id", F.format_string(f"{prefix}_%06d", "_n"))
    return df.where(filled).unionByName(new.select(df.columns))


def split_sizes(n: int, train: float, dev: float) -> tuple[int, int]:
    """Rounded half to even; dev gives way where both exceed n."""
    a, b = round(n * train), round(n * dev)
    return a, (max(0, n - a) if a + b > n else b)


def assign_splits(df: DataFrame, key: str, ratios: tuple[float, float, float], seed: int, by: list[str], strict: bool = False) -> DataFrame:
    """``df`` with split train, dev or test in each group, in hash order of the key.

    Ratios that do not sum to 1 are scaled, or refused with ``strict``.
    """
    total = sum(ratios)
    if abs(total - 1) > 1e-6:
        if strict:
            raise ValueError(f"ratios sum to {total}")
        ratios = tuple(r / total for r in ratios)
    keyed = df.withColumn("_h", shuffle_key(F.col(key), seed))
    sized = numbered_in_order(keyed, "_h", key, by=by, name="_i").join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    train = F.bround(F.col("_n") * ratios[0], 0)
    dev = F.least(F.bround(F.col("_n") * ratios[1], 0), F.greatest(F.lit(0), F.col("_n") - train))
    split = F.when(F.col("_i") <= train, "train").when(F.col("_i") <= train + dev, "dev").otherwise("test")
    return sized.withColumn("split", split).drop("_i", "_n", "_h")


def overlay(work: DataFrame, done: DataFrame, key: str, usable: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of ``done`` to reuse, rows of ``work`` to compute): resume and cache reuse by key."""
    reuse = done.where(usable).join(work.select(key), key, "left_semi")
    return reuse, work.join(reuse.select(key), key, "left_anti")


def reusable(judge_model: str | None, nli_model: str | None) -> Column:
    """Whether a cached entry can be reused: F1 and ROUGE-L are there, and with a judge or an entailment model the same one with both its scores."""
    whole = F.col("f1").isNotNull() & F.col("rouge_l_f1").isNotNull()
    if judge_model is not None:
        whole &= F.col("judge_model").eqNullSafe(judge_model) & F.col("answer_relevance").isNotNull() & F.col("answer_faithfulness").isNotNull()
    if nli_model is not None:
        whole &= F.col("nli_model").eqNullSafe(nli_model) & F.col("nli_entailment").isNotNull() & F.col("nli_contradiction").isNotNull()
    return whole
