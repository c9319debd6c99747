"""Recall, average precision and nDCG at k with binary relevance, in the variants that differ in cut, duplicates and averaging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(run: DataFrame, k: int, variant: str) -> DataFrame:
    """(qid, docid, at): the rows of a run (qid, docid, rank, score) that count, with the rank they count at.

    eval: by score, cut to k first, later duplicates dropped but their ranks stay used. concordance: by rank, duplicates
    dropped, then cut. extrinsic: rank <= k first, then duplicates dropped, renumbered. pooled: the best score of a
    duplicate, by score, higher docid first among ties.
    """
    by_doc = Window.partitionBy("qid", "docid")
    if variant == "eval":
        at = run.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank", "docid"))).where(F.col("at") <= k)
        return at.withColumn("n", F.row_number().over(by_doc.orderBy("at"))).where("n = 1").select("qid", "docid", "at")
    if variant == "pooled":
        best = run.groupBy("qid", "docid").agg(F.max("score").alias("score"))
        order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("docid"))
        return best.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).select("qid", "docid", "at")
    if variant == "extrinsic":
        run = run.where(F.col("rank") <= k)
    first = run.groupBy("qid", "docid").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("qid").orderBy("rank", "docid")
    return first.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).select("qid", "docid", "at")


def ideal(n: Column, k: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, variant: str = "eval", only_both: bool = False) -> DataFrame:
    """(qid, num_rel, hits, recall, ap, ndcg) for each query with relevant documents; a query without a run scores 0,
    or is left out with ``only_both``."""
    relevant = qrels.select("qid", "docid").distinct().withColumn("rel", F.lit(1))
    total = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("num_rel"))
    marked = ranked(run, k, variant).join(relevant, ["qid", "docid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    running = Window.partitionBy("qid").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = marked.withColumn("seen", F.sum("rel").over(running)).groupBy("qid").agg(
        F.sum("rel").alias("hits"),
        F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("at")).otherwise(0.0)).alias("gain"),
        F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("at") + 1)).otherwise(0.0)).alias("dcg"),
    )
    joined = total.join(sums, "qid", "inner" if only_both else "left")
    zero = F.lit(0.0)
    return joined.select(
        "qid", "num_rel", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        F.round(F.coalesce(F.col("hits") / F.col("num_rel"), zero), 6).alias("recall"),
        F.round(F.coalesce(F.col("gain") / F.col("num_rel"), zero), 6).alias("ap"),
        F.round(F.coalesce(F.col("dcg") / ideal(F.col("num_rel"), k), zero), 6).alias("ndcg"),
    )


def macro(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over queries; null where there is none."""
    grouped = metrics.groupBy(*by) if by else metrics
    return grouped.agg(
        F.count(F.lit(1)).alias("num_queries"),
        *(F.round(F.avg(m), 6).alias(f"mean_{m}") for m in ("recall", "ap", "ndcg")),
    )


def hits_per_run(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(run, qid, num_rel, rel_in_topk, hit_any, hit_all, first_hit_rank) by the concordance reading of each run."""
    relevant = qrels.select("qid", "docid").distinct().withColumn("rel", F.lit(1))
    total = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("num_rel"))
    first = runs.groupBy("run", "qid", "docid").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("run", "qid").orderBy("rank", "docid")
    top = first.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    marked = top.join(relevant, ["qid", "docid"], "left")
    found = marked.groupBy("run", "qid").agg(F.sum(F.coalesce("rel", F.lit(0))).alias("rel_in_topk"), F.min(F.when(F.col("rel") == 1, F.col("at"))).alias("first_hit_rank"))
    return found.join(total, "qid").select(
        "run", "qid", "num_rel", "rel_in_topk", (F.col("rel_in_topk") > 0).alias("hit_any"),
        ((F.col("num_rel") > 0) & (F.col("rel_in_topk") == F.col("num_rel"))).alias("hit_all"), "first_hit_rank",
    )


def concordance(hits: DataFrame, high: int = 4, low: int = 1) -> DataFrame:
    """Agreement over runs: how many hit, with absolute thresholds for high and low agreement."""
    return hits.groupBy("qid").agg(
        F.max("num_rel").alias("num_rel"),
        F.count_if("hit_any").alias("num_methods_hit_any"), F.count_if("hit_all").alias("num_methods_hit_all"),
        (F.count_if("hit_any") >= high).alias("high_concordance_any"), (F.count_if("hit_any") <= low).alias("low_concordance_any"),
    )


def wide(hits: DataFrame, names: list[str], value: str = "rel_in_topk") -> DataFrame:
    """One column a run, for the runs named."""
    return hits.groupBy("qid").pivot("run", names).agg(F.first(value))
