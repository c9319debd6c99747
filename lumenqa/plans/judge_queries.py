"""Queries over judging: gates, fusion, and vote statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenqa.functions import text as T
from lumenqa.operators import judging as J
from lumenqa.plans import text_queries as Q
from lumenqa.plans import views as V
from lumenqa.plans.registry import query

FUSED = f"""{V.VOTES},
g AS (SELECT qid, count(*) AS n, count(*) FILTER (passed) AS yes, count(*) FILTER (dual_use >= 3) AS k,
  CAST(round_even(median(final_score), 0) AS INT) AS final_score, CAST(round_even(median(realism), 0) AS INT) AS realism, CAST(round_even(median(dual_use), 0) AS INT) AS dual_use,
  CAST(round_even(median(correctness), 0) AS INT) AS correctness, coalesce(median(final_score) FILTER (passed), 0) AS my, coalesce(median(final_score) FILTER (NOT passed), 0) AS mn FROM votes GROUP BY qid),
fused AS (SELECT qid, n, CASE WHEN yes <> n - yes THEN yes > n - yes ELSE k >= 2 AND my >= mn END AS passed, final_score, realism, dual_use, correctness,
  CASE WHEN yes = n - yes AND k >= 2 THEN concat('tie_break_dual_use_k=', k, '>=2') WHEN yes = n - yes THEN concat('tie_break_failed_dual_use_k=', k, '<2') END AS tie FROM g),
fm AS (SELECT *, CASE WHEN qid % 2 = 0 THEN 'A' ELSE 'B' END AS method, CASE WHEN qid % 3 = 0 THEN 'Professional' ELSE 'Basic' END AS persona FROM fused)"""


def fused(t):
    f = J.fuse(V.votes(t), 2)
    return f.withColumn("method", F.when(F.col("qid") % 2 == 0, "A").otherwise("B")).withColumn("persona", F.when(F.col("qid") % 3 == 0, "Professional").otherwise("Basic"))


@query("g3_g5_fuse_votes", f"WITH {FUSED} SELECT qid, n, passed, final_score, realism, dual_use, correctness, concat('fused_median_scores_over_ensemble', coalesce('|' || tie, '')) AS reasons FROM fused")
def g3(t):
    return J.fuse(V.votes(t), 2).withColumn("reasons", F.array_join("reasons", "|"))


@query(
    "g2_f7_f8_hard_gates",
    f"""WITH {V.QA}, x AS (SELECT qid, conv_id % 2 = 0 AS strict, {Q.BOTH} AS tags, regexp_matches(question, '{T.JUDGE_CITATION}') AS qc, regexp_matches({Q.TAGGED}, '{T.JUDGE_CITATION}') AS ac FROM qa),
    r AS (SELECT qid, list_filter([CASE WHEN NOT tags THEN 'missing_required_tags' END, CASE WHEN strict AND qc THEN 'forbidden_citation_in_question' END, CASE WHEN NOT strict AND ac THEN 'forbidden_citation_in_answer' END], lambda v: v IS NOT NULL) AS v FROM x)
    SELECT qid, array_to_string(CASE WHEN len(v) > 0 THEN list_concat(['local_hard_gate_fail'], v) ELSE v END, '|') AS reasons, len(v) > 0 AS failed FROM r""",
)
def g2(t):
    strict = F.col("conv_id") % 2 == 0
    r = Q.tagged(t).select("qid", J.gate_reasons(F.col("question"), F.col("answer"), F.col("conv_id"), F.col("turn"), strict, ~strict).alias("r"))
    return r.select("qid", F.array_join("r", "|").alias("reasons"), (F.size("r") > 0).alias("failed"))


@query(
    "g1_pass_expansion",
    f"WITH {V.QA} SELECT qid, p AS pass_no, ['m1', 'm2', 'm1'][p + 1] AS model, [7, 7, 8][p + 1] AS seed, concat(['m1', 'm2', 'm1'][p + 1], '@seed:', [7, 7, 8][p + 1]) AS tag FROM qa, (SELECT CAST(unnest([0, 1, 2]) AS INT) AS p)",
)
def g1(t):
    return J.expand_passes(V.qa_pairs(t).select("qid"), ["m1", "m2"], 7, 8)


STATS = """SELECT {by}, count(*) AS n, count(*) FILTER (passed) AS passed, round(100 * count(*) FILTER (passed) / count(*), 6) AS pass_pct, round(avg(final_score), 6) AS mean,
round(median(CAST(final_score AS DOUBLE)), 6) AS median, round(coalesce(stddev_pop(final_score), 0), 6) AS std,
round(CASE WHEN count(*) < 2 THEN 0 ELSE list_aggregate(list_sort(list(CAST(final_score AS DOUBLE)))[(count(*) - count(*) // 2 + 1):], 'median') - list_aggregate(list_sort(list(CAST(final_score AS DOUBLE)))[:(count(*) // 2)], 'median') END, 6) AS iqr,
round(avg(realism), 6) AS mean_realism, round(avg(dual_use), 6) AS mean_dual_use, round(avg(correctness), 6) AS mean_correctness FROM fm GROUP BY {by}"""


@query("a3_a4_method_stats", f"WITH {FUSED} {STATS.format(by='method')}")
def a3(t):
    return J.score_stats(fused(t), "method")


@query("a5_method_persona_stats", f"WITH {FUSED} {STATS.format(by='method, persona')}")
def a5(t):
    return J.score_stats(fused(t), "method", "persona")


@query(
    "a1_pass_counts",
    f"""WITH {FUSED} SELECT CASE WHEN grouping(method) = 0 THEN 'method' WHEN grouping(persona) = 0 THEN 'persona' ELSE 'total' END AS dimension, coalesce(method, persona, 'ALL') AS value,
    count(*) FILTER (passed) AS kept, count(*) FILTER (NOT passed) AS eliminated, round(100 * count(*) FILTER (passed) / greatest(1, count(*)), 6) AS pass_pct FROM fm GROUP BY GROUPING SETS ((method), (persona), ())""",
)
def a1(t):
    return J.pass_counts(fused(t), ["method", "persona"])


@query(
    "a2_judge_summary",
    f"WITH {FUSED} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, round(avg(final_score), 3) AS mean_final, round(avg(realism), 3) AS mean_realism, round(avg(dual_use), 3) AS mean_dual, round(avg(correctness), 3) AS mean_correct FROM fm",
)
def a2(t):
    return fused(t).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.round(F.avg("final_score"), 3).alias("mean_final"),
        F.round(F.avg("realism"), 3).alias("mean_realism"), F.round(F.avg("dual_use"), 3).alias("mean_dual"), F.round(F.avg("correctness"), 3).alias("mean_correct"),
    )


@query(
    "a6_dense_histogram",
    f"WITH {FUSED} SELECT m AS method, CAST(d AS INT) AS dual_use, count(qid) AS n FROM (SELECT unnest(['A', 'B']) AS m) CROSS JOIN range(0, 5) r(d) LEFT JOIN fm ON fm.method = m AND fm.dual_use = d GROUP BY ALL",
)
def a6(t):
    counts = fused(t).groupBy("method", "dual_use").agg(F.count(F.lit(1)).alias("n"))
    every = fused(t).select("method").distinct().select("method", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("dual_use"))
    return every.join(counts, ["method", "dual_use"], "left").na.fill(0, ["n"])


@query("a7_flag_counts", f"WITH {V.VOTES} SELECT method, flag, count(*) AS n, CAST(row_number() OVER (PARTITION BY method ORDER BY count(*) DESC, flag) AS INT) AS place FROM votes WHERE flag IS NOT NULL GROUP BY method, flag")
def a7(t):
    from pyspark.sql import Window

    n = V.votes(t).where("flag IS NOT NULL").groupBy("method", "flag").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("method").orderBy(F.desc("n"), "flag")))


@query("a8_reason_counts", f"WITH {FUSED}, r AS (SELECT unnest(CASE WHEN tie IS NULL THEN ['fused_median_scores_over_ensemble'] ELSE ['fused_median_scores_over_ensemble', tie] END) AS reason FROM fused) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def a8(t):
    return J.fuse(V.votes(t), 2).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a9_model_stats",
    f"WITH {V.VOTES} SELECT model, count(*) AS n, round(100 * count(*) FILTER (passed) / count(*), 6) AS pass_pct, round(avg(final_score), 6) AS mean_final, round(avg(dual_use), 6) AS mean_dual FROM votes GROUP BY model",
)
def a9(t):
    return V.votes(t).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.round(100 * F.count_if("passed") / F.count(F.lit(1)), 6).alias("pass_pct"),
        F.round(F.avg("final_score"), 6).alias("mean_final"), F.round(F.avg("dual_use"), 6).alias("mean_dual"),
    )


@query(
    "a10_unanimity",
    f"WITH {V.VOTES}, e AS (SELECT qid, count(*) AS n, count(*) FILTER (passed) AS yes FROM votes GROUP BY qid) SELECT count(*) AS items, count(*) FILTER (yes = n) AS unanimous_yes, count(*) FILTER (yes = 0) AS unanimous_no, count(*) FILTER (n = 3 AND greatest(yes, n - yes) = 2) AS two_to_one FROM e",
)
def a10(t):
    return J.agreement(V.votes(t))


@query(
    "a24_a31_score_buckets",
    f"""WITH {FUSED} SELECT method, CASE WHEN final_score <= 3 THEN '0-3' WHEN final_score <= 6 THEN '4-6' WHEN final_score <= 8 THEN '7-8' ELSE '9-10' END AS bucket, count(*) AS n, count(*) FILTER (passed) AS yes, count(*) FILTER (NOT passed) AS no,
    min(final_score) AS low, max(final_score) AS high, round(avg(final_score), 6) AS mean FROM fm GROUP BY ALL""",
)
def a24(t):
    s = F.col("final_score")
    bucket = F.when(s <= 3, "0-3").when(s <= 6, "4-6").when(s <= 8, "7-8").otherwise("9-10")
    return fused(t).groupBy("method", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("yes"), F.count_if(~F.col("passed")).alias("no"),
        F.min(s).alias("low"), F.max(s).alias("high"), F.round(F.avg(s), 6).alias("mean"),
    )


@query(
    "j12_votes_with_enrichment",
    f"WITH {FUSED} SELECT o_orderpriority AS item_type, method, count(*) AS n, count(*) FILTER (passed) AS passed FROM fm JOIN orders ON o_orderkey = qid GROUP BY ALL",
)
def j12(t):
    o = t("orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("item_type"))
    return fused(t).join(o, "qid").groupBy("item_type", "method").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"))
