"""Queries over retrieval, fusion, IR metrics and agreement of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenqa.operators import ir_metrics as M
from lumenqa.operators import retrieval as R
from lumenqa.plans import views as V
from lumenqa.plans.registry import query

BM25 = V.BM25_TERMS + """,
sc AS (SELECT qid, pid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * sz / av))), 9) AS score
       FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY qid, pid),
bm AS (SELECT qid, pid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM sc) WHERE rank <= {k})"""


@query("r1_bm25_topk", f"WITH {BM25.format(k=10)} SELECT qid, pid, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM bm")
def r1(t):
    return R.bm25(V.passages(t), V.queries(t), 10).select("qid", "pid", F.round("score", 6).alias("score"), "rank")


METRICS = """
rel AS (SELECT DISTINCT qid, docid FROM {qrels}), nr AS (SELECT qid, count(*) AS num_rel FROM rel GROUP BY qid),
mk AS (SELECT r.qid, r.pos, CASE WHEN rel.docid IS NULL THEN 0 ELSE 1 END AS rel FROM rk r LEFT JOIN rel ON r.qid = rel.qid AND r.docid = rel.docid),
rn AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seen FROM mk),
sm AS (SELECT qid, sum(rel) AS hits, sum(CASE WHEN rel = 1 THEN seen / pos ELSE 0 END) AS gain, sum(CASE WHEN rel = 1 THEN 1 / log2(pos + 1) ELSE 0 END) AS dcg FROM rn GROUP BY qid),
pq AS (SELECT nr.qid, num_rel, CAST(coalesce(hits, 0) AS BIGINT) AS hits, round(coalesce(hits / num_rel, 0), 6) AS recall, round(coalesce(gain / num_rel, 0), 6) AS ap,
       round(coalesce(dcg / list_sum(list_transform(range(1, least(num_rel, {k}) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM nr {join} sm USING (qid))"""


@query("m1_m3_bm25_metrics", f"WITH {BM25.format(k=10)}, {V.RUN_QRELS}, rk AS (SELECT qid, pid AS docid, rank AS pos FROM bm), {METRICS.format(qrels='qrels', k=10, join='LEFT JOIN')} SELECT * FROM pq")
def m1_bm25(t):
    run = R.bm25(V.passages(t), V.queries(t), 10).withColumnRenamed("pid", "docid")
    return M.per_query(run, V.contained(t), 10, "concordance")


RANKED = {
    "eval": "rk AS (SELECT qid, docid, min(pos) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, docid) AS pos FROM runs WHERE run = 'run1') WHERE pos <= 10 GROUP BY qid, docid)",
    "concordance": "rk AS (SELECT * FROM (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY min(rank), docid) AS pos FROM runs WHERE run = 'run1' GROUP BY qid, docid) WHERE pos <= 10)",
    "extrinsic": "rk AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY min(rank), docid) AS pos FROM runs WHERE run = 'run1' AND rank <= 10 GROUP BY qid, docid)",
    "pooled": "rk AS (SELECT * FROM (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY max(score) DESC, docid DESC) AS pos FROM runs WHERE run = 'run1' GROUP BY qid, docid) WHERE pos <= 10)",
}


def add_variant(variant: str) -> None:
    both = variant != "eval"
    join = "JOIN" if both else "LEFT JOIN"

    @query(f"m1_m5_metrics_{variant}", f"WITH {V.RUNS}, {V.RUN_QRELS}, {RANKED[variant]}, {METRICS.format(qrels='qrels', k=10, join=join)} SELECT * FROM pq")
    def build(t):
        return M.per_query(V.runs(t).where("run = 'run1'"), V.contained(t), 10, variant, both)


for name in RANKED:
    add_variant(name)


@query(
    "m4_macro_means",
    f"WITH {V.RUNS}, {V.RUN_QRELS}, {RANKED['eval']}, {METRICS.format(qrels='qrels', k=10, join='LEFT JOIN')} "
    "SELECT count(*) AS num_queries, round(avg(recall), 6) AS mean_recall, round(avg(ap), 6) AS mean_ap, round(avg(ndcg), 6) AS mean_ndcg FROM pq",
)
def m4(t):
    return M.macro(M.per_query(V.runs(t).where("run = 'run1'"), V.contained(t), 10, "eval"))


DENSE = """
dn AS (SELECT qid, pid, score, rank FROM (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM (
  SELECT a.vec_id AS qid, b.vec_id AS pid, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 9) AS score
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 25 = 0) a, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b WHERE a.vec_id <> b.vec_id)) WHERE rank <= {k})"""


def vectors(t):
    return t("embeddings").select(F.col("vec_id").cast("long").alias("pid"), F.col("embedding").alias("vector"))


def vector_queries(t):
    return vectors(t).where("pid % 25 = 0").withColumnRenamed("pid", "qid")


@query("r2_dense_topk", f"WITH {DENSE.format(k=10)} SELECT qid, pid, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM dn")
def r2(t):
    return R.dense(vectors(t), vector_queries(t), 10).select("qid", "pid", F.round("score", 6).alias("score"), "rank")


@query(
    "r4_two_stage_rerank",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS qid, e AS qe FROM e WHERE vec_id % 25 = 0),
    fs AS (SELECT qid, pid, qe, e, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM (
      SELECT qid, vec_id AS pid, qe, e, round(list_dot_product(qe[1:16], e[1:16]) / sqrt(list_dot_product(qe[1:16], qe[1:16]) * list_dot_product(e[1:16], e[1:16])), 9) AS score FROM q, e WHERE qid <> vec_id)),
    sc AS (SELECT qid, pid, round(list_dot_product(qe, e) / sqrt(list_dot_product(qe, qe) * list_dot_product(e, e)), 9) AS score FROM fs WHERE rank <= 15)
    SELECT qid, pid, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM sc) WHERE rank <= 5""",
)
def r4(t):
    short = lambda x: x.withColumn("vector", F.slice("vector", 1, 16))
    first = R.dense(short(vectors(t)), short(vector_queries(t)), 15)
    return R.rerank(first, vectors(t), vector_queries(t), 15, 5).select("qid", "pid", F.round("score", 6).alias("score"), "rank")


RRF = """
fu AS (SELECT qid, docid, round(sum(1.0 / (60 + rank)), 12) AS score, min({{'l': l, 'r': rank}}) AS seen FROM (
  SELECT qid, docid, rank, 0 AS l FROM runs WHERE run = 'run1' UNION ALL SELECT qid, docid, rank, 1 FROM runs WHERE run = 'run2') WHERE rank <= {depth} GROUP BY qid, docid)
SELECT qid, docid AS pid, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, docid) AS rank FROM fu) WHERE rank <= 10"""


def add_rrf(name: str, depth: int) -> None:
    @query(name, f"WITH {V.RUNS}, {RRF.format(depth=depth)}")
    def build(t):
        lists = [V.runs(t).where(F.col("run") == r).withColumnRenamed("docid", "pid") for r in ("run1", "run2")]
        return R.rrf(lists, 10, depth=depth).select("qid", "pid", F.round("score", 9).alias("score"), "rank")


add_rrf("r5_rrf_whole_lists", 100)
add_rrf("r6_rrf_short_lists", 10)


@query(
    "r8_queries_and_qrels",
    f"WITH {V.QA} SELECT qid, source AS docid FROM (SELECT qid, unnest([conv_id, conv_id + turn]) AS source FROM qa) GROUP BY ALL",
)
def r8(t):
    qas = V.qa_pairs(t).select("qid", F.col("conv_id").alias("source_id"), (F.col("conv_id") + F.col("turn")).alias("target_id"))
    return R.qa_qrels(qas)


@query(
    "r9_u8_mini_corpus",
    "SELECT md5(text) AS pid, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
)
def r9(t):
    return t("documents").groupBy(F.md5("text").alias("pid")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


HITS = f"""{V.RUNS}, {V.RUN_QRELS},
tot AS (SELECT qid, count(*) AS num_rel FROM qrels GROUP BY qid),
tp AS (SELECT * FROM (SELECT run, qid, docid, row_number() OVER (PARTITION BY run, qid ORDER BY min(rank), docid) AS pos FROM runs GROUP BY run, qid, docid) WHERE pos <= 10),
ht AS (SELECT tp.run, tp.qid, any_value(num_rel) AS num_rel, count(q.docid) AS rel_in_topk, count(q.docid) > 0 AS hit_any, count(q.docid) = any_value(num_rel) AS hit_all,
       CAST(min(CASE WHEN q.docid IS NOT NULL THEN pos END) AS INT) AS first_hit_rank
       FROM tp JOIN tot USING (qid) LEFT JOIN qrels q ON q.qid = tp.qid AND q.docid = tp.docid GROUP BY tp.run, tp.qid)"""


def hits(t):
    return M.hits_per_run(V.runs(t), V.contained(t))


@query("a12_hits_per_run", f"WITH {HITS} SELECT * FROM ht")
def a12(t):
    return hits(t)


CONC = """cc AS (SELECT qid, max(num_rel) AS num_rel, count(*) FILTER (hit_any) AS num_methods_hit_any, count(*) FILTER (hit_all) AS num_methods_hit_all,
count(*) FILTER (hit_any) >= 4 AS high_concordance_any, count(*) FILTER (hit_any) <= 1 AS low_concordance_any FROM ht GROUP BY qid)"""


@query("a11_concordance", f"WITH {HITS}, {CONC} SELECT * FROM cc")
def a11(t):
    return M.concordance(hits(t))


@query("f9_f11_agreement_filters", f"WITH {HITS}, {CONC} SELECT qid, num_methods_hit_any >= 4 AS ir_good, NOT low_concordance_any AS kept FROM cc")
def f9_f11(t):
    return M.concordance(hits(t)).select("qid", (F.col("num_methods_hit_any") >= 4).alias("ir_good"), (~F.col("low_concordance_any")).alias("kept"))


@query(
    "f17_wide_by_run",
    f"WITH {HITS} SELECT qid, " + ", ".join(f"max(rel_in_topk) FILTER (run = 'run{i}') AS run{i}" for i in range(5)) + " FROM ht GROUP BY qid",
)
def f17(t):
    return M.wide(hits(t), [f"run{i}" for i in range(5)])


@query(
    "a25_hit_ratios",
    f"""WITH {HITS} SELECT run, round(count(*) FILTER (hit_any) / (SELECT count(DISTINCT qid) FROM ht), 6) AS any_ratio, round(count(*) FILTER (hit_all) / (SELECT count(DISTINCT qid) FROM ht), 6) AS all_ratio,
    round(avg(first_hit_rank), 6) AS mean_first, median(first_hit_rank) AS median_first, min(first_hit_rank) AS min_first, max(first_hit_rank) AS max_first FROM ht GROUP BY run HAVING count(first_hit_rank) > 0""",
)
def a25(t):
    h = hits(t)
    n = h.agg(F.countDistinct("qid").alias("n"))
    r = h.join(F.broadcast(n)).groupBy("run").agg(
        F.round(F.count_if("hit_any") / F.max("n"), 6).alias("any_ratio"), F.round(F.count_if("hit_all") / F.max("n"), 6).alias("all_ratio"),
        F.round(F.avg("first_hit_rank"), 6).alias("mean_first"), F.median("first_hit_rank").alias("median_first"),
        F.min("first_hit_rank").alias("min_first"), F.max("first_hit_rank").alias("max_first"),
    )
    return r.where("min_first IS NOT NULL")


@query("l1_w1_topk_per_group", "SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def l1(t):
    scored = t("orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"))
    return R.top_k(scored, 3, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "rank")
