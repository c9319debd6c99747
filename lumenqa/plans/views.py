"""The engine's entities over the given tables, and the same as SQL for the oracle statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenqa.operators import retrieval as R
from lumenqa.operators import term_search as S


def passages(t) -> DataFrame:
    """documents as passages: pid, text, document (source), lang."""
    return t("documents").select(F.col("doc_id").alias("pid"), "text", F.col("source").alias("document"), "lang")


def queries(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def qa_pairs(t) -> DataFrame:
    """Each user turn with the assistant turn after it: qid, question, answer, source_id, target_id."""
    c = t("conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    joined = asked.join(said, ["conv_id", "turn"])
    return joined.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "conv_id", "turn", "question", "answer")


QA = """
qa AS (SELECT u.conv_id * 1000 + u.turn AS qid, u.conv_id, u.turn, u.text AS question, a.text AS answer
       FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant')"""


def votes(t) -> DataFrame:
    """One judge's vote per order line: qid, model, passed, final_score, realism, dual_use, correctness, method, persona."""
    v = t("lineitem").select(
        F.col("l_orderkey").alias("qid"),
        F.concat(F.lit("judge"), (F.col("l_suppkey") % 3).cast("string")).alias("model"),
        (F.col("l_quantity") >= 20).alias("passed"),
        F.floor(F.col("l_quantity") / 5).cast("int").alias("final_score"),
        (F.col("l_linenumber") % 3).cast("int").alias("realism"),
        (F.col("l_partkey") % 5).cast("int").alias("dual_use"),
        (F.col("l_suppkey") % 5).cast("int").alias("correctness"),
        F.when(F.col("l_orderkey") % 2 == 0, "A").otherwise("B").alias("method"),
        F.when(F.col("l_orderkey") % 3 == 0, "Professional").otherwise("Basic").alias("persona"),
        F.col("l_returnflag").alias("flag"),
    )
    return v


VOTES = """
votes AS (SELECT l_orderkey AS qid, 'judge' || CAST(l_suppkey % 3 AS VARCHAR) AS model, l_quantity >= 20 AS passed,
                 CAST(floor(l_quantity / 5) AS INT) AS final_score, CAST(l_linenumber % 3 AS INT) AS realism,
                 CAST(l_partkey % 5 AS INT) AS dual_use, CAST(l_suppkey % 5 AS INT) AS correctness,
                 CASE WHEN l_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS method,
                 CASE WHEN l_orderkey % 3 = 0 THEN 'Professional' ELSE 'Basic' END AS persona, l_returnflag AS flag
          FROM lineitem)"""


DEPTH = 20


def contained(t) -> DataFrame:
    """qrels: the passages that contain a query's whole text."""
    return S.containing(passages(t), queries(t))


def runs(t) -> DataFrame:
    """Five runs of the benchmark's items over all passages: run, qid, docid, rank, score, DEPTH deep.

    run0 is BM25; run1 BM25 with k1 1.2 and b 0.75; run2 the share of the query's terms that a passage has; run3 reranks
    run0 by the share of the passage's tokens that are query terms; run4 fuses run0 and run2 by reciprocal ranks. Each row
    of a list goes to the runs made of it, so one pass over the lists gives all five.
    """
    lists = S.best_lists(passages(t), queries(t), DEPTH)
    row = lambda i, score, seen: F.struct(F.lit(f"run{i}").alias("run"), score.alias("part"), seen.alias("seen"))
    unseen = F.lit(None).cast("struct<list:int,rank:int>")
    own = lambda i: row(i, F.col("score"), unseen)
    fused = row(4, 1.0 / (60 + F.col("rank")), F.struct("list", "rank"))
    to = F.when(F.col("list") == 0, F.array(own(0), row(3, F.col("s3"), unseen), fused)).when(F.col("list") == 1, F.array(own(1))).otherwise(F.array(own(2), fused))
    each = lists.select("qid", "pid", F.inline(to)).groupBy("run", "qid", "pid").agg(F.round(F.sum("part"), 12).alias("score"), F.min("seen").alias("seen"))
    ranked = R.top_k(each, DEPTH, ["run", "qid"], "seen", F.asc_nulls_last("pid"))
    return ranked.select("run", "qid", F.col("pid").alias("docid"), "rank", "score")


BM25_TERMS = """
tk AS (SELECT doc_id AS pid, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM tk),
qt AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM benchmark),
tf AS (SELECT pid, sz, term, count(*) AS tf FROM (SELECT pid, len(w) AS sz, unnest(w) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""

RUNS = f"""{BM25_TERMS}, qn AS (SELECT qid, count(*) AS terms FROM qt GROUP BY qid),
ms AS (SELECT qid, pid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * sz / av))), 9) AS s0,
       round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * sz / av))), 9) AS s1,
       round(count(*) / any_value(terms), 9) AS s2, round(sum(tf) / any_value(sz), 9) AS s3
       FROM qt JOIN qn USING (qid) JOIN tf USING (term) JOIN df USING (term), st GROUP BY qid, pid),
f0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s0 DESC, pid) AS rank FROM ms) WHERE rank <= {DEPTH}),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s1 DESC, pid) AS rank FROM ms) WHERE rank <= {DEPTH}),
f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s2 DESC, pid) AS rank FROM ms) WHERE rank <= {DEPTH}),
f3 AS (SELECT qid, pid, s3, row_number() OVER (PARTITION BY qid ORDER BY s3 DESC, pid) AS rank FROM f0),
f4 AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, pid) AS rank FROM (
       SELECT qid, pid, round(sum(1.0 / (60 + rank)), 12) AS score, min({{'l': l, 'r': rank}}) AS seen
       FROM (SELECT qid, pid, rank, 0 AS l FROM f0 UNION ALL SELECT qid, pid, rank, 1 FROM f2) GROUP BY qid, pid)),
runs AS (SELECT run, qid, docid, CAST(rank AS INT) AS rank, score FROM (
  SELECT 'run0' AS run, qid, pid AS docid, rank, s0 AS score FROM f0 UNION ALL SELECT 'run1', qid, pid, rank, s1 FROM f1
  UNION ALL SELECT 'run2', qid, pid, rank, s2 FROM f2 UNION ALL SELECT 'run3', qid, pid, rank, s3 FROM f3 UNION ALL SELECT 'run4', qid, pid, rank, score FROM f4 WHERE rank <= {DEPTH}))"""

RUN_QRELS = "qrels AS (SELECT item_id AS qid, doc_id AS docid FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
