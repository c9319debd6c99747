"""Queries over curation: joins, filters, dedup, ids, samples, splits, and the descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenqa.functions import text as T
from lumenqa.operators import curation as C
from lumenqa.plans import judge_queries as J
from lumenqa.plans import text_queries as Q
from lumenqa.plans import views as V
from lumenqa.plans.registry import query



def count():
    return F.count(F.lit(1))


SHUFFLE = "((CAST({k} AS BIGINT) % 2147483648 * 2654435761 + {s}) % 4294967296)"


@query(
    "j1_w4_last_judgment_joined",
    "WITH l AS (SELECT user_id, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id) SELECT c_custkey, c_mktsegment, round(value, 6) AS value FROM customer JOIN l ON l.user_id = c_custkey",
)
def j1(t):
    last = C.last_wins(t("events").select("user_id", "event_id", "value"), "user_id", "event_id")
    return t("customer").join(last, F.col("user_id") == F.col("c_custkey")).select("c_custkey", "c_mktsegment", F.round("value", 6).alias("value"))


@query("j1_j2_unmatched", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j1_unmatched(t):
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"))
    return C.unmatched(t("customer").select("c_custkey", "c_mktsegment"), orders, "c_custkey")


@query("w3_first_wins", "SELECT user_id, min(event_id) AS event_id, min_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def w3(t):
    return C.first_wins(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(
    "j3_j4_stage_intersections",
    "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) AND doc_id IN (SELECT page_id FROM pages)",
)
def j3(t):
    labels = t("labels")
    docs = t("documents").select("doc_id").join(labels.where("quality = 1"), "doc_id", "left_semi").join(labels.where("toxic = 0"), "doc_id", "left_semi")
    return docs.join(t("pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_semi")


@query(
    "j5_gold_and_predicted",
    "SELECT a.doc_id AS id, length(a.text) AS gold, length(html) AS predicted FROM documents a JOIN pages ON page_id = a.doc_id",
)
def j5(t):
    gold = t("documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("gold"))
    return gold.join(t("pages").select(F.col("page_id").alias("id"), F.length("html").cast("long").alias("predicted")), "id")


@query(
    "j6_j16_left_metric_join",
    "SELECT l.toxic, count(*) AS n, count(e.v) AS n_scored, round(avg(e.v), 6) AS mean FROM labels l LEFT JOIN (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' OR event_type = 'click' GROUP BY user_id) e ON e.user_id = l.doc_id GROUP BY l.toxic",
)
def j6(t):
    v = t("events").where("event_type in ('view', 'click')").groupBy("user_id").agg(F.avg("value").alias("v"))
    joined = t("labels").join(v, F.col("user_id") == F.col("doc_id"), "left")
    return joined.groupBy("toxic").agg(count().alias("n"), F.count("v").alias("n_scored"), F.round(F.avg("v"), 6).alias("mean"))


@query(
    "j8_j9_contexts_in_order",
    f"WITH {V.RUNS} SELECT r.qid, string_agg(d.doc_id || ':' || d.text, '|' ORDER BY rank, d.doc_id) AS contexts, count(*) AS n FROM runs r JOIN documents d ON d.doc_id = r.docid WHERE run = 'run3' AND rank <= 4 GROUP BY r.qid",
)
def j8(t):
    top = V.runs(t).where("run = 'run3' AND rank <= 4").select("qid", "rank", F.col("docid").alias("doc_id"))
    text = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text"))
    got = top.join(t("documents").select("doc_id", "text"), "doc_id").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", text.alias("c")))).alias("c"), count().alias("n"))
    return got.select("qid", F.array_join(F.transform("c", lambda x: x["c"]), "|").alias("contexts"), "n")


@query(
    "j11_j13_fallback_attributes",
    "SELECT d.doc_id, coalesce(nullif(CASE WHEN d.doc_id % 3 = 0 THEN d.lang END, ''), p.url_lang, 'UNKNOWN') AS attribute FROM documents d LEFT JOIN (SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS url_lang FROM pages) p ON p.page_id = d.doc_id",
)
def j11(t):
    lookup = t("pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("url_lang"))
    own = F.nullif(F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.lit(""))
    return t("documents").join(lookup, "doc_id", "left").select("doc_id", F.coalesce(own, "url_lang", F.lit("UNKNOWN")).alias("attribute"))


@query(
    "j14_f19_enriched_final",
    "SELECT d.doc_id, d.lang, l.quality, l.toxic, p.url, length(d.text) AS size FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id",
)
def j14(t):
    p = t("pages").select(F.col("page_id").alias("doc_id"), "url")
    d = t("documents").select("doc_id", "lang", F.length("text").cast("long").alias("size"))
    return d.join(t("labels"), "doc_id", "left").join(p, "doc_id", "left").select("doc_id", "lang", "quality", "toxic", "url", "size")


@query("j15_two_hop_titles", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j15(t):
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query(
    "j18_g6_g7_resume",
    "SELECT doc_id, CASE WHEN doc_id IN (SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND trim(html) <> '') THEN 'reuse' ELSE 'compute' END AS state FROM documents",
)
def j18(t):
    done = t("pages").select(F.col("page_id").alias("doc_id"), "html")
    usable = (F.col("doc_id") % 3 != 0) & ~T.is_blank(F.col("html"))
    reuse, todo = C.overlay(t("documents").select("doc_id"), done, "doc_id", usable)
    return reuse.select("doc_id", F.lit("reuse").alias("state")).unionByName(todo.select("doc_id", F.lit("compute").alias("state")))


@query("f1_membership", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high')")
def f1(t):
    return t("orders").where(F.lower("o_orderpriority").isin("1-urgent", "2-high")).select("o_orderkey")


PAIR = "SELECT a.doc_id AS id, a.doc_id AS sid, b.doc_id AS tid, a.text AS s, b.text AS g FROM documents a JOIN documents b ON b.doc_id = a.doc_id - a.doc_id % 7"
REASON = (
    f"CASE WHEN {Q.COLLAPSE.format('s')} = '' OR {Q.COLLAPSE.format('g')} = '' THEN 'empty' WHEN sid = tid OR {Q.COLLAPSE.format('s')} = {Q.COLLAPSE.format('g')} THEN 'degenerate' "
    "WHEN length(g) < 60 THEN 'short_target' ELSE 'kept' END"
)


def reasons(t):
    d = t("documents").select("doc_id", "text")
    other = d.select(F.col("doc_id").alias("tid"), F.col("text").alias("g"))
    p = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("sid"), F.col("text").alias("s")).join(other, F.col("tid") == F.col("id") - F.col("id") % 7)
    reason = C.first_reason(
        empty=T.is_blank(F.col("s")) | T.is_blank(F.col("g")), degenerate=C.degenerate(F.col("sid"), F.col("tid"), F.col("s"), F.col("g")), short_target=F.length("g") < 60
    )
    return p.select("id", reason.alias("reason"))


@query("f2_f3_elimination_reasons", f"WITH p AS ({PAIR}) SELECT id, {REASON} AS reason FROM p")
def f2(t):
    return reasons(t)


@query("f5_reason_counters", f"WITH p AS ({PAIR}) SELECT {REASON} AS reason, count(*) AS n FROM p GROUP BY 1")
def f5(t):
    return reasons(t).groupBy("reason").agg(count().alias("n"))


ANSWERS = """
m AS (SELECT user_id AS qid, event_type AS run, avg(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END) AS f1, avg(CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 6 AS DOUBLE) END) AS faith,
      avg(CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 100 END) AS ent, avg(CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 10 AS DOUBLE) / 20 END) AS contra FROM events GROUP BY ALL),
s AS (SELECT *, coalesce(f1, 0) >= 45 AND coalesce(faith, 0) >= 2 AND coalesce(ent, 0) >= 0.35 AND coalesce(contra, 1) <= 0.3 AS success FROM m)"""


def answers(t):
    """Means of each user and event type. They are compared with thresholds that they often equal, so values are added in
    the order of event_id, as one thread reads the table; an aggregate adds them in the order in which tasks end."""
    e = F.col("event_id")
    skip = lambda n, v: F.avg(F.when(e % n == 0, None).otherwise(v))  # noqa: E731  a row without event_id counts
    means = {"f1": skip(7, F.col("value")), "faith": skip(5, (e % 6).cast("double")), "ent": skip(4, F.col("value") / 100), "contra": skip(3, (e % 10).cast("double") / 20)}
    whole = Window.partitionBy("qid", "run").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = t("events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("run"), "event_id", "value")
    rows = rows.select("qid", "run", *(m.over(whole).alias(c) for c, m in means.items()))
    m = rows.groupBy("qid", "run").agg(*(F.first(c).alias(c) for c in means))
    filled = lambda c, d: F.coalesce(F.col(c), F.lit(float(d)))
    return m.withColumn("success", (filled("f1", 0) >= 45) & (filled("faith", 0) >= 2) & (filled("ent", 0) >= 0.35) & (filled("contra", 1) <= 0.3))


@query("f16_threshold_success", f"WITH {ANSWERS} SELECT qid, run, success FROM s")
def f16(t):
    return answers(t).select("qid", "run", "success")


@query(
    "a13_f10_answer_concordance",
    f"WITH {ANSWERS} SELECT qid, (SELECT count(DISTINCT run) FROM s) AS num_methods, count(*) FILTER (success) AS num_methods_success, count(*) FILTER (success) >= 4 AS high, count(*) FILTER (success) <= 1 AS low, round(coalesce(avg(f1), 0), 6) AS f1_mean, round(coalesce(avg(faith), 0), 6) AS faith_mean, round(coalesce(avg(contra), 0), 6) AS contra_mean FROM s GROUP BY qid",
)
def a13(t):
    s = answers(t)
    n = F.broadcast(s.agg(F.countDistinct("run").alias("num_methods")))  # one row
    wins = F.count_if("success")
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"{c}_mean") for c in ("f1", "faith", "contra")]
    return s.join(n).groupBy("qid", "num_methods").agg(wins.alias("num_methods_success"), (wins >= 4).alias("high"), (wins <= 1).alias("low"), *means)


@query(
    "a14_run_group_summary",
    f"WITH {ANSWERS} SELECT run, qid % 2 = 0 AS even, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(ent), 6) AS ent, round(count(*) FILTER (success) / count(*), 6) AS success_rate FROM s GROUP BY ALL",
)
def a14(t):
    return answers(t).groupBy("run", (F.col("qid") % 2 == 0).alias("even")).agg(
        count().alias("n"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("ent"), 6).alias("ent"), F.round(F.count_if("success") / count(), 6).alias("success_rate")
    )


@query("a15_j17_mean_with_zero", f"WITH {ANSWERS} SELECT d.doc_id, round(coalesce(avg(f1), 0), 6) AS f1, round(coalesce(avg(faith), 0), 6) AS faith FROM documents d LEFT JOIN m ON m.qid = d.doc_id GROUP BY d.doc_id")
def a15(t):
    joined = t("documents").select("doc_id").join(answers(t), F.col("qid") == F.col("doc_id"), "left")
    return joined.groupBy("doc_id").agg(F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 6).alias("f1"), F.round(F.coalesce(F.avg("faith"), F.lit(0.0)), 6).alias("faith"))


@query("f13_failure_kinds", f"WITH {ANSWERS}, c AS (SELECT qid, count(*) FILTER (success) <= 1 AS answer_low, count(*) <= 2 AS ir_low FROM s GROUP BY qid) SELECT qid, CASE WHEN answer_low AND ir_low THEN 'both_low' WHEN ir_low THEN 'ir_low' WHEN answer_low THEN 'answer_low' ELSE 'none' END AS kind FROM c")
def f13(t):
    c = answers(t).groupBy("qid").agg((F.count_if("success") <= 1).alias("answer_low"), (count() <= 2).alias("ir_low"))
    kind = F.when(F.col("answer_low") & F.col("ir_low"), "both_low").when(F.col("ir_low"), "ir_low").when(F.col("answer_low"), "answer_low").otherwise("none")
    return c.select("qid", kind.alias("kind"))


@query("f12_a28_stage_shares", "SELECT c_mktsegment AS persona, count(*) FILTER (c_acctbal > 0) AS kept, count(*) FILTER (c_acctbal <= 0) AS eliminated, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY c_mktsegment")
def f12(t):
    g = t("customer").groupBy(F.col("c_mktsegment").alias("persona")).agg(F.count_if(F.col("c_acctbal") > 0).alias("kept"), F.count_if(F.col("c_acctbal") <= 0).alias("eliminated"), count().alias("n"))
    return g.select("persona", "kept", "eliminated", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("f14_f15_field_caps", f"WITH {V.QA}, f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM qa) SELECT qid FROM f WHERE rn = 1 AND trim(answer) <> '' AND greatest(length(question), length(answer)) <= 3000")
def f14(t):
    first = V.qa_pairs(t).withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    fits = F.greatest(T.char_count(F.col("question")), T.char_count(F.col("answer"))) <= 3000
    return first.where((F.col("rn") == 1) & ~T.is_blank(F.col("answer")) & fits).select("qid")


@query("f18_f20_final_records", "SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE lang END IS NULL OR coalesce(source, '') = '' AS missing FROM documents")
def f18(t):
    lang = F.when(F.col("lang") != "en", F.col("lang"))
    return t("documents").select("doc_id", ((F.coalesce(lang, F.lit("")) == "") | (F.coalesce("source", F.lit("")) == "")).alias("missing"))


WORDS = "len(" + Q.WORDS.format("text") + ")"


@query(
    "a16_a17_length_stats",
    f"""SELECT lang, field, count(*) AS n, round(avg(v), 6) AS mean, median(v) AS median, round(stddev_pop(v), 6) AS std, min(v) AS low, max(v) AS high FROM (
    SELECT lang, 'tokens' AS field, CAST({WORDS} AS DOUBLE) AS v FROM documents UNION ALL SELECT lang, 'chars', CAST(length(text) AS DOUBLE) FROM documents) GROUP BY lang, field""",
)
def a16(t):
    x = F.col("text")
    long = t("documents").select("lang", F.stack(F.lit(2), F.lit("tokens"), T.word_count(x).cast("double"), F.lit("chars"), T.char_count(x).cast("double")).alias("field", "v"))
    return long.groupBy("lang", "field").agg(
        count().alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.median("v").alias("median"), F.round(F.stddev_pop("v"), 6).alias("std"), F.min("v").alias("low"), F.max("v").alias("high")
    )


@query(
    "a18_a22_category_pivot",
    "SELECT o_orderpriority AS value, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1",
)
def a18(t):
    p = t("orders").groupBy(F.col("o_orderpriority").alias("value")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.select("value", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query(
    "a19_s20_survival",
    "SELECT d.lang, count(*) AS generated, count(*) FILTER (l.quality = 1) AS kept, count(*) FILTER (l.quality = 0) AS eliminated, count(*) FILTER (l.quality = 1 AND l.toxic = 0) AS ir_good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang",
)
def a19(t):
    j = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    good = F.col("quality") == 1
    return j.groupBy("lang").agg(count().alias("generated"), F.count_if(good).alias("kept"), F.count_if(F.col("quality") == 0).alias("eliminated"), F.count_if(good & (F.col("toxic") == 0)).alias("ir_good"))


@query(
    "a20_a21_file_counters",
    f"""SELECT coalesce(source, 'ALL') AS file, count(*) AS n, count(*) FILTER (regexp_matches(text, '{T.INSPECTION_CITATION}')) AS with_citation, count(*) FILTER (NOT contains(text, '.')) AS without_stop
    FROM documents GROUP BY GROUPING SETS ((source), ())""",
)
def a20(t):
    d = t("documents").select("source", T.has_inspection_citation(F.col("text")).alias("c"), (~F.col("text").contains(".")).alias("w"))
    g = d.groupingSets([[F.col("source")], []], F.col("source")).agg(count().alias("n"), F.count_if("c").alias("with_citation"), F.count_if("w").alias("without_stop"))
    return g.select(F.coalesce("source", F.lit("ALL")).alias("file"), "n", "with_citation", "without_stop")


@query("a23_persona_scores", f"WITH {J.FUSED} SELECT persona, round(avg(final_score), 6) AS mean, median(final_score) AS median, min(final_score) AS low, max(final_score) AS high FROM fm GROUP BY persona")
def a23(t):
    s = F.col("final_score")
    return J.fused(t).groupBy("persona").agg(F.round(F.avg(s), 6).alias("mean"), F.median(s).alias("median"), F.min(s).alias("low"), F.max(s).alias("high"))


@query("a26_u4_distinct_documents", "SELECT source, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def a26(t):
    return t("documents").groupBy("source").agg(count().alias("n"), F.countDistinct("text").alias("texts")).orderBy(F.desc("n"), "source").limit(5)


@query("a27_running_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS mean FROM events")
def a27(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("event_id", F.round(F.avg("value").over(w), 9).alias("mean"))


@query("a29_g8_null_means", "SELECT event_type, round(avg(CASE WHEN value > 1e9 THEN value END), 6) AS none, round(avg(CASE WHEN event_id % 3 = 0 THEN value END), 6) AS some FROM events GROUP BY event_type")
def a29(t):
    v = F.col("value")
    return t("events").groupBy("event_type").agg(F.round(F.avg(F.when(v > 1e9, v)), 6).alias("none"), F.round(F.avg(F.when(F.col("event_id") % 3 == 0, v)), 6).alias("some"))


@query("a30_split_counts", "SELECT CASE WHEN lower(trim(s)) IN ('train', 'dev', 'test') THEN lower(trim(s)) ELSE 'UNKNOWN' END AS split, count(*) AS n FROM (SELECT ['train', ' Dev', 'TEST', 'x', NULL][CAST(o_orderkey % 5 AS INT) + 1] AS s FROM orders) GROUP BY 1")
def a30(t):
    raw = F.get(F.array(F.lit("train"), F.lit(" Dev"), F.lit("TEST"), F.lit("x"), F.lit(None)), (F.col("o_orderkey") % 5).cast("int"))
    low = F.lower(T.strip(raw))
    return t("orders").select(F.when(low.isin("train", "dev", "test"), low).otherwise("UNKNOWN").alias("split")).groupBy("split").agg(count().alias("n"))


@query("u5_content_dedup", "SELECT sha256(concat(coalesce(lang, ''), '||', coalesce(text, ''))) AS content_id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def u5(t):
    return C.content_dedup(t("documents").select("doc_id", "lang", "text"), ["lang", "text"], "doc_id").select("content_id", "doc_id")


@query("u6_question_dedup", f"WITH {V.QA} SELECT md5({Q.KEY.format('question')}) AS k, min(qid) AS qid FROM qa GROUP BY 1")
def u6(t):
    keyed = V.qa_pairs(t).select("qid", F.md5(T.question_key(F.col("question"))).alias("k"))
    return C.first_wins(keyed, "k", "qid")


@query("u7_duplicate_counts", "SELECT source, count(*) - count(DISTINCT text) AS within, (SELECT count(*) - count(DISTINCT text) FROM documents) AS across FROM documents GROUP BY source")
def u7(t):
    d = t("documents")
    across = F.broadcast(d.agg((count() - F.countDistinct("text")).alias("across")))  # one row
    return d.groupBy("source").agg((count() - F.countDistinct("text")).alias("within")).join(across)


@query("u1_u3_u10_set_operations", "(SELECT doc_id AS id, 'both' AS side FROM documents INTERSECT SELECT page_id, 'both' FROM pages) UNION ALL (SELECT doc_id, 'left' FROM documents EXCEPT SELECT page_id, 'left' FROM pages)")
def u1(t):
    a, b = t("documents").select(F.col("doc_id").alias("id")), t("pages").select(F.col("page_id").alias("id"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("left")))


@query("u9_sample_dedup", "SELECT coalesce(CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END, md5(text)) AS k, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def u9(t):
    k = F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")), F.md5("text"))
    return C.last_wins(t("documents").select(k.alias("k"), "doc_id"), "k", "doc_id")


@query("w5_cap_after_dedup", "WITH d AS (SELECT text, min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang FROM documents GROUP BY text) SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM d) WHERE n <= 4")
def w5(t):
    d = C.first_wins(t("documents").select("text", "doc_id", "lang"), "text", "doc_id")
    return C.capped_per_group(d, ["lang"], 4, "doc_id").select("lang", "doc_id")


@query("w6_sequential_ids", "SELECT doc_id, format('DOC_{:06d}', row_number() OVER (ORDER BY doc_id)) AS id FROM documents")
def w6(t):
    return C.sequential_ids(t("documents").select("doc_id"), "DOC", "doc_id").select("doc_id", "id")


@query("l4_head_cap", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def l4(t):
    return t("orders").select("o_orderkey").orderBy("o_orderkey").limit(25)


@query("l5_uniform_sample", f"SELECT o_orderkey FROM orders ORDER BY {SHUFFLE.format(k='o_orderkey', s=7)}, o_orderkey LIMIT 100")
def l5(t):
    return C.sample(t("orders").select("o_orderkey"), 100, "o_orderkey", 7)


@query("l6_filtered_sample", f"SELECT doc_id FROM documents WHERE length(text) <= 3000 ORDER BY {SHUFFLE.format(k='doc_id', s=11)}, doc_id LIMIT 20")
def l6(t):
    return C.sample(t("documents").where(F.length("text") <= 3000).select("doc_id"), 20, "doc_id", 11)


@query("l7_stratified_sample", f"SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {SHUFFLE.format(k='doc_id', s=3)}, doc_id) AS n FROM documents) WHERE n <= 10")
def l7(t):
    return C.stratified_sample(t("documents").select("lang", "source", "doc_id"), ["lang", "source"], 10, "doc_id", 3)


def split_sql(train: float, dev: float, seed: int) -> str:
    return f"""WITH i AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {SHUFFLE.format(k='c_custkey', s=seed)}, c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
    z AS (SELECT *, round_even(n * {train}, 0) AS a FROM i), y AS (SELECT *, least(round_even(n * {dev}, 0), greatest(0, n - a)) AS b FROM z)
    SELECT c_custkey, c_mktsegment, CASE WHEN i <= a THEN 'train' WHEN i <= a + b THEN 'dev' ELSE 'test' END AS split FROM y"""


@query("l8_w7_split_80_10_10", split_sql(0.8, 0.1, 13))
def l8(t):
    return C.assign_splits(t("customer").select("c_custkey", "c_mktsegment"), "c_custkey", (0.8, 0.1, 0.1), 13, ["c_mktsegment"])


@query("l9_w7_split_70_15_15", split_sql(0.7, 0.15, 42))
def l9(t):
    return C.assign_splits(t("customer").select("c_custkey", "c_mktsegment"), "c_custkey", (0.7, 0.15, 0.15), 42, ["c_mktsegment"], strict=True)


@query("l10_most_common", "SELECT event_type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS INT) AS place FROM events GROUP BY event_type")
def l10(t):
    g = t("events").groupBy("event_type").agg(count().alias("n"), F.min("event_id").alias("first"))
    return g.select("event_type", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("place"))


@query("w2_running_hits", f"WITH {V.RUNS}, {V.RUN_QRELS} SELECT r.run, r.qid, r.rank, CAST(sum(CASE WHEN q.docid IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r.run, r.qid ORDER BY r.rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seen FROM runs r LEFT JOIN qrels q ON q.qid = r.qid AND q.docid = r.docid")
def w2(t):
    rel = V.contained(t).withColumn("rel", F.lit(1))
    w = Window.partitionBy("run", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return V.runs(t).join(rel, ["qid", "docid"], "left").select("run", "qid", "rank", F.sum(F.coalesce("rel", F.lit(0))).over(w).alias("seen"))


@query("n21_prompts", f"WITH {V.QA} SELECT qid, concat('Question: ', question, chr(10), 'Contexts:', chr(10), '[1] ', answer, chr(10), '[2] ', question) AS prompt FROM qa")
def n21(t):
    from lumenqa.functions.prompts import answer_prompt

    contexts = F.array("answer", "question")
    return V.qa_pairs(t).select("qid", answer_prompt(F.col("question"), contexts).alias("prompt"))
