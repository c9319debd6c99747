"""Round trips through sources and sinks over whole tables, and what models' replies become.

Each query writes a table in a format of lumenqa.sources.writers, or with lines no reader should keep, to a folder of
its own under the shared one, and reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenqa.functions import prompts as P
from lumenqa.functions import scorers as S
from lumenqa.functions import text as T
from lumenqa.operators import curation as C
from lumenqa.operators import retrieval as R
from lumenqa.plans import retrieval_queries as Q
from lumenqa.plans import text_queries as X
from lumenqa.plans import views as V
from lumenqa.plans.registry import query
from lumenqa.session import shared_dir
from lumenqa.sources import readers, writers


def folder(t, name: str) -> str:
    """A new path; what is written there goes with the application."""
    path = f"{shared_dir(t.spark)}/{uuid.uuid4().hex}-{name}"
    where = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(where)  # only a path that exists can be marked
    store.deleteOnExit(where)
    return path


def broken(t):
    """A malformed and a blank line for each document."""
    return t("documents").select(F.explode(F.array(F.concat(F.lit("{broken "), F.col("doc_id").cast("string")), F.lit("  "))).alias("value"))


def with_bad_lines(t) -> str:
    path = folder(t, "lenient.jsonl")
    good = t("documents").select(F.to_json(F.struct("doc_id", "lang", "text")).alias("value"))
    good.unionByName(broken(t)).write.mode("overwrite").text(path)
    return path


DOCUMENTS = "SELECT doc_id, lang, md5(text) AS digest FROM documents"
DOCUMENT = "doc_id long, lang string, text string"


@query("s1_jsonl_lenient", DOCUMENTS)
def s1(t):
    return readers.jsonl(t.spark, with_bad_lines(t), DOCUMENT).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("s2_k1_k11_jsonl_strict", DOCUMENTS)
def s2(t):
    path = folder(t, "strict.jsonl")
    for lang in ("draft", None):  # the second writing replaces the first whole
        d = t("documents").select("doc_id", F.lit(lang).alias("lang") if lang else F.col("lang"), "text")
        writers.jsonl(d, path)
    return readers.jsonl(t.spark, path, DOCUMENT, "strict").select("doc_id", "lang", F.md5("text").alias("digest"))


@query("s3_bad_lines", "SELECT concat('{broken ', CAST(doc_id AS VARCHAR)) AS value FROM documents")
def s3(t):
    return readers.jsonl_with_bad_lines(t.spark, with_bad_lines(t), DOCUMENT)[1].select("value")


@query("s4_missing_file", "SELECT count(*) AS n FROM documents")
def s4(t):
    absent = readers.jsonl(t.spark, f"{shared_dir(t.spark)}/{uuid.uuid4().hex}", DOCUMENT, missing_ok=True)
    return t("documents").select(F.col("doc_id").cast("long")).unionByName(absent.select("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("s5_json_array", "SELECT n_nationkey, n_name FROM nation")
def s5(t):
    path = folder(t, "nations.json")
    whole = t("nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))  # 25 rows at any scale
    whole.write.mode("overwrite").text(path)
    return readers.json_by_extension(t.spark, path, "n_nationkey long, n_name string")


@query(
    "s6_document_files",
    "SELECT CAST(item_id AS VARCHAR) AS ID, CAST(item_id AS INT) AS DocumentID, CASE WHEN trim(text) <> '' THEN trim(text) END AS Passage, 'ok' AS status FROM benchmark",
)
def s6(t):
    path = folder(t, "documents")
    item = F.array(F.struct(F.col("item_id").cast("string").alias("ID"), F.col("item_id").cast("string").alias("DocumentID"), F.col("text").alias("Passage")))
    shape = F.col("item_id") % 3
    inside = F.when(shape == 1, F.to_json(F.struct(item.alias("passages")))).otherwise(F.to_json(F.struct(item.alias("Items"))))
    t("benchmark").select("item_id", F.when(shape == 0, F.to_json(item)).otherwise(inside).alias("value")).write.mode("overwrite").partitionBy("item_id").text(path)
    return readers.documents(t.spark, f"{path}/*/*").select("ID", "DocumentID", "Passage", "status")


@query("s8_s9_s10_k2_k3_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(c_name, '') AS \"Name\", coalesce(c_mktsegment, '') AS c_mktsegment FROM customer")
def s8(t):
    path = folder(t, "customers.csv")
    parts = [t("customer").select("c_custkey", "c_name", "c_mktsegment"), t("customer").select("c_custkey").limit(0)]
    writers.csv(writers.ragged(parts), path, sorted_union=True)
    return readers.csv_strings(t.spark, path, {"C_NAME": "Name"}, ["c_custkey", "Name"])


@query("s11_k7_query_tsv", "SELECT CAST(item_id AS VARCHAR) AS qid, trim(regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g')) AS query FROM benchmark")
def s11(t):
    path = folder(t, "queries.tsv")
    writers.query_tsv(V.queries(t), path)
    return readers.query_tsv(t.spark, path)


@query("s12_k6_qrels", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS qid, CAST(l_partkey AS VARCHAR) AS docid, 1 AS rel FROM lineitem")
def s12(t):
    path = folder(t, "qrels")
    writers.qrels(t("lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("docid")), path)
    return readers.qrels(t.spark, path)


@query("s13_k5_run", f"WITH {Q.BM25.format(k=10)} SELECT 'bm25' AS run, CAST(qid AS VARCHAR) AS qid, CAST(pid AS VARCHAR) AS docid, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM bm")
def s13(t):
    path = folder(t, "run")
    writers.trec_run(R.bm25(V.passages(t), V.queries(t), 10).withColumnRenamed("pid", "docid"), path, "bm25")
    return readers.run(t.spark, path)


@query("s14_test_set_qrels", f"WITH {V.QA} SELECT DISTINCT qid, docid, 1 AS rel FROM (SELECT qid, trim(unnest([CAST(conv_id AS VARCHAR), CASE WHEN turn > 0 THEN concat(' ', CAST(conv_id + turn AS VARCHAR)) ELSE '' END])) AS docid FROM qa) WHERE docid <> ''")
def s14(t):
    target = F.when(F.col("turn") > 0, F.concat(F.lit(" "), (F.col("conv_id") + F.col("turn")).cast("string"))).otherwise("")
    items = V.qa_pairs(t).select(F.col("qid").alias("id"), F.col("conv_id").cast("string").alias("source_passage_id"), target.alias("target_pid"))
    return readers.test_set_qrels(items)


@query(
    "s15_retrieved_run",
    "SELECT l_orderkey AS qid, l_suppkey AS docid, max(l_quantity) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity) AS n FROM lineitem) WHERE n <= 3 GROUP BY ALL",
)
def s15(t):
    line = F.struct("l_linenumber", F.struct(F.col("l_suppkey").alias("pid"), F.col("l_quantity").alias("score")).alias("r"))
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("qa_id")).agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["r"]).alias("retrieved"))  # an order has a few lines
    return readers.retrieved_run(rows, 3)


RUN_FILES = [
    "out/DPEL_kept_bm25_gpt4o_per_qa.jsonl", "schema_elim_E5_x.jsonl", "dpel_kept_oracle_per_qa.jsonl", "SCHEMA_kept_hybrid_rrf_bm25_e5_gpt-4o_per_qa.jsonl",
    "dpel_kept_bm25-e5_per_qa.jsonl", "dpel_kept_bm25_e5_rerank_a_per_qa.jsonl", "x_bge.jsonl",
]


@query(
    "s16_run_files",
    f"""WITH n AS (SELECT o_orderkey, lower(regexp_extract({X.lst(RUN_FILES)}[CAST(o_orderkey % 7 AS INT) + 1], '([^/]*)$', 1)) AS f FROM orders),
    r AS (SELECT *, CASE WHEN starts_with(f, 'dpel_') THEN 'DPEL' WHEN starts_with(f, 'schema_') THEN 'SCHEMA' END AS km, CASE WHEN contains(f, '_bm25_e5_rerank_') THEN 'BM25_E5_RERANK' WHEN contains(f, '_hybrid_rrf_bm25_e5_') THEN 'HYBRID_RRF'
      WHEN contains(f, '_bm25_') THEN 'BM25' WHEN contains(f, '_bge_') THEN 'BGE' WHEN contains(f, '_e5_') THEN 'E5' END AS kr FROM n)
    SELECT o_orderkey, CASE WHEN contains(f, 'dpel') THEN 'DPEL' WHEN contains(f, 'schema') THEN 'SCHEMA' ELSE 'UNKNOWN' END AS method, CASE WHEN contains(f, 'kept') THEN 'kept' WHEN contains(f, 'elim') THEN 'eliminated' ELSE 'UNKNOWN' END AS subset,
    CASE WHEN contains(f, 'oracle') THEN 'oracle' ELSE 'realistic' END AS mode, CASE WHEN contains(f, 'oracle') THEN 'ORACLE' WHEN contains(f, 'hybrid') OR contains(f, 'rrf') THEN 'HYBRID_RRF'
    WHEN regexp_matches(f, 'bm25[_-]?e5') THEN 'BM25_E5_RERANK' WHEN contains(f, 'bge') THEN 'BGE' WHEN contains(f, 'e5') THEN 'E5' WHEN contains(f, 'bm25') THEN 'BM25' ELSE 'UNKNOWN' END AS retriever,
    CASE WHEN regexp_matches(f, 'gpt-?4o') THEN 'gpt4o' ELSE 'UNKNOWN' END AS model,
    CASE WHEN f LIKE '%\\_per\\_qa.jsonl' ESCAPE '\\' AND km IS NOT NULL AND contains(f, '_kept_') AND kr IS NOT NULL AND NOT contains(f, '_oracle_') THEN concat(km, '/', kr) END AS kept_run FROM r""",
)
def s16(t):
    name = F.get(F.array(*map(F.lit, RUN_FILES)), (F.col("o_orderkey") % 7).cast("int"))
    kept = readers.kept_run_meta(name)
    return t("orders").select("o_orderkey", readers.run_meta(name).alias("m"), F.concat(kept["method"], F.lit("/"), kept["retriever"]).alias("kept_run")).select("o_orderkey", "m.*", "kept_run")


@query("s18_corpus", "SELECT source AS pid, max_by(md5(text), doc_id) AS digest FROM documents WHERE source <> '' AND text <> '' GROUP BY source")
def s18(t):
    rows = t("documents").select(F.lit("").alias("pid"), F.col("source").alias("id"), F.col("text").alias("contents"), F.col("doc_id").alias("pos"))
    return readers.corpus(rows).select("pid", F.md5("text").alias("digest"))


@query("s19_questions", f"WITH {V.QA} SELECT CASE WHEN turn = 0 THEN concat('p', CAST(qid AS VARCHAR)) ELSE CAST(qid AS VARCHAR) END AS id, md5(question) AS question FROM qa WHERE trim(question) <> ''")
def s19(t):
    first = F.col("turn") == 0
    rows = V.qa_pairs(t).select(F.when(first, F.lit("")).otherwise(F.col("qid").cast("string")).alias("qa_id"), "question", F.when(first, F.concat(F.lit("p"), F.col("qid").cast("string"))).alias("pos"))
    return readers.questions(rows).select("id", F.md5("question").alias("question"))


@query("s21_keyed_lookup", "SELECT CASE WHEN event_type = 'view' THEN concat('q', CAST(user_id AS VARCHAR)) ELSE CAST(user_id AS VARCHAR) END AS key, max(event_id) AS pos FROM events GROUP BY 1")
def s21(t):
    view = F.col("event_type") == "view"
    user = F.col("user_id").cast("string")
    rows = t("events").select(F.when(~view, user).alias("qa_id"), F.when(view, F.concat(F.lit("q"), user)).alias("qid"), F.col("event_id").alias("pos"))
    return readers.keyed_lookup(rows).select("key", "pos")


@query("s22_per_qa_metrics", "SELECT CAST(doc_id AS VARCHAR) AS qa_id, CAST(max(quality) AS DOUBLE) AS f1, CAST(NULL AS DOUBLE) AS rouge_l FROM labels GROUP BY doc_id")
def s22(t):
    path = folder(t, "metrics.jsonl")
    writers.jsonl(t("labels").select(F.col("doc_id").cast("string").alias("qa_id"), F.col("quality").cast("string").alias("f1"), F.lit("n/a").alias("rouge_l")), path)
    return readers.per_qa_metrics(t.spark, path, ["f1", "rouge_l"])


@query("s23_split_files", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'own' ELSE ['train', 'dev', 'test'][CAST(n_nationkey % 3 AS INT) + 1] END AS split FROM nation")
def s23(t):
    paths = {}
    for i, name in enumerate(("train", "dev", "test")):
        paths[name] = folder(t, f"{name}.jsonl")
        writers.jsonl(t("nation").where(F.col("n_nationkey") % 3 == i).select("n_nationkey", F.when(F.col("n_regionkey") == 0, "own").alias("split")), paths[name])
    return readers.split_files(t.spark, paths, "n_nationkey long, split string").select("n_nationkey", "split")


@query(
    "k4_pipe_table",
    "SELECT 'c_custkey | c_name' AS value UNION ALL SELECT repeat('-', length('c_custkey | c_name')) UNION ALL SELECT concat(CAST(c_custkey AS VARCHAR), ' | ', coalesce(c_name, '')) FROM customer",
)
def k4(t):
    path = folder(t, "table")
    writers.pipe_table(t("customer").select("c_custkey", "c_name"), path, ["c_custkey"])
    return t.spark.read.text(path)


@query("k8_collection", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest FROM documents")
def k8(t):
    path = folder(t, "collection")
    writers.collection(V.passages(t), path)
    return t.spark.read.schema("id string, contents string").json(path).select("id", F.md5("contents").alias("digest"))


@query("k9_report", "SELECT count(*) AS n, count(DISTINCT lang) AS langs, sum(n_chars) AS chars FROM documents")
def k9(t):
    path = folder(t, "report")
    writers.report(t("documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"), F.sum("n_chars").alias("chars")), path)
    return readers.jsonl(t.spark, path, "n long, langs long, chars long", "strict")


@query(
    "k10_markdown",
    f"""WITH {V.QA}, i AS (SELECT concat_ws(chr(10), concat('# ', CAST(qid AS VARCHAR)), CASE WHEN question <> '' THEN concat('## Question', chr(10), chr(10), question, chr(10)) END,
    CASE WHEN turn > 0 THEN concat('## Turn', chr(10), chr(10), CAST(turn AS VARCHAR), chr(10)) END) AS x FROM qa)
    SELECT line, count(*) AS n FROM (SELECT unnest(string_split(x, chr(10))) AS line FROM i) GROUP BY line""",
)
def k10(t):
    path = folder(t, "markdown")
    sections = {"Question": F.col("question"), "Turn": F.when(F.col("turn") > 0, F.col("turn").cast("string"))}
    writers.markdown(V.qa_pairs(t), path, F.col("qid").cast("string"), sections, ["qid"])
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("k12_fan_out", "SELECT doc_id, lang, md5(text) AS digest FROM documents WHERE lang IS NOT NULL")
def k12(t):
    path = folder(t, "by_lang")
    writers.jsonl(t("documents").where("lang IS NOT NULL").select("doc_id", "lang", "text"), path, by=["lang"])
    return t.spark.read.schema(DOCUMENT).json(path).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("k13_fixed_width", "SELECT concat(rpad(CAST(c_custkey AS VARCHAR), 8, ' '), ' ', rpad(coalesce(c_mktsegment, '-'), 12, ' ')) AS line FROM customer")
def k13(t):
    return writers.fixed_width(t("customer"), {"c_custkey": 8, "c_mktsegment": 12})


@query("u2_union_of_queries", "SELECT DISTINCT qid FROM (SELECT o_custkey AS qid FROM orders UNION ALL SELECT user_id FROM events)")
def u2(t):
    return t("orders").select(F.col("o_custkey").alias("qid")).union(t("events").select("user_id")).distinct()


@query(
    "w6_missing_ids",
    """WITH a AS (SELECT doc_id, CASE WHEN lang = 'en' THEN format('DOC_{:06d}', doc_id * 2 + 1) END AS id FROM documents),
    h AS (SELECT doc_id * 2 + 1 AS t FROM documents WHERE lang = 'en'), g AS (SELECT t FROM range(1, (SELECT 2 * count(*) + 2 * max(doc_id) + 4 FROM documents)) r(t) WHERE t NOT IN (SELECT t FROM h)),
    f AS (SELECT t, row_number() OVER (ORDER BY t) AS n FROM g), m AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM a WHERE id IS NULL)
    SELECT doc_id, id FROM a WHERE id IS NOT NULL UNION ALL SELECT doc_id, format('DOC_{:06d}', t) FROM m JOIN f USING (n)""",
)
def w6(t):
    named = F.when(F.col("lang") == "en", F.format_string("DOC_%06d", F.col("doc_id") * 2 + 1))
    return C.missing_ids(t("documents").select("doc_id", named.alias("id")), "DOC", "doc_id")


@query(
    "g6_cache_reuse",
    """SELECT d.doc_id, l.quality IS NOT NULL AND l.toxic IS NOT NULL AND lang = 'en' AND lang IS NOT NULL AND n_chars IS NOT NULL AND source IS NOT NULL AS judged, l.quality IS NOT NULL AND l.toxic IS NOT NULL AS plain
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def g6(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    named = {"f1": "quality", "rouge_l_f1": "toxic", "judge_model": "lang", "answer_relevance": "n_chars", "answer_faithfulness": "source"}
    entries = d.select("doc_id", *[F.col(c).alias(n) for n, c in named.items()])
    return entries.select("doc_id", C.reusable("en", None).alias("judged"), C.reusable(None, None).alias("plain"))


SHARES = f"""sn AS (SELECT qid, list_filter(list_transform(string_split(regexp_replace(coalesce(answer, ''), '([.!?])\\s+', concat('\\1', chr(2)), 'g'), chr(2)), lambda x: {X.STRIP.format('x')}), lambda x: x <> '') AS s,
  list_distinct({X.WORDS.format("lower(question)")}) AS p FROM qa),
ea AS (SELECT qid, p, list_distinct({X.WORDS.format("lower(c)")}) AS w FROM (SELECT qid, p, unnest(s) AS c FROM sn)),
sh AS (SELECT qid, len(list_filter(w, lambda x: list_contains(p, x))) / greatest(1, len(w)) AS e FROM ea)"""


@query(
    "m11_x6_nli_mean",
    f"WITH {V.QA}, {SHARES} SELECT qa.qid, round(coalesce(avg(e), 0), 6) AS entailment, round(coalesce(avg((1 - e) * 0.25), 0), 6) AS contradiction FROM qa LEFT JOIN sh USING (qid) GROUP BY qa.qid",
)
def m11(t):
    found = S.sentence_entailment(V.qa_pairs(t), "qid", "question", "answer")
    return found.select("qid", F.round("entailment", 6).alias("entailment"), F.round("contradiction", 6).alias("contradiction"))


@query(
    "m12_x6_nli_labels",
    f"WITH {V.QA}, {SHARES} SELECT qa.qid, round(avg(CASE WHEN e IS NOT NULL THEN CASE WHEN e >= (1 - e) * 0.75 THEN 1.0 ELSE 0.0 END END), 6) AS entailment, round(avg(CASE WHEN e IS NOT NULL THEN CASE WHEN (1 - e) * 0.25 >= greatest(e, (1 - e) * 0.75) THEN 1.0 ELSE 0.0 END END), 6) AS contradiction FROM qa LEFT JOIN sh USING (qid) GROUP BY qa.qid",
)
def m12(t):
    found = S.sentence_entailment(V.qa_pairs(t), "qid", "question", "answer", rule="label")
    return found.select("qid", F.round("entailment", 6).alias("entailment"), F.round("contradiction", 6).alias("contradiction"))


@query(
    "x3_judged",
    f"""WITH {V.QA}, p AS (SELECT qid, CAST(concat('0x', substr(sha256(concat('Judge the pair on realism, use of both passages and correctness; pass from 7 points on.', chr(10), 'Question: ', question, chr(10), 'Answer: ', answer, chr(10), 'First passage: ', question, chr(10), 'Second passage: ', answer)), 1, 2)) AS INT) % 11 AS s FROM qa)
    SELECT qid, CAST(s AS INT) AS final_score, s >= 7 AS passed FROM p""",
)
def x3(t):
    asked = V.qa_pairs(t).select("qid", P.judge_prompt(F.col("question"), F.col("answer"), F.col("question"), F.col("answer")).alias("prompt"), F.array().cast("array<string>").alias("gate"))
    return S.judged(asked, "prompt", "gate").select("qid", "verdict.final_score", "verdict.passed")


REPLIES = [
    '{"answer_relevance": 4, "answer_faithfulness": 5}', '```json\n{"answer_relevance": 9, "answer_faithfulness": -1}\n```', "no json",
    '{"answer_relevance": 3}', 'So: {"answer_relevance": "2", "answer_faithfulness": 0} done', '{"answer_relevance": 1, ',
]
CLAMPED = [(4, 5), (5, 0), (None, None), (3, 0), (2, 0), (None, None)]
REJECTED = [(4, 5), (None, None), (None, None), (3, None), (2, 0), (None, None)]


def choice(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) for v in values) + "][CAST(o_orderkey % 6 AS INT) + 1]"


@query(
    "x5_answer_scores",
    "SELECT o_orderkey, " + ", ".join(f"CAST({choice([r[i] for r in rows])} AS INT) AS {rule}_{name}" for rule, rows in (("clamp", CLAMPED), ("reject", REJECTED)) for i, name in enumerate(("relevance", "faithfulness"))) + " FROM orders",
)
def x5(t):
    reply = F.get(F.array(*map(F.lit, REPLIES)), (F.col("o_orderkey") % 6).cast("int"))
    scores = {rule: S.answer_scores(reply, rule) for rule in ("clamp", "reject")}
    return t("orders").select("o_orderkey", *[v[f"answer_{n}"].alias(f"{rule}_{n}") for rule, v in scores.items() for n in ("relevance", "faithfulness")])


@query(
    "n21_answer_judge_prompts",
    f"""WITH {V.QA} SELECT qid, CASE WHEN question <> '' AND answer <> '' THEN concat('Rate the answer from 0 to 5 on answer_relevance (does it answer the question?) and answer_faithfulness (does it say what the reference says?). Reply in JSON.', chr(10), 'Question: ', question, chr(10), 'Reference: ', question, chr(10), 'Answer: ', answer) END AS prompt FROM qa""",
)
def n21_judge(t):
    return V.qa_pairs(t).select("qid", P.answer_judge_prompt(F.col("question"), F.col("question"), F.col("answer")).alias("prompt"))


KINDS = [*T.ITEM_TYPES, "odd"]


def hint_sql(kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN '{v}'" for k, v in P.ITEM_HINTS.items()) + " END"


@query(
    "n21_item_hints",
    f"""WITH k AS (SELECT o_orderkey, {X.lst(KINDS)}[CAST(o_orderkey % 8 AS INT) + 1] AS s, {X.lst(KINDS)}[CAST(o_orderkey // 8 % 8 AS INT) + 1] AS g, ['structured', 'freeform-only', 'none'][CAST(o_orderkey % 3 AS INT) + 1] AS m FROM orders)
    SELECT o_orderkey, CASE WHEN ({hint_sql('g')}) IS NOT NULL THEN concat('Form: ', {hint_sql('g')}, CASE WHEN ({hint_sql('s')}) IS NOT NULL THEN concat(' (first passage: ', {hint_sql('s')}, ')') ELSE '' END) END AS hint,
    CASE WHEN m = 'structured' THEN 'The answer names every date, amount, duration, share, term and section of the spans.' WHEN m = 'freeform-only' THEN 'The spans are free text: answer briefly and do not copy them.' ELSE 'There are no spans: answer briefly.' END AS spans,
    CASE WHEN m = 'freeform-only' THEN 'Each question hangs on one element of either passage; without one of them it cannot be answered.' END AS anchors FROM k""",
)
def n21_hints(t):
    kind = lambda n: F.get(F.array(*map(F.lit, KINDS)), (F.floor(F.col("o_orderkey") / n) % 8).cast("int"))
    mode = F.get(F.array(*map(F.lit, ["structured", "freeform-only", "none"])), (F.col("o_orderkey") % 3).cast("int"))
    return t("orders").select("o_orderkey", P.item_hint(kind(1), kind(8)).alias("hint"), P.span_rule(mode).alias("spans"), P.dual_anchor_rule(mode, "freeform_only").alias("anchors"))
