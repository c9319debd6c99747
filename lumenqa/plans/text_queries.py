"""Queries over text rules, overlap metrics and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenqa.functions import overlap as O
from lumenqa.functions import text as T
from lumenqa.plans import views as V
from lumenqa.plans.registry import query

# DuckDB spellings of the shared rules
COLLAPSE = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
SQUAD = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s]', ' ', 'g'), "
    "'\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
)
KEY = "regexp_replace(regexp_replace(trim(lower(coalesce({0}, '')), ' \t\n\r'), '[^a-z0-9\\s?]', ' ', 'g'), '\\s+', ' ', 'g')"
WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda w: w <> '')"
STRIP = "trim({0}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("n1_squad_normalise", f"SELECT doc_id, md5({SQUAD.format('text')}) AS digest FROM documents")
def n1(t):
    return t("documents").select("doc_id", F.md5(T.squad_normalised(F.col("text"))).alias("digest"))


@query("n2_question_key", f"SELECT doc_id, md5({KEY.format('text')}) AS digest FROM documents")
def n2(t):
    return t("documents").select("doc_id", F.md5(T.question_key(F.col("text"))).alias("digest"))


@query("n3_collapse_blank", f"SELECT doc_id, md5({COLLAPSE.format('text')}) AS digest, length({COLLAPSE.format('text')}) = 0 AS blank FROM documents")
def n3(t):
    x = F.col("text")
    return t("documents").select("doc_id", F.md5(T.collapse(x)).alias("digest"), T.is_blank(x).alias("blank"))


@query("n4_first_words", f"SELECT doc_id, array_to_string({WORDS.format('text')}[1:16], ' ') AS head FROM documents")
def n4(t):
    return t("documents").select("doc_id", T.first_words(F.col("text"), 16).alias("head"))


@query("n5_counts", f"SELECT doc_id, CAST(len({WORDS.format('text')}) AS INT) AS n_words, CAST(length(coalesce(text, '')) AS INT) AS n_characters FROM documents")
def n5(t):
    x = F.col("text")
    return t("documents").select("doc_id", T.word_count(x).alias("n_words"), T.char_count(x).alias("n_characters"))


@query("n6_alpha_tokens", "SELECT doc_id, md5(array_to_string(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z\\-]{2,}'), ' ')) AS digest FROM documents")
def n6(t):
    return t("documents").select("doc_id", F.md5(F.array_join(T.alpha_tokens(F.col("text")), " ")).alias("digest"))


TOKS = "list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z][A-Za-z\\-]{{2,}}'), lambda w: lower(w))"


@query(
    "n7_source_only_hints",
    f"""WITH {V.QA}, k AS (SELECT qid, {TOKS.format('question')} AS s, {TOKS.format('answer')} AS g FROM qa),
    d AS (SELECT qid, g, list_filter(s, lambda w, i: list_position(s, w) = i) AS s FROM k)
    SELECT qid, array_to_string(list_filter(s, lambda w: NOT list_contains(g, w) AND NOT list_contains({lst(T.HINT_STOPS)}, w))[1:6], ' ') AS hints FROM d""",
)
def n7(t):
    hints = T.source_only_hints(F.col("question"), F.col("answer"))
    return V.qa_pairs(t).select("qid", F.array_join(hints, " ").alias("hints"))


@query(
    "n8_sentences",
    f"""SELECT doc_id, CAST(len(s) AS INT) AS n, md5(array_to_string(s, chr(1))) AS digest FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', concat('\\1', chr(2)), 'g'), chr(2)), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS s FROM documents)""",
)
def n8(t):
    s = T.sentences(F.col("text"))
    return t("documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "\x01")).alias("digest"))


@query(
    "n9_n10_types_and_personas",
    """SELECT o_orderkey AS id, CASE WHEN trim(k) IN ('Obligation','Prohibition','Permission','Definition','Scope','Procedure','Other') THEN trim(k) ELSE 'Other' END AS item_type,
    CASE WHEN starts_with(lower(trim(p)), 'basic') THEN 'Basic' WHEN starts_with(lower(trim(p)), 'prof') THEN 'Professional' ELSE concat(upper(lower(trim(p))[1]), lower(trim(p))[2:]) END AS persona,
    CASE WHEN contains(lower(p), 'basic') THEN 'basic' WHEN contains(lower(p), 'prof') THEN 'professional' ELSE 'UNKNOWN' END AS bucket
    FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' Scope ' WHEN 1 THEN 'scope' WHEN 2 THEN 'Obligation' ELSE o_orderpriority END AS k,
    CASE o_orderkey % 4 WHEN 0 THEN 'basic user' WHEN 1 THEN ' PROFESSIONAL' WHEN 2 THEN 'expert' ELSE 'non-basic' END AS p FROM orders)""",
)
def n9_n10(t):
    k = F.col("o_orderkey") % 4
    o = t("orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(k == 0, " Scope ").when(k == 1, "scope").when(k == 2, "Obligation").otherwise(F.col("o_orderpriority")).alias("k"),
        F.when(k == 0, "basic user").when(k == 1, " PROFESSIONAL").when(k == 2, "expert").otherwise("non-basic").alias("p"),
    )
    return o.select("id", T.item_type(F.col("k")).alias("item_type"), T.persona(F.col("p")).alias("persona"), T.persona_bucket(F.col("p")).alias("bucket"))


@query(
    "n11_n12_cross_document_labels",
    """SELECT a.doc_id AS id, CASE WHEN coalesce(a.source, '') = '' OR coalesce(b.source, '') = '' THEN 'UNKNOWN' WHEN a.source = b.source THEN 'intra' ELSE 'cross' END AS label,
    coalesce(nullif(b.lang, ''), nullif(a.lang, ''), 'UNKNOWN') AS attribute FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id * 2""",
)
def n11_n12(t):
    d = t("documents")
    other = d.select((F.col("doc_id")).alias("twice"), F.col("source").alias("target"), F.col("lang").alias("target_lang"))
    joined = d.join(other, F.col("twice") == F.col("doc_id") * 2, "left")
    return joined.select(
        F.col("doc_id").alias("id"), T.cross_document(F.col("source"), F.col("target")).alias("label"),
        F.coalesce(T.first_filled(F.col("target_lang"), F.col("lang")), F.lit("UNKNOWN")).alias("attribute"),
    )


@query(
    "n13_n14_json_replies",
    """SELECT event_id, nullif(regexp_extract(reply, '(?s)\\{.*\\}', 0), '') AS block, TRY_CAST(json_extract_string(nullif(regexp_extract(reply, '(?s)\\{.*\\}', 0), ''), '$.final_score') AS INT) AS score
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('```json', chr(10), '{"final_score": ', CAST(event_id % 12 AS VARCHAR), '}', chr(10), '```')
    WHEN 1 THEN concat('Sure: {"final_score": "', CAST(event_id % 9 AS VARCHAR), '"} done') ELSE 'no json' END AS reply FROM events)""",
)
def n13_n14(t):
    k, text = F.col("event_id") % 3, lambda n: (F.col("event_id") % n).cast("string")
    reply = (
        F.when(k == 0, F.concat(F.lit('```json\n{"final_score": '), text(12), F.lit("}\n```")))
        .when(k == 1, F.concat(F.lit('Sure: {"final_score": "'), text(9), F.lit('"} done'))).otherwise("no json")
    )
    block = T.json_block(T.unfenced(reply))
    return t("events").select("event_id", block.alias("block"), F.get_json_object(block, "$.final_score").try_cast("int").alias("score"))


@query(
    "n15_n17_n18_scores",
    """SELECT event_id, greatest(0, least(5, s)) AS clamped, CASE WHEN s BETWEEN 0 AND 5 THEN s END AS in_range, CAST(round_even(s / 2.0, 0) AS INT) AS half FROM (SELECT event_id, CAST(event_id % 11 AS INT) - 3 AS s FROM events)""",
)
def n15_n17_n18(t):
    s = ((F.col("event_id") % 11).cast("int") - 3).alias("s")
    half = F.bround(F.col("s") / 2.0, 0).cast("int")
    return t("events").select("event_id", s).select("event_id", T.clamped_score(F.col("s")).alias("clamped"), T.score_in_range(F.col("s")).alias("in_range"), half.alias("half"))


@query(
    "n16_providers",
    """SELECT o_orderkey AS id, CASE WHEN starts_with(lower(m), 'hf:') THEN 'hf' WHEN contains(lower(m), 'gemini') THEN 'gemini' WHEN contains(lower(m), 'claude') OR contains(lower(m), 'anthropic') THEN 'anthropic' ELSE 'openai' END AS provider
    FROM (SELECT o_orderkey, ['hf:gemini-x', 'Gemini-2', 'claude-3', 'Anthropic/x', 'gpt-4o', ''][CAST(o_orderkey % 6 AS INT) + 1] AS m FROM orders)""",
)
def n16(t):
    names = F.array(*map(F.lit, ["hf:gemini-x", "Gemini-2", "claude-3", "Anthropic/x", "gpt-4o", ""]))
    return t("orders").select(F.col("o_orderkey").alias("id"), T.provider(F.get(names, (F.col("o_orderkey") % 6).cast("int"))).alias("provider"))


@query("n19_n20_hashes_and_logs", "SELECT doc_id, sha256(concat(coalesce(source, ''), '||', coalesce(lang, ''), '||', coalesce(text, ''))) AS id, round(log2(n_chars + 1), 6) AS bits FROM documents")
def n19_n20(t):
    return t("documents").select("doc_id", T.content_id(F.col("source"), F.col("lang"), F.col("text")).alias("id"), F.round(F.log2(F.col("n_chars") + 1), 6).alias("bits"))


LETTERS = "list_transform(regexp_extract_all(x, '[a-zA-Z]+'), lambda w: lower(w))"
TITLE = f"""(CASE WHEN length(x) <= 80 AND length(x) - length(replace(x, ' ', '')) <= 12 THEN 2 ELSE 0 END
 + CASE WHEN NOT regexp_matches(x, '[.!?]$') THEN 1 ELSE 0 END
 + CASE WHEN len(list_filter({WORDS.format('x')}, lambda w: regexp_matches(w, '^[A-Z][a-zA-Z0-9\\-]*$'))) / greatest(1, len({WORDS.format('x')})) >= 0.40 THEN 1 ELSE 0 END
 + CASE WHEN len(list_filter({LETTERS}, lambda w: list_contains({lst(T.TITLE_STOPS)}, w))) / greatest(1, len({LETTERS})) <= 0.18 THEN 1 ELSE 0 END
 + CASE WHEN NOT regexp_matches(x, '[,;:]') THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(x, '{T.HEADING}') THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches(x, '{T.NUMBERED_HEADING}') THEN 2 ELSE 0 END)"""


@query("t1_f4_titles", f"WITH s AS (SELECT doc_id, {COLLAPSE.format('text')} AS x FROM documents) SELECT doc_id, {TITLE} AS points, x = '' OR {TITLE} >= 3 AS title FROM s")
def t1(t):
    return t("documents").select("doc_id", T.title_score(F.col("text")).alias("points"), T.is_title(F.col("text")).alias("title"))


@query(
    "t2_t8_t9_citations",
    f"SELECT page_id, regexp_matches(html, '{T.CITATION_SHAPE}') AS shape, regexp_matches(html, '{T.JUDGE_CITATION}') AS judge, regexp_matches(html, '{T.INSPECTION_CITATION}') AS inspection FROM pages",
)
def t2_t8_t9(t):
    x = F.col("html")
    return t("pages").select("page_id", T.looks_like_citation(x).alias("shape"), T.has_judge_citation(x).alias("judge"), T.has_inspection_citation(x).alias("inspection"))


HOOK = f"{STRIP.format(chr(123) + '0' + chr(125))}"


@query(
    "t3_t4_t5_hooks",
    f"""WITH h AS (SELECT doc_id, text, text AS hook FROM documents),
    c AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace({STRIP.format('hook')}, '{T.CLAUSE_TAIL}', ''), '{T.CITATION_TOKEN}', '', 'g'), '\\s+', ' ', 'g'), ' ,.;:-') AS x FROM h),
    s AS (SELECT doc_id, text, CASE WHEN len({WORDS.format('x')}) > 12 THEN array_to_string({WORDS.format('x')}[1:12], ' ') ELSE x END AS x FROM c)
    SELECT doc_id, coalesce(nullif(x, ''), {COLLAPSE.format("regexp_extract(text, '[A-Za-z][A-Za-z ,''\\-\\(\\)]{20,120}', 0)")}) AS hook,
    coalesce(nullif({STRIP.format('text')}, ''), 'model hook') AS citation FROM s""",
)
def t3_t5(t):
    x = F.col("text")
    return t("documents").select("doc_id", T.hook_or_phrase(T.semantic_hook(x), x).alias("hook"), T.citation_hook(x, F.lit("model hook")).alias("citation"))


@query(
    "t6_n22_spans",
    """WITH s AS (SELECT doc_id, text, [
      {'text': substr(text, 3, 8), 'start': 2, 'end': 10, 'type': 'DATE'}, {'text': 'nope', 'start': 0, 'end': 4, 'type': 'TERM'},
      {'text': text, 'start': 0, 'end': CAST(length(text) AS INT), 'type': 'odd'}, {'text': substr(text, 1, 2), 'start': 0, 'end': 2, 'type': 'TERM'}] AS spans FROM documents),
    v AS (SELECT doc_id, text, list_filter(list_transform(spans[1:3], lambda x: {'text': x.text, 'start': x.start, 'end': x.end, 'type': CASE WHEN x.type IN ('DURATION','DATE','MONEY','PERCENT','TERM','SECTION','FREEFORM') THEN x.type ELSE 'FREEFORM' END}),
      lambda x: x.start >= 0 AND x.start < x.end AND x.end <= length(text) AND substr(text, x.start + 1, x.end - x.start) = x.text AND NOT (x.type = 'FREEFORM' AND x.end - x.start = length(text) AND length(text) > 220)) AS ok FROM s)
    SELECT doc_id, CAST(len(ok) AS INT) AS n, array_to_string(list_transform(ok, lambda x: x.type), ',') AS kinds,
    CASE WHEN len(ok) = 0 THEN 'none' WHEN len(list_filter(ok, lambda x: x.type <> 'FREEFORM')) > 0 THEN 'structured' ELSE 'freeform-only' END AS mode FROM v""",
)
def t6_n22(t):
    x = F.col("text")
    span = lambda text, start, end, kind: F.struct(text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("type"))
    spans = F.array(
        span(F.substring(x, 3, 8), F.lit(2), F.lit(10), "DATE"), span(F.lit("nope"), F.lit(0), F.lit(4), "TERM"),
        span(x, F.lit(0), F.length(x), "odd"), span(F.substring(x, 1, 2), F.lit(0), F.lit(2), "TERM"),
    )
    d = t("documents").select("doc_id", T.valid_spans(spans, x).alias("ok"))
    return d.select("doc_id", F.size("ok").alias("n"), F.array_join(F.transform("ok", lambda s: s["type"]), ",").alias("kinds"), T.span_mode(F.col("ok")).alias("mode"))


@query("t7_fallback_spans")
def t7(t):
    return t("documents").select("doc_id", T.fallback_span(F.col("text")).alias("s")).select("doc_id", "s.*")


TAGGED = "concat(answer, ' [#SRC:', CAST(conv_id AS VARCHAR), ']', CASE WHEN turn % 4 = 0 THEN concat(' [#TGT:', CAST(turn AS VARCHAR), ']') ELSE '' END)"
BOTH = f"(contains({TAGGED}, concat('[#SRC:', CAST(conv_id AS VARCHAR), ']')) AND contains({TAGGED}, concat('[#TGT:', CAST(turn AS VARCHAR), ']')))"


def tagged(t):
    target = F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" [#TGT:"), F.col("turn").cast("string"), F.lit("]"))).otherwise("")
    return V.qa_pairs(t).withColumn("answer", F.concat(F.col("answer"), F.lit(" [#SRC:"), F.col("conv_id").cast("string"), F.lit("]"), target))


@query("f6_evidence_tags", f"WITH {V.QA} SELECT qid, {BOTH} AS plain, {BOTH} AND conv_id <> turn AS distinct_ids, {BOTH} AS filled_ids FROM qa")
def f6(t):
    ids = (F.col("answer"), F.col("conv_id"), F.col("turn"))
    return tagged(t).select("qid", T.has_tags(*ids).alias("plain"), T.has_tags(*ids, distinct_ids=True).alias("distinct_ids"), T.has_tags(*ids, filled_ids=True).alias("filled_ids"))


PREVIOUS = f"""WITH {V.QA}, p AS (SELECT qid, answer, coalesce(lag(answer) OVER (PARTITION BY conv_id ORDER BY turn), question) AS gold FROM qa)"""


def gold_pairs(t):
    from pyspark.sql import Window

    before = F.lag("answer").over(Window.partitionBy("conv_id").orderBy("turn"))
    return V.qa_pairs(t).withColumn("gold", F.coalesce(before, F.col("question")))


def f1_sql(tokens: str) -> str:
    a, b = tokens.format("gold"), tokens.format("answer")
    return f"""{PREVIOUS}, k AS (SELECT qid, {a} AS a, {b} AS b FROM p),
    x AS (SELECT qid, w, count(*) AS n FROM (SELECT qid, unnest(a) AS w FROM k) GROUP BY ALL),
    y AS (SELECT qid, w, count(*) AS n FROM (SELECT qid, unnest(b) AS w FROM k) GROUP BY ALL),
    c AS (SELECT qid, sum(least(x.n, y.n)) AS shared FROM x JOIN y USING (qid, w) GROUP BY qid)
    SELECT k.qid, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 OR coalesce(shared, 0) = 0 THEN 0.0
    ELSE 2.0 * shared / (len(a) + len(b)) END, 6) AS f1 FROM k LEFT JOIN c USING (qid)"""


@query("m6_token_f1_squad", f1_sql(WORDS.format(SQUAD)))
def m6(t):
    return gold_pairs(t).select("qid", F.round(O.token_f1(F.col("gold"), F.col("answer"), "squad"), 6).alias("f1"))


@query("m7_token_f1_plain", f1_sql(WORDS.format("lower({0})")))
def m7(t):
    return gold_pairs(t).select("qid", F.round(O.token_f1(F.col("gold"), F.col("answer"), "plain"), 6).alias("f1"))


def rouge_sql(tokens: str, both_empty: str) -> str:
    """The longest common subsequence row by row: the best of going on, of skipping, and of what stands to the left."""
    a, b = tokens.format("gold"), tokens.format("answer")
    return f"""{PREVIOUS.replace("WITH ", "WITH RECURSIVE ")}, k AS (SELECT qid, {a} AS a, {b} AS b FROM p),
    dp AS (SELECT qid, a, b, 0 AS i, list_transform(range(0, len(a) + 1), lambda x: 0::BIGINT) AS row FROM k
      UNION ALL SELECT qid, a, b, i + 1, list_concat([0::BIGINT], list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])))
      FROM (SELECT *, list_transform(range(1, len(a) + 1), lambda h: greatest(row[h + 1], row[h] + CASE WHEN a[h] = b[i + 1] THEN 1 ELSE 0 END)) AS c FROM dp WHERE i < len(b))),
    l AS (SELECT qid, len(a) AS n, len(b) AS m, row[len(a) + 1] AS s FROM dp WHERE i = len(b))
    SELECT qid, round(CASE WHEN n = 0 AND m = 0 THEN {both_empty} WHEN n = 0 OR m = 0 OR s = 0 THEN 0.0 ELSE 2.0 * s / (n + m) END, 6) AS rouge_l FROM l"""


@query("m8_m10_rouge_l_squad", rouge_sql(WORDS.format(SQUAD), "0.0"))
def m8(t):
    return gold_pairs(t).select("qid", F.round(O.rouge_l(F.col("gold"), F.col("answer"), "squad"), 6).alias("rouge_l"))


@query("m9_m10_rouge_l_plain", rouge_sql(WORDS.format("lower({0})"), "1.0"))
def m9(t):
    return gold_pairs(t).select("qid", F.round(O.rouge_l(F.col("gold"), F.col("answer"), "plain"), 6).alias("rouge_l"))
