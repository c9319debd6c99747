"""The stages of a dataset end to end: candidate pairs, schema items, generated QAs, curation, final recipes, answers and their scores.

Model replies come in as columns (see functions.scorers); everything else here is an expression over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenqa.functions import overlap
from lumenqa.functions import text as T
from lumenqa.operators import curation as C

REFERENCE_TYPES = ("internal", "external")


def candidate_pairs(pairs: DataFrame, skip_degenerate: bool, drop_titles: bool) -> DataFrame:
    """``pairs`` (source_id, target_id, source_text, target_text, reference_type?) with reason: kept, or why the pair is none.

    A pair counts under the first reason that holds.
    """
    s, g = F.col("source_text"), F.col("target_text")
    reasons = {}
    if "reference_type" in pairs.columns:
        reasons["reference_type"] = ~F.coalesce(F.lower("reference_type").isin(*REFERENCE_TYPES), F.lit(False))
    reasons["empty"] = T.is_blank(s) | T.is_blank(g)
    if skip_degenerate:
        reasons["degenerate"] = C.degenerate(F.col("source_id"), F.col("target_id"), s, g)
    if drop_titles:
        reasons["title"] = T.is_title(g)
    return pairs.withColumn("reason", C.first_reason(**reasons))


def reason_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


EXTRACTED = (
    "struct<semantic_hook:string,citation_hook:string,source_item_type:string,target_item_type:string,"
    "answer_spans:array<struct<text:string,start:int,end:int,type:string>>>"
)


def schema_items(pairs: DataFrame) -> DataFrame:
    """Schema items from pairs with a model reply: hooks sanitised, item types coerced, spans validated with a fallback.

    A reply that is no JSON object leaves everything to the fallbacks. Items of equal content are made once, the first by
    (source_id, target_id).
    """
    r = F.from_json(T.json_block(T.unfenced(F.col("reply"))), EXTRACTED)
    target = F.col("target_text")
    spans = T.valid_spans(F.coalesce(r["answer_spans"], F.array().cast("array<struct<text:string,start:int,end:int,type:string>>")), target)
    fallback = T.fallback_span(target)
    one = F.array(F.struct(fallback["text"].alias("text"), fallback["start"].alias("start"), fallback["end"].alias("end"), F.lit("FREEFORM").alias("type")))
    title = T.is_title(target)
    none = F.array().cast("array<struct<text:string,start:int,end:int,type:string>>")
    hook = T.semantic_hook(T.first_words(r["semantic_hook"], 16))
    items = pairs.select(
        "source_id", "target_id", "source_text", "target_text", "reference_text",
        T.hook_or_phrase(hook, F.col("source_text")).alias("semantic_hook"), T.citation_hook(F.col("reference_text"), r["citation_hook"]).alias("citation_hook"),
        F.coalesce(T.item_type(r["source_item_type"]), F.lit("Other")).alias("source_item_type"), F.coalesce(T.item_type(r["target_item_type"]), F.lit("Other")).alias("target_item_type"),
        title.alias("target_is_title"), F.when(F.size(spans) > 0, spans).when(title | fallback.isNull(), none).otherwise(one).alias("answer_spans"),
    )
    columns = ["source_id", "target_id", "source_text", "target_text", "reference_text"]
    return C.content_dedup(items, columns, "source_id", "target_id").withColumnRenamed("content_id", "item_id")


def generated_qas(rows: DataFrame, method: str, most: int, distinct_ids: bool) -> DataFrame:
    """QAs from exploded replies (source_id, target_id, pos, persona, question, expected_answer).

    Answers must name both passages. Questions are deduplicated over everything, the first by pos winning, and only then
    at most ``most`` of each pair and persona stay.
    """
    tagged = rows.where(T.has_tags(F.col("expected_answer"), F.col("source_id"), F.col("target_id"), distinct_ids=distinct_ids))
    keyed = tagged.withColumn("_key", T.question_key(F.col("question")))
    first = C.first_wins(keyed, "_key", "pos", "persona", "question").drop("_key")
    capped = C.capped_per_group(first, ["source_id", "target_id", "persona"], most, "pos", "question").drop("n_in_group")
    qa_id = T.content_id(F.lit(method), F.col("persona"), F.col("source_id").cast("string"), F.col("target_id").cast("string"), F.col("question"))
    return capped.withColumn("qa_id", qa_id).withColumn("method", F.lit(method))


def curated(judgments: DataFrame, generated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, eliminated, unmatched judgments); of several judgments of a QA the last by pos counts."""
    last = C.last_wins(judgments.select("qa_id", "pos", "passed", "final_score"), "qa_id", "pos").drop("pos")
    joined = generated.join(last, "qa_id")
    return joined.where("passed"), joined.where("NOT coalesce(passed, false)"), C.unmatched(last, generated.select("qa_id"), "qa_id")


def recipe_thresholds(kept: DataFrame, ir: DataFrame, answers: DataFrame, least: int = 4, seed: int = 13) -> DataFrame:
    """Kept QAs that at least ``least`` retrievers and ``least`` answer pipelines got right, split 80/10/10 by method."""
    good_ir = ir.where(F.coalesce("num_methods_hit_any", F.lit(0)) >= least).select(F.col("qid").alias("qa_id"))
    good_answer = answers.where(F.coalesce("num_methods_success", F.lit(0)) >= least).select("qa_id")
    chosen = kept.join(good_ir, "qa_id", "left_semi").join(good_answer, "qa_id", "left_semi")
    return C.assign_splits(chosen.withColumn("_k", F.crc32("qa_id")), "_k", (0.8, 0.1, 0.1), seed, ["method"]).drop("_k")


def recipe_drop_low(kept: DataFrame, ir: DataFrame, seed: int = 42) -> DataFrame:
    """Kept QAs with agreement data but not low agreement, with sequential ids by method, split 70/15/15."""
    known = ir.select(F.col("qid").alias("qa_id"), F.coalesce("low_concordance_any", F.lit(False)).alias("low"))
    chosen = kept.join(known, "qa_id").where("NOT low").drop("low")
    numbered = C.numbered_in_order(chosen, "qa_id", by=["method"], name="_no").withColumn("id", F.format_string("%s_%06d", "method", "_no"))
    return C.assign_splits(numbered, "_no", (0.7, 0.15, 0.15), seed, ["method"], strict=True).drop("_no")


def contexts(run: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(qid, contexts): the texts of the first k retrieved passages in order; unknown passages drop out."""
    first = run.groupBy("qid", "docid").agg(F.min("rank").alias("rank"))
    top = first.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "docid"))).where(F.col("at") <= k)
    got = top.join(passages.select(F.col("pid").alias("docid"), "text"), "docid")
    return got.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("at", "docid", "text"))).alias("contexts"))


def oracle_contexts(qas: DataFrame, passages: DataFrame) -> DataFrame:
    """(qa_id, contexts): the QA's own two passages, each once, those in the corpus."""
    ids = qas.select("qa_id", F.posexplode(F.array_distinct(F.array("source_id", "target_id"))).alias("at", "docid"))
    got = ids.join(passages.select(F.col("pid").alias("docid"), "text"), "docid")
    return got.groupBy("qa_id").agg(F.sort_array(F.collect_list(F.struct("at", "docid", "text"))).alias("contexts"))


def scorable(answers: DataFrame) -> DataFrame:
    """The first answer of each QA by pos, if it is ok and neither side is blank; later answers do not stand in."""
    first = C.first_wins(answers, "qa_id", "pos")
    return first.where((F.col("status") == "ok") & ~T.is_blank(F.col("expected_answer")) & ~T.is_blank(F.col("rag_answer")))


def answer_metrics(answers: DataFrame, family: str) -> DataFrame:
    """``answers`` with f1 and rouge_l_f1 of one family."""
    gold, said = F.col("expected_answer"), F.col("rag_answer")
    return answers.withColumns({"f1": overlap.token_f1(gold, said, family), "rouge_l_f1": overlap.rouge_l(gold, said, family)})


def successful(f1: float = 0.45, faithfulness: float = 3.5, entailment: float = 0.35, contradiction: float = 0.2) -> Column:
    """All thresholds met; a missing metric counts as its worst."""
    worst = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(float(d)))
    return (worst("f1", 0) >= f1) & (worst("faithfulness", 0) >= faithfulness) & (worst("nli_entailment", 0) >= entailment) & (worst("nli_contradiction", 1) <= contradiction)


def spread_over_groups(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group in hash order: spot-check samples."""
    return C.stratified_sample(df, [group], n, key, seed)
