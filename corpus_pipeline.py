"""The corpus pipeline: five stages over ``documents``, each an operator of lumenqa.llm, each written before the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's docs. All but the last return the columns of ``documents``:

1. toxicity: documents scored 0.7 or more go;
2. n-gram join: of each class of documents linked at Jaccard 0.8 on five-word shingles the least doc_id stays;
3. substring dedup: words covered by a 20-word window that starts earlier elsewhere go; a document all of whose words
   go keeps its row with an empty text, and n_chars follows the text;
4. decontamination: documents that hold a benchmark item, verbatim or re-parameterised, go;
5. BPE: doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document left, with its lang and source.

SQL expresses neither compression lengths nor MinHash, tokenizers or automata, so there is no ORACLE_SQL; tests hold
each stage against its operator's brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenqa.llm import bpe_automaton, decontamination, ngram_join, substring_dedup, toxicity
from lumenqa.llm.entry import table, tokenizer_path
from lumenqa.llm.workspace import Workspace, scratch

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("tox_score < 0.7").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    return ngram_join.one_of_each(docs, work, threshold=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    cut = substring_dedup.remove_repeats(docs, work, size=20)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    made = {"text": text.alias("text"), "n_chars": n_chars.alias("n_chars")}
    return cut.select(*(made.get(c, F.col(c)) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe_automaton.coded(docs, tokenizer_path(), made).select("doc_id", "lang", "source", *made)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's table replaces the one before in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        work = Workspace(spark)
        with scratch():
            docs = work.table(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.drop()
        before = work
    return docs
