"""The queries over the given tables, with their DuckDB statements where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenqa.llm import audio, bpe_automaton, decontamination, language_crf, ngram_join, sharding, substring_dedup, token_store, toxicity, url_filter
from lumenqa.llm.workspace import Workspace
from lumenqa.session import reachable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    media = work.table(audio.stored(table(spark, sf_dir, "documents"), unit=64), "media")
    found = work.table(audio.features(media, tail=64), "features")  # with the tensors
    work.forget("media")
    digest = F.concat_ws(
        ";",
        F.format_string("frames=%d", "frames"),
        F.format_string("segments=%d", F.size("spans")),
        F.concat(F.lit("active="), F.to_json("spans")),
        F.concat(F.lit("mel="), F.array_join("mean_mel", ",")),
        F.concat(F.lit("tensors="), F.sha2("tensors", 256)),
    )
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return found.select(*columns, F.sha2(digest, 256).alias("feature"), "frames", F.size("spans").alias("segments"))


def op3_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(url_filter.captures_of(pages), url_filter.listed_history(pages)).drop("url")


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score = toxicity.scored(docs.select("doc_id", "text"), model)
    return score.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = language_crf.identified(docs.select("doc_id", "text"), language_crf.learn(docs))
    return said.select("doc_id", language_crf.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def tokenizer_path() -> str:
    """The tokenizer file the contract names; it is read where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_rans_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    blocks, freq = token_store.write_tokens(table(spark, sf_dir, "documents"), work, tokenizer_path(), end_id=1)
    return token_store.read_tokens(blocks, freq)


def op8_automaton_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_automaton.coded(docs, tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def op9_bayes_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), work, threshold=0.8).drop("kept")


def op10_countmin_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), work, size=20)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {
    "op1_feistel_sharding": op1_feistel_sharding,
    "op2_audio_features": op2_audio_features,
    "op3_temporal_url_filter": op3_temporal_url_filter,
    "op4_rans_token_store": op4_rans_token_store,
    "op5_compression_toxicity": op5_compression_toxicity,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_crf_language": op7_crf_language,
    "op8_automaton_bpe": op8_automaton_bpe,
    "op9_bayes_ngram_join": op9_bayes_ngram_join,
    "op10_countmin_substring_dedup": op10_countmin_substring_dedup,
}

ORACLE_SQL = {"op3_temporal_url_filter": url_filter.ORACLE}
