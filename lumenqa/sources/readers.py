"""Readers for JSON lines, documents, tables, queries, relevance judgments and runs, with stated leniency.

Every reader declares its schema; a missing path is an empty table only where that is the reader's rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: str, mode: str = "lenient", missing_ok: bool = False) -> DataFrame:
    """JSON lines. lenient drops blank and malformed lines, strict raises on them.

    Fields are parsed whole, so a line broken in a column that nobody reads is still malformed.
    """
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    kept = StructType.fromDDL(schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    if mode == "strict":
        return lines.select(F.from_json("value", kept, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    marked = StructType([*kept.fields, *StructType.fromDDL(f"{CORRUPT} string").fields])
    rows = lines.select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return rows.where(F.col(f"r.{CORRUPT}").isNull()).select(*[F.col(f"r.{f.name}").alias(f.name) for f in kept.fields])


def jsonl_with_bad_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): the bad ones as file and text."""
    marked = StructType([*StructType.fromDDL(schema).fields, *StructType.fromDDL(f"{CORRUPT} string").fields])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    parsed = lines.select("file", "value", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    broken = F.col(f"r.{CORRUPT}").isNotNull()
    good = parsed.where(~broken).select(*[F.col(f"r.{f.name}").alias(f.name) for f in StructType.fromDDL(schema).fields])
    return good, parsed.where(broken).select("file", "value")


def json_by_extension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """.jsonl as lines, anything else as one JSON array."""
    if path.endswith(".jsonl"):
        return jsonl(spark, path, schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


DOCUMENT_ITEM = "array<struct<ID:string,DocumentID:string,PassageID:string,Passage:string,pid:string,text:string>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, status, ID, DocumentID, PassageID, Passage): documents that are a list of items or an object holding one.

    Items are sought under passages, Passages, items and Items, in that order. status is ok, empty or bad_structure;
    files without items keep one row.
    """
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    as_list = F.from_json("value", DOCUMENT_ITEM)
    inside = [F.from_json(F.get_json_object("value", f"$.{k}"), DOCUMENT_ITEM) for k in ("passages", "Passages", "items", "Items")]
    items = F.when(F.ltrim("value").startswith("["), as_list).otherwise(F.coalesce(*inside))
    found = raw.select("file", items.alias("items"))
    status = F.when(F.col("items").isNull(), "bad_structure").when(F.size("items") == 0, "empty").otherwise("ok")
    rows = found.select("file", status.alias("status"), F.explode_outer("items").alias("i"))
    filled = lambda *names: F.coalesce(*[F.nullif(F.trim(f"i.{n}"), F.lit("")) for n in names])
    return rows.select(
        "file", "status", filled("ID", "pid").alias("ID"), F.col("i.DocumentID").try_cast("int").alias("DocumentID"),
        filled("PassageID").alias("PassageID"), filled("Passage", "text").alias("Passage"),
    )


def manifest_documents(spark: SparkSession, manifest: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(passages, problems) of the files a manifest (DocumentID, title, json_file_path) names under ``root``.

    A problem is a file that is missing, has another structure, or holds no filled passage. The first passage of a pid wins.
    """
    found = documents(spark, f"{root}/*.json").withColumn("name", F.url_decode(F.regexp_extract("file", r"([^/]+)$", 1)))
    wanted = manifest.select("DocumentID", "title", F.regexp_extract("json_file_path", r"([^/]+)$", 1).alias("name"))
    joined = wanted.join(found.drop("DocumentID"), "name", "left")
    valid = F.col("Passage").isNotNull() & F.col("ID").isNotNull()
    state = joined.groupBy("DocumentID", "title", "name").agg(F.max("status").alias("status"), F.count_if(valid).alias("valid"))
    problem = F.when(F.col("status").isNull(), "missing").when(F.col("status") == "bad_structure", "bad_structure").when(F.col("valid") == 0, "no_valid_passage")
    problems = state.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("DocumentID", "title", "name", "problem")
    order = Window.partitionBy("ID").orderBy("DocumentID", "PassageID", "Passage")
    first = joined.where(valid).withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.select(F.col("ID").alias("pid"), F.col("Passage").alias("text"), F.col("DocumentID").alias("document_id"), F.col("PassageID").alias("passage_id")), problems


def csv_strings(spark: SparkSession, path: str, aliases: dict[str, str] | None = None, required: list[str] = ()) -> DataFrame:
    """CSV with a header, every value a string and empty cells empty strings; aliases rename, missing required columns raise."""
    df = spark.read.options(header=True, inferSchema=False, multiLine=True, quote='"', escape='"', nullValue="\0").csv(path)
    df = df.na.fill("")
    known = {c.strip().lower(): c for c in df.columns}
    renames = {known[a.lower()]: name for a, name in (aliases or {}).items() if a.lower() in known}
    df = df.withColumnsRenamed(renames)
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def query_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) split at the first tab, both stripped; lines without a tab are void."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.col("value").contains("\t")).select(F.trim(parts[0]).alias("qid"), F.trim(parts[1]).alias("query"))


def fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))


def qrels(spark: SparkSession, path: str, variant: str = "positive") -> DataFrame:
    """(qid, docid, rel). positive keeps rel > 0, all keeps every row and reads a bad rel as 0; short lines are void."""
    rel = F.coalesce(F.get("f", 3).try_cast("int"), F.lit(0))
    rows = fields(spark, path).where(F.size("f") >= 4).select(F.get("f", 0).alias("qid"), F.get("f", 2).alias("docid"), rel.alias("rel"))
    return rows.where("rel > 0") if variant == "positive" else rows


def run(spark: SparkSession, path: str, variant: str = "concordance", name: str | None = None) -> DataFrame:
    """(run, qid, docid, rank, score) of a ranked list. Lines of fewer than six fields are void in every variant.

    fusion: exactly six. eval and concordance: a line of more than six raises; a bad rank is 0. extrinsic: further fields
    ignored, a bad rank voids the line. rerank: further fields ignored.
    """
    f = fields(spark, path)
    rank, score = F.get("f", 3).try_cast("int"), F.get("f", 4).try_cast("double")
    if variant == "fusion":
        f = f.where(F.size("f") == 6)
    elif variant in ("eval", "concordance"):
        f = f.where(F.when(F.size("f") > 6, F.raise_error(F.lit("a run line has more than six fields")).cast("boolean")).otherwise(F.size("f") == 6))
        rank = F.coalesce(rank, F.lit(0))
    else:
        f = f.where(F.size("f") >= 6)
        if variant == "extrinsic":
            f = f.where(rank.isNotNull())
    label = F.lit(name) if name is not None else F.get("f", 5)
    return f.select(label.alias("run"), F.get("f", 0).alias("qid"), F.get("f", 2).alias("docid"), rank.alias("rank"), score.alias("score"))


def run_name(path: Column) -> Column:
    """The retriever a file's name stands for; the order of the tests decides."""
    low = F.lower(path)
    return (
        F.when(low.contains("oracle"), "ORACLE").when(low.contains("hybrid") | low.contains("rrf"), "HYBRID_RRF").when(low.contains("bm25_e5"), "BM25_E5_RERANK")
        .when(low.contains("bge"), "BGE").when(low.contains("e5"), "E5").when(low.contains("bm25"), "BM25").otherwise("UNKNOWN")
    )


def run_meta(path: Column) -> Column:
    """(method, subset, mode, retriever, model) that a per-QA file's name stands for."""
    low = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    has = low.contains
    retriever = run_name(F.regexp_replace(low, "bm25-?e5", "bm25_e5"))
    return F.struct(
        F.when(has("dpel"), "DPEL").when(has("schema"), "SCHEMA").otherwise("UNKNOWN").alias("method"),
        F.when(has("kept"), "kept").when(has("elim"), "eliminated").otherwise("UNKNOWN").alias("subset"),
        F.when(has("oracle"), "oracle").otherwise("realistic").alias("mode"),
        retriever.alias("retriever"),
        F.when(has("gpt4o") | has("gpt-4o"), "gpt4o").otherwise("UNKNOWN").alias("model"),
    )


def kept_run_meta(path: Column) -> Column:
    """(method, retriever) of the per-QA files of kept questions, no oracle; null for any other file.

    The name begins with the method and holds each part between underscores.
    """
    low = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    has = low.contains
    method = F.when(low.startswith("dpel_"), "DPEL").when(low.startswith("schema_"), "SCHEMA")
    retriever = (
        F.when(has("_bm25_e5_rerank_"), "BM25_E5_RERANK").when(has("_hybrid_rrf_bm25_e5_"), "HYBRID_RRF")
        .when(has("_bm25_"), "BM25").when(has("_bge_"), "BGE").when(has("_e5_"), "E5")
    )
    fits = low.endswith("_per_qa.jsonl") & method.isNotNull() & has("_kept_") & retriever.isNotNull() & ~has("_oracle_")
    return F.when(fits, F.struct(method.alias("method"), retriever.alias("retriever")))


def discovered(spark: SparkSession, pattern: str) -> DataFrame:
    """(path) of the files that a pattern names; their contents are not read."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").load(pattern).select("path")


def corpus(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(pid, text, document_id, passage_id) from rows under any of the known names; the last of an id (by pos) wins; empty raises if strict."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns], F.lit(None).cast("string"))
    named = rows.select(
        pick("pid", "id", "passage_id", "PassageID").alias("pid"), pick("text", "contents", "passage", "passage_text", "Passage").alias("text"),
        pick("document_id", "DocumentID").alias("document_id"), pick("passage_id", "PassageID").alias("passage_id"), F.col("pos") if "pos" in rows.columns else F.lit(0).alias("pos"),
    )
    kept = named.where("pid IS NOT NULL AND text IS NOT NULL").groupBy("pid").agg(F.max_by(F.struct("text", "document_id", "passage_id"), F.struct("pos", "text")).alias("r")).select("pid", "r.*")
    if strict and kept.isEmpty():
        raise ValueError("the corpus is empty")
    return kept


def questions(rows: DataFrame) -> DataFrame:
    """(id, question): the id falls back to the input position; rows without a question are void; none at all raises."""
    ids = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in ("id", "qa_id", "QuestionID") if n in rows.columns]
    kept = rows.select(F.coalesce(*ids, F.col("pos").cast("string")).alias("id"), "question").where(F.trim(F.coalesce("question", F.lit(""))) != "")
    if kept.isEmpty():
        raise ValueError("no questions")
    return kept


def test_set_qrels(items: DataFrame) -> DataFrame:
    """(qid, docid, rel): each filled id of the source and target fields is relevant."""
    names = [n for n in ("source_passage_id", "target_passage_id", "source_pid", "target_pid") if n in items.columns]
    ids = F.array_distinct(F.filter(F.array(*[F.trim(F.coalesce(n, F.lit(""))) for n in names]), lambda x: x != ""))
    return items.select(F.col("id").alias("qid"), F.explode(ids).alias("docid"), F.lit(1).alias("rel"))


def retrieved_run(rows: DataFrame, k: int) -> DataFrame:
    """(qid, docid, score) from records with an array retrieved: the first k entries, a doubled document by its best score."""
    each = rows.select(F.col("qa_id").alias("qid"), F.explode(F.slice("retrieved", 1, k)).alias("r"))
    return each.groupBy("qid", F.col("r.pid").alias("docid")).agg(F.max("r.score").alias("score"))


def split_files(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """The split files as one table; a row's own split wins over its file's."""
    parts = [jsonl(spark, p, schema).withColumn("file_split", F.lit(s)) for s, p in paths.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    own = F.nullif(F.col("split"), F.lit("")) if "split" in whole.columns else F.lit(None).cast("string")
    return whole.withColumn("split", F.coalesce(own, "file_split")).drop("file_split")


def keyed_lookup(rows: DataFrame) -> DataFrame:
    """Rows by qa_id or else qid; the last by pos wins."""
    names = [F.col(n) for n in ("qa_id", "qid") if n in rows.columns]
    keyed = rows.withColumn("key", F.coalesce(*names))
    rest = [c for c in rows.columns]
    return keyed.where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("key", "r.*")


def per_qa_metrics(spark: SparkSession, path: str, names: list[str], missing_ok: bool = True) -> DataFrame:
    """(qa_id, metrics...) as doubles, the last line of an id by file name, block of the file and place in it; an unreadable value is null."""
    ddl = ", ".join(["qa_id string", *[f"{n} string" for n in names]])
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], ", ".join(["qa_id string", *[f"{n} double" for n in names]]))
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place")).alias("pos")  # ids grow within a block
    lines = spark.read.text(path).select("value", at).where(F.trim("value") != "")
    rows = lines.select("pos", F.from_json("value", ddl).alias("r")).select("pos", "r.*")
    picked = rows.where("qa_id IS NOT NULL").groupBy("qa_id").agg(F.max_by(F.struct(*names), "pos").alias("r"))
    return picked.select("qa_id", *[F.col(f"r.{n}").try_cast("double").alias(n) for n in names])
