"""Writers for JSON lines, CSV, pipe tables, runs, relevance judgments, queries, and Markdown reports.

All go through Spark's commit protocol: a failed job leaves no half-written output, and overwriting replaces it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines that keep nulls; one folder for each combination of ``by``."""
    out = df.write.mode("overwrite").option("ignoreNullFields", False)
    (out.partitionBy(*by) if by else out).json(path)


def csv(df: DataFrame, path: str, columns: list[str] | None = None, sorted_union: bool = False) -> None:
    """CSV with a header of the given columns, or of all columns by name; nested values as JSON. Every file has the header."""
    names = columns or (sorted(df.columns) if sorted_union else df.columns)
    flat = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("struct", "array", "map") else F.col(c) for c in names]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def ragged(frames: list[DataFrame]) -> DataFrame:
    """Rows of different columns as one table, columns by name, absent ones null."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole.select(*sorted(whole.columns))


def pipe_table(df: DataFrame, path: str, order: list[str]) -> None:
    """``a | b`` lines under a header and a rule of dashes; the files follow each other in order, the first begins with the header."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    header = " | ".join(df.columns)
    lines = df.orderBy(*order).select(cells.alias("value"))
    top = df.sparkSession.createDataFrame([(header,), ("-" * len(header),)], "value string").coalesce(1)
    top.unionByName(lines).write.mode("overwrite").text(path)


def run_lines(run: DataFrame, tag: str) -> DataFrame:
    return run.select("qid", "rank", F.format_string(f"%s Q0 %s %d %.6f {tag}", F.col("qid").cast("string"), F.col("docid").cast("string"), "rank", "score").alias("value"))


def trec_run(run: DataFrame, path: str, tag: str) -> None:
    """``qid Q0 docid rank score tag`` lines, scores to six decimals, each query's lines together and by rank."""
    run_lines(run, tag).repartition("qid").sortWithinPartitions("qid", "rank").select("value").write.mode("overwrite").text(path)


def qrels(rels: DataFrame, path: str, distinct: bool = True) -> None:
    rows = rels.select("qid", "docid")
    rows = rows.distinct() if distinct else rows
    rows.select(F.format_string("%s 0 %s 1", F.col("qid").cast("string"), F.col("docid").cast("string")).alias("value")).write.mode("overwrite").text(path)


def query_tsv(queries: DataFrame, path: str) -> None:
    clean = F.regexp_replace("query", r"[\t\r\n]+", " ")
    queries.select(F.concat_ws("\t", F.col("qid").cast("string"), clean).alias("value")).write.mode("overwrite").text(path)


def collection(passages: DataFrame, path: str) -> None:
    """``{id, contents}`` JSON lines for an external indexer."""
    passages.select(F.col("pid").cast("string").alias("id"), F.col("text").alias("contents")).write.mode("overwrite").json(path)


def report(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON object."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def block(title: str, body: Column) -> Column:
    """A section, left out where its body is null or empty."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n")))


def markdown(items: DataFrame, path: str, title: Column, sections: dict[str, Column], order: list[str]) -> None:
    """One section a QA, with the blocks that it has; the files follow each other in order."""
    text = F.concat_ws("\n", F.concat(F.lit("# "), title), *[block(k, v) for k, v in sections.items()])
    items.orderBy(*order).select(text.alias("value")).write.mode("overwrite").text(path)


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Console lines: each column padded to its width."""
    return df.select(F.concat_ws(" ", *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in widths.items()]).alias("line"))
