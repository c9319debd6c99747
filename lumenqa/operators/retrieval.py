"""Retrieval: BM25 over an inverted index, exact dense search in blocks, reranking and reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenqa.session import shared_dir

TOKEN = r"[a-z0-9]+"
BROADCAST_QUERIES = 64 << 20  # bytes of query vectors that may go to every task at once
SEARCH_CELLS = 1 << 22  # scores a task holds at once


def lowered(x: Column) -> Column:
    """Lower case as the statements have it: a dotted capital I is one letter, where Java makes two characters of it."""
    return F.lower(F.replace(F.coalesce(x, F.lit("")), F.lit("\u0130"), F.lit("i")))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(lowered(x), F.lit(TOKEN), 0)


def top_k(scored: DataFrame, k: int, by: list[str], *ties: str | Column) -> DataFrame:
    """The k best rows of each group by score, then by the ties ascending, with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def matches(passages: DataFrame, queries: DataFrame) -> DataFrame:
    """Postings that queries (qid, query) meet in passages (pid, text): qid, terms, pid, term, tf, df, size, and the collection's n and avg_size.

    Only postings of query terms are kept. Collection statistics are one row, attached by an aggregate of one row;
    document frequencies join by term, so a common term is skewed only as far as its postings are.
    """
    asked = queries.select("qid", F.array_distinct(tokens(F.col("query"))).alias("ts"))
    terms = asked.select("qid", F.size("ts").alias("terms"), F.explode("ts").alias("term"))
    stats = passages.agg(F.count(F.lit(1)).alias("n"), F.avg(F.regexp_count(lowered(F.col("text")), F.lit(TOKEN))).alias("avg_size"))
    worded = passages.select("pid", tokens(F.col("text")).alias("w")).select("pid", F.size("w").alias("size"), F.explode("w").alias("term"))
    wanted = worded.join(terms.select("term").distinct(), "term", "left_semi")
    tf = wanted.groupBy("term", "pid", "size").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.join(tf.join(df, "term").join(F.broadcast(stats)), "term")  # stats are a single row


def bm25_weight(k1: float, b: float) -> Column:
    """What one posting of ``matches`` adds to BM25, with idf ln(1 + (N - df + .5) / (df + .5))."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("avg_size")))


def bm25(passages: DataFrame, queries: DataFrame, k: int = 10, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(qid, pid, score, rank): the k best passages of each query by BM25. Ties go to the lower pid."""
    scored = matches(passages, queries).groupBy("qid", "pid").agg(F.round(F.sum(bm25_weight(k1, b)), 9).alias("score"))
    return top_k(scored, k, ["qid"], "pid")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of scores, ties to the lower id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def block_search(queries, k: int):
    """Arrow function: the k best of each task's vectors for each query, in blocks of SEARCH_CELLS scores at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = queries.value
        best_s, best_i = np.full((len(qids), k), -np.inf), np.full((len(qids), k), np.iinfo(np.int64).max)
        for batch in batches:
            if not batch.num_rows or not len(qids):
                continue
            ids = np.asarray(batch.column(0))
            v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            rows = max(1, SEARCH_CELLS // len(v))
            for at in range(0, len(qids), rows):
                part = slice(at, at + rows)
                s = np.round(q[part] @ v.T, 9)
                s[qids[part, None] == ids[None, :]] = -np.inf
                better = np.flatnonzero(s.max(axis=1) >= best_s[part, -1])  # the others keep what they have
                if not len(better):
                    continue
                new_s, new_i = s[better], np.broadcast_to(ids, (len(better), len(ids)))
                if new_s.shape[1] > 4 * k:  # all that reach the k-th score stay, so ties are decided by id below
                    least = np.partition(new_s, -k, axis=1)[:, -k]
                    wide = int((new_s >= least[:, None]).sum(axis=1).max())
                    pick = np.argpartition(-new_s, wide - 1, axis=1)[:, :wide]
                    new_s, new_i = np.take_along_axis(new_s, pick, 1), np.take_along_axis(new_i, pick, 1)
                at_rows = better + at
                best_s[at_rows], best_i[at_rows] = best_of(np.hstack([best_s[at_rows], new_s]), np.hstack([best_i[at_rows], new_i]), k)
        found = np.isfinite(best_s)
        row = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(best_i[found]), pa.array(best_s[found])], names=["qid", "pid", "score"])

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, query_bytes: int = BROADCAST_QUERIES) -> DataFrame:
    """(qid, pid, score, rank): exact cosine search of queries (qid, vector) in vectors (pid, vector), a query's own pid left out.

    Query vectors up to ``query_bytes`` go to every task, and each task sends k rows a query. More queries than that are
    taken in passes, one after another: each pass collects and broadcasts its own share of the queries alone and is
    checkpointed before the next, so driver and executors never hold more than one share.
    """
    spark = vectors.sparkSession
    n = queries.count()
    width = len((queries.select("vector").first() or [[]])[0])
    passes = max(1, -(-n * max(width, 1) * 8 // query_bytes))
    if passes > 1:
        shared_dir(spark)
    parts = []
    for i in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i).select("qid", "vector").toPandas()
        q = np.stack(rows["vector"]).astype(np.float64) if len(rows) else np.zeros((0, width))
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((rows["qid"].to_numpy(np.int64), q))
        part = vectors.select(F.col("pid").cast("long"), "vector").mapInArrow(block_search(shared, k), "qid long, pid long, score double")
        if passes > 1:
            part = top_k(part, k, ["qid"], "pid").drop("rank").checkpoint()
            shared.destroy()
        parts.append(part)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return top_k(found, k, ["qid"], "pid")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, depth: int, k: int) -> DataFrame:
    """First-stage rows (qid, pid, rank) up to ``depth`` scored anew by cosine; unknown pids and queries drop out."""
    kept = candidates.where(F.col("rank") <= depth).select("qid", "pid")
    joined = kept.join(vectors.select("pid", F.col("vector").alias("v")), "pid").join(queries.select("qid", F.col("vector").alias("q")), "qid")
    return top_k(joined.select("qid", "pid", F.round(cosine(F.col("q"), F.col("v")), 9).alias("score")), k, ["qid"], "pid")


def rrf(lists: list[DataFrame], k: int, constant: int = 60, depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, pid, rank), each up to ``depth``.

    A document listed twice in one list adds up. Equal scores keep the order of first sight: earlier list, then rank, then pid.
    """
    marked = [x.select("qid", "pid", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    union = marked[0]
    for x in marked[1:]:
        union = union.unionByName(x)
    if depth is not None:
        union = union.where(F.col("rank") <= depth)
    fused = union.groupBy("qid", "pid").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "seen", "pid")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "pid", "score", "rank")


def qa_queries(qas: DataFrame) -> DataFrame:
    """(qid, query) of QAs in input order ``pos``: the first question of each id."""
    first = Window.partitionBy("qid").orderBy("pos")
    return qas.withColumn("n", F.row_number().over(first)).where("n = 1").select("qid", F.col("question").alias("query"))


def qa_qrels(qas: DataFrame, distinct: bool = True) -> DataFrame:
    """(qid, docid): both passages of each QA are relevant; duplicates stay or go by ``distinct``."""
    both = qas.select("qid", F.explode(F.filter(F.array("source_id", "target_id"), lambda x: x.isNotNull() & (x.cast("string") != ""))).alias("docid"))
    return both.distinct() if distinct else both
