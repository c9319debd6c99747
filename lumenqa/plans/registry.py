"""All table-computable queries by name, each with its DuckDB statement where SQL expresses it.

A query module registers functions of a ``Tables`` accessor; names begin with the operator they show. Statements may
use the shared views of ``VIEWS`` as common table expressions, which mirror lumenqa.plans.views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenqa.session import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Reads the tables of one folder by name: ``t("documents")``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        reachable(spark)

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return add


from lumenqa.plans import dataset_queries, judge_queries, retrieval_queries, source_queries, text_queries  # noqa: E402, F401
