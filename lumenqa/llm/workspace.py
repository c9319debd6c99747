"""Shared scratch space for intermediate tables and helpers that walk Arrow text columns in bounded slices."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one is set only on a local master without any; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts are held in memory by both sides, so the session's default of 10,000 rows is lowered."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:  # never raised, and no result depends on it
        spark.conf.set(name, rows)


class Workspace:
    """Tables in the shared folder. They live until ``drop`` or until the application ends, so any result derived from
    them can be read at any time; nothing depends on which Python objects are still referenced."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        bounded_batches(spark)
        if scopes:
            scopes[-1].append(self)

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write and reread: lineage ends here and lost executors cost no recomputation."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        try:
            df.write.options(compression="zstd", **options).parquet(path)
        finally:
            on_path(self.spark, path, lambda store, p: store.deleteOnExit(p))
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, name: str) -> None:
        """Delete the tables of one name that later steps no longer read."""
        gone = [p for p in self.paths if not name or p.rsplit("/", 1)[1].startswith(f"{name}-")]
        for p in gone:
            on_path(self.spark, p, lambda store, at: store.delete(at, True))
        self.paths = [p for p in self.paths if p not in gone]

    def drop(self) -> None:
        """Delete all its tables; results that rest on them can no longer be read."""
        self.forget("")


#: Open scopes, innermost last; each lists the workspaces made in it.
scopes: list[list[Workspace]] = []


@contextlib.contextmanager
def scratch():
    """Drop on leaving every workspace made inside: for callers that write their result inside to one made outside."""
    scopes.append([])
    try:
        yield
    finally:
        for work in scopes.pop():
            work.drop()


def extended(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` with further columns, each named with its type."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in columns.items())).fields])


def on_path(spark: SparkSession, path: str, act) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    act(at.getFileSystem(conf), at)


def then(*steps):
    """Arrow functions one after another in one Python worker, where separate plan nodes would each hold a worker of their own."""

    def run(batches):
        for step in steps:
            batches = step(batches)
        return batches

    return run


def trim() -> None:
    """Hand freed memory back to the system: Python workers live on between tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 300_000):
    """Cut a batch into consecutive slices of about ``limit`` text bytes; a longer text is a slice of its own."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)).astype(np.int64)
    at = 0
    while at < len(sizes):
        upto, total = at + 1, sizes[at]
        while upto < len(sizes) and total + sizes[upto] <= limit:
            total += sizes[upto]
            upto += 1
        yield batch.slice(at, upto - at)
        at = upto
    trim()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = pa.compute.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
        kind = np.int64
    else:
        column = column.cast(pa.string())
        kind = np.int32
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
