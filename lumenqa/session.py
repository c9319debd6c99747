"""What every query does to the session it is given."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started; on a cluster it is installed or shipped."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, ROOT]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one is set only on a local master without any; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts are held in memory by both sides, so the session's default of 10,000 rows is lowered."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:  # never raised, and no result depends on it
        spark.conf.set(name, rows)
