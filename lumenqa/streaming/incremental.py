"""Incremental judging: new QAs of each micro-batch are judged, those judged before are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def judge_stream(source: DataFrame, judge: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "qid") -> StreamingQuery:
    """Append judged rows of a QA stream to ``sink`` (Parquet); a key is judged once, over restarts too.

    A repeated batch after a failure finds its own rows in the sink and adds nothing.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
        new = batch.dropDuplicates([key])
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(sink).select(key), key, "left_anti")
        judge(new).write.mode("append").parquet(sink)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
