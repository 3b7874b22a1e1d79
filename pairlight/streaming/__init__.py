"""Runs as streams: results committed chunk by chunk as they arrive, and totals of the log kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairlight.operators.runlog import LOG, commit


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG).parquet(path)


def stage_totals(log: DataFrame) -> DataFrame:
    """stage, items, chunks, seconds; works on a table and on a stream (state: a row a stage)."""
    return log.groupBy("stage").agg(F.sum("count").alias("items"), F.count(F.lit(1)).alias("chunks"), F.sum(F.col("finished") - F.col("started")).alias("seconds"))


def start_totals(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Totals kept in the table ``out``, replaced with each batch; takes what is there and ends."""
    replace = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    return stage_totals(log_stream(spark, path)).writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_commits(incoming: DataFrame, plan: DataFrame, path: str, log_path: str, checkpoint: str, started: float, finished: float) -> StreamingQuery:
    """Commit the results of a stream (stage, chunk, pos, item and others), a file or more a chunk, whole chunks in a batch.

    A batch that is given again after a failure replaces what it wrote before, so each
    chunk is there once; results that do not match the plan stop the stream before anything
    is written. Takes what is there and ends.
    """
    each = lambda batch, _: commit(batch, plan, path, log_path, started, finished)
    return incoming.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
