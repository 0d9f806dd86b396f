"""Logs that keep growing, as streams: the readers' own parsing on what has come since, and windows over event times.

Each stream keeps its progress in a checkpoint folder, so one that is stopped or loses machines goes
on where it was, and every file counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import parsers


def commits(spark: SparkSession, folder: str, top: str) -> DataFrame:
    """The rows of git_log as a stream over the commit logs that come into a folder."""
    return parsers.commit_rows(spark.readStream.text(folder, lineSep="\n" + parsers.RECORD), top)


def step_windows(steps: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, step_type, steps, ms) of steps(ts, step_type, ms) by windows of their time; what comes later than `late` after the latest is left out, so the state stays bounded."""
    by = steps.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "step_type").agg(F.count("*").alias("steps"), F.sum("ms").alias("ms"))
    return by.select(F.col("w.start").alias("start"), "step_type", "steps", "ms")


def append(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream's rows to a Parquet table; with once, what is there now, and then it ends."""
    out = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def replace(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps a Parquet table that holds a stream's whole aggregate, written anew after each batch."""
    out = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(table))
    return (out.trigger(availableNow=True) if once else out).start()
