"""Streams of messages: deduplicated intake, coverage over time, a ledger of batches. Additions of this engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "address string, body string, date bigint"


def read_lines(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Messages of JSON lines as files arrive, with their time."""
    s = spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_at_once).json(folder)
    return s.select("address", F.coalesce("body", F.lit("")).alias("body"), F.col("date").alias("date_ms"), F.timestamp_millis("date").alias("time")).where(F.trim("body") != "")


def deduplicated(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first of equal messages (address and body) within the watermark; state beyond it is dropped."""
    return messages.withWatermark("time", delay).dropDuplicatesWithinWatermark(["address", "body"])


def coverage_over_time(parsed: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Messages and matched ones of each bank in each window; late messages up to the delay count."""
    w = parsed.withWatermark("time", delay).groupBy(F.window("time", window).alias("w"), "bank_id")
    return w.agg(F.count(F.lit(1)).alias("total"), F.count_if("matched").alias("matched")).select(F.col("w.start").alias("start"), "bank_id", "total", "matched")


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch to a sink once it is due; the sink must take a repeated batch id."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
