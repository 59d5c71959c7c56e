"""Event-time aggregates over the event stream; late rows beyond the watermark are dropped by Spark, and
``late_rows`` counts them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum by event type and window; the same code for a stream and a table."""
    spec = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withWatermark("ts", late).groupBy(spec.alias("w"), "event_type")
    totals = grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return totals.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def late_rows(events: DataFrame, seen_upto: str, late: str = "10 minutes") -> DataFrame:
    """Of a table of rows with the latest event time known when each came (``seen_upto``): how many a
    watermark drops."""
    return events.agg(F.count_if(F.col("ts") < F.col(seen_upto) - F.expr(f"INTERVAL {late}")).alias("n_late"))
