"""Append-only logs as streams. The reference behaviour knows only the logs; the windows are an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines files as they arrive; lines that cannot be read have null columns."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(folder)


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each kind per tumbling window; rows later than late are left out. Works on streams and tables alike."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def stale(jobs: DataFrame, started: str, now, seconds: int = 1800) -> DataFrame:
    """Rows that began more than so many seconds before now and have not ended."""
    return jobs.where((F.col("status") == "processing") & (F.unix_timestamp(now) - F.unix_timestamp(started) > seconds))
