"""Extensions for findings that arrive as a stream; scans themselves are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """(hour, severity, n): findings per hour of ``ts``; with ``late`` as a stream that waits that long."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "severity").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("hour"), "severity", "n")


def first_reports(findings: DataFrame, late: str = "1 day") -> DataFrame:
    """Each fingerprint once within the time that stragglers may take."""
    rows = findings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark(["fingerprint"])


def bursts(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of findings of one user without a longer gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
