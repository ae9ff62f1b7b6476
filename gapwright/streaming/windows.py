"""Structured Streaming twins of the window operators, with a watermark. Given all of a table they close the windows that
the batch forms give, except the last ones, which wait for a later event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def sliding(events: DataFrame, width: str, step: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by type in tumbling (no step) or sliding windows."""
    span = F.window("at", width, step) if step else F.window("at", width)
    return timed(events, late).groupBy(span, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("t0"), F.col("window.end").alias("t1"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    return timed(events, late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("t0"), F.col("session_window.end").alias("t1"), "user_id", "n")


def bursts(events: DataFrame, width: str, least: int, late: str = "1 hour") -> DataFrame:
    """Windows with ``least`` events of a type or more."""
    return sliding(events, width, None, late).where(F.col("n") >= least)


def sequence(left: DataFrame, right: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Pairs of a user's events with 0 < right - left <= seconds; state is bounded by the watermark and the range."""
    lo = timed(left, late).select(F.col("user_id").alias("l_user"), F.col("at").alias("l_at"), F.col("event_id").alias("l_event_id"))
    hi = timed(right, late).select(F.col("user_id").alias("r_user"), F.col("at").alias("r_at"), F.col("event_id").alias("r_event_id"))
    return lo.join(hi, F.expr(f"l_user = r_user AND r_at > l_at AND r_at <= l_at + INTERVAL {seconds} SECONDS"))


def collect_stream(spark, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a memory table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.table(name)
