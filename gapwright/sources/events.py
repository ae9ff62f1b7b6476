"""The event store: a telemetry table and its four questions, and relations read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import DAY_US, with_neighbours
from ..session import table


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, source, t in microseconds, user_id, value, k) of table ``events``; columns prune down to the scan.
    Times have no zone: t is what their clock shows, whatever the session's zone."""
    events = table(spark, sf_dir, "events")
    clock = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return events.select("event_id", F.col("event_type").alias("source"), F.unix_micros(clock).alias("t"), "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def sequenced(events: DataFrame, width: int = DAY_US) -> DataFrame:
    """With ``seq``, dense from 0 in each source by (t, event_id)."""
    return with_neighbours(events, ["source"], ["t", "event_id"], [], width, number="seq")


class EventStore:
    """Questions to a store of events with unique ids. ``load`` refuses a repeated id."""

    def __init__(self, events: DataFrame):
        self.events = events

    @classmethod
    def load(cls, events: DataFrame) -> "EventStore":
        again = events.groupBy("event_id").count().where("count > 1").limit(1).collect()
        if again:
            raise ValueError(f"event id {again[0].event_id} is there more than once")
        return cls(events)

    def view(self, name: str = "events_store") -> None:
        self.events.createOrReplaceTempView(name)

    def source_stats(self) -> DataFrame:
        return self.events.groupBy("source").agg(F.count("*").alias("n_events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))

    def gaps(self) -> DataFrame:
        near = with_neighbours(self.events, ["source"], ["seq", "event_id"], ["seq", "t"], width=100_000)
        return near.where(F.col("prev_t").isNotNull()).select("source", "prev_seq", "seq", "prev_t", "t", (F.col("t") - F.col("prev_t")).alias("delta"))

    def window(self, source: str, t0: int, t1: int) -> DataFrame:
        if t0 >= t1:
            raise ValueError(f"the window [{t0}, {t1}) is empty")
        return self.events.where((F.col("source") == source) & (F.col("t") >= t0) & (F.col("t") < t1)).orderBy("t", "event_id")

    def event(self, event_id) -> DataFrame:
        return self.events.where(F.col("event_id") == event_id)
