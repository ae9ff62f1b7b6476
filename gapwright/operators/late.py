"""Records that come late: a watermark, what it lets in, and windows that are counted again.

Records come in epochs, spans of arrival. An epoch's watermark is the latest time that came before it less the lateness
that is allowed; it never falls. A record before the watermark is late: up to another lateness before it its window is
opened again, beyond that the record is quarantined with the bound that it broke, and its window is recomputed too. A
window is first counted by the epoch whose watermark has passed its end, and every later change is a generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import as_of

ON_TIME, REOPENED, QUARANTINED = "ON_TIME", "REOPENED", "QUARANTINED"


def watermarks(events: DataFrame, lateness: int, t: str = "t") -> DataFrame:
    """(epoch, watermark), one row for each epoch that has records; null while nothing came before. A row a span of
    arrival is what the running maximum goes over, not the records."""
    epochs = events.groupBy("epoch").agg(F.max(t).alias("\0t"))
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return epochs.select("epoch", (F.max("\0t").over(before) - lateness).alias("watermark"))


def judged(events: DataFrame, marks: DataFrame, lateness: int, t: str = "t") -> DataFrame:
    """``events`` with ``watermark`` and ``standing``."""
    late = F.col(t) < F.col("watermark")
    standing = F.when(late & (F.col(t) < F.col("watermark") - lateness), QUARANTINED).when(late, REOPENED).otherwise(ON_TIME)
    return events.join(marks, "epoch").withColumn("standing", standing)


def closings(windows: DataFrame, marks: DataFrame) -> DataFrame:
    """``windows`` (with ``t1``) with ``closed``: the first epoch whose watermark is at or after t1; null if there is none."""
    first = marks.where(F.col("watermark").isNotNull()).groupBy("watermark").agg(F.min("epoch").alias("epoch"))
    rows = first.select(F.lit(0).alias("\0k"), F.col("watermark").alias("t1"), "epoch")
    ends = windows.select("t1").distinct().withColumn("\0k", F.lit(0))
    met = as_of(ends, rows, ["\0k"], "t1", ["epoch"], ahead=True).select("t1", F.col("as_of_epoch").alias("closed"))
    return windows.join(met, "t1")


def generations(events: DataFrame, marks: DataFrame, key: list[str], width: int, t: str = "t") -> DataFrame:
    """(key, t0, generation, epoch, n): counts of a window of ``width`` when it is closed (generation 0, or when the stream
    ends: epoch null), and after every epoch that changes it later. The last is that of a full recount."""
    panes = events.withColumn("t0", F.expr(f"(`{t}` - pmod(`{t}`, {width}L))")).withColumn("t1", F.col("t0") + width)
    counted = panes.groupBy(*key, "t0", "t1", "epoch").agg(F.count("*").alias("n"))
    shut = closings(counted, marks)
    # What came before the closing epoch is in generation 0, also where nothing did: then it is a count of 0.
    early = F.col("closed").isNull() | (F.col("epoch") < F.col("closed"))
    first = shut.groupBy(*key, "t0", F.col("closed")).agg(F.coalesce(F.sum(F.when(early, F.col("n"))), F.lit(0)).alias("n")).select(*key, "t0", F.col("closed").alias("epoch"), "n")
    more = shut.where(~early).select(*key, "t0", "epoch", "n").withColumn("\0first", F.lit(1))
    every = first.withColumn("\0first", F.lit(0)).unionByName(more)
    along = Window.partitionBy(*key, "t0").orderBy("\0first", "epoch")
    return every.select(*key, "t0", (F.row_number().over(along) - 1).alias("generation"), "epoch", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
