"""Temporal operators over events whose clocks are off by a bounded skew: each happened somewhere in [t + lo, t + hi].

An answer is certain if it holds wherever the events were, and possible if it holds somewhere. Pairs meet by buckets of
time, widened by the largest skew, so nothing far apart is compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .temporal import sequence_join

CERTAIN, POSSIBLE, NEVER = "CERTAIN", "POSSIBLE", "NEVER"


def enveloped(events: DataFrame, skews: dict[str, tuple[int, int]], key: str = "source", t: str = "t") -> DataFrame:
    """``events`` with ``lo`` and ``hi``, the ends of when they happened; sources without a skew are exact."""
    if any(lo > hi for lo, hi in skews.values()):
        raise ValueError("a skew's ends are the wrong way round")
    low = high = F.lit(0).cast("long")
    for source, (lo, hi) in sorted(skews.items()):
        low, high = F.when(F.col(key) == source, F.lit(lo)).otherwise(low), F.when(F.col(key) == source, F.lit(hi)).otherwise(high)
    return events.withColumns({"lo": F.col(t) + low, "hi": F.col(t) + high})


def most(skews: dict[str, tuple[int, int]]) -> int:
    return max((abs(x) for ends in skews.values() for x in ends), default=0)


def near(left: DataFrame, right: DataFrame, keys: list[str], before: int, after: int, skew: int) -> DataFrame:
    """Pairs as l_ and r_ columns that may have r within [l - before, l + after] once both are moved by up to ``skew``."""
    moved = before + 2 * skew + 1
    met = sequence_join(left.withColumn("t", F.col("t") - moved), right, keys, moved + after + 2 * skew)
    return met.withColumn("l_t", F.col("l_t") + moved)


def sequence(left: DataFrame, right: DataFrame, keys: list[str], within: int, skew: int) -> DataFrame:
    """Pairs that may be left, then right at most ``within`` later, with ``certain``. Those with false are of undecided
    order: they must not fire a rule."""
    met = near(left, right, keys, 0, within, skew)
    possible = (F.col("r_hi") - F.col("l_lo") > 0) & (F.col("r_lo") - F.col("l_hi") <= within)
    certain = (F.col("r_lo") - F.col("l_hi") > 0) & (F.col("r_hi") - F.col("l_lo") <= within)
    return met.where(possible).withColumn("certain", certain)


def absence(events: DataFrame, absent: DataFrame, keys: list[str], within: int, skew: int, row_id: str = "event_id") -> DataFrame:
    """``events`` with ``absent``: CERTAIN if no row of ``absent`` may lie in the ``within`` before them, NEVER if one surely
    does, POSSIBLE else."""
    met = near(events.select(row_id, *keys, "t", "lo", "hi"), absent.select(*keys, "t", "lo", "hi"), keys, within, 0, skew)
    possible = (F.col("r_lo") < F.col("l_hi")) & (F.col("r_hi") >= F.col("l_lo") - within)
    certain = (F.col("r_hi") < F.col("l_lo")) & (F.col("r_lo") >= F.col("l_hi") - within)
    found = met.where(possible).groupBy(F.col(f"l_{row_id}").alias(row_id)).agg(F.max(certain).alias("\0sure"))
    standing = F.when(F.col("\0sure").isNull(), CERTAIN).when(F.col("\0sure"), NEVER).otherwise(POSSIBLE)
    return events.join(found, row_id, "left").withColumn("absent", standing).drop("\0sure")


def distinct(events: DataFrame, keys: list[str], field: str, within: int, skew: int, row_id: str = "event_id") -> DataFrame:
    """``events`` with n_certain and n_possible: values of ``field`` that surely, or may, occur in the ``within`` up to them,
    their own included. A value is counted once however many rows it has in a window."""
    met = near(events.select(row_id, *keys, "t", "lo", "hi"), events.select(F.col(row_id).alias("other"), *keys, "t", "lo", "hi", field), keys, within, 0, skew)
    own = F.col("r_other") == F.col(f"l_{row_id}")
    possible = own | ((F.col("r_lo") <= F.col("l_hi")) & (F.col("r_hi") >= F.col("l_lo") - within))
    certain = own | ((F.col("r_hi") <= F.col("l_lo")) & (F.col("r_lo") >= F.col("l_hi") - within))
    values = met.where(possible).groupBy(F.col(f"l_{row_id}").alias(row_id), F.col(f"r_{field}").alias("\0v")).agg(F.max(certain).alias("\0sure"))
    counted = values.groupBy(row_id).agg(F.count_if("\0sure").alias("n_certain"), F.count("*").alias("n_possible"))
    return events.join(counted, row_id)
