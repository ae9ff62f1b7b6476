"""Seeded synthetic telemetry: draws are functions of (seed, domain, parts), so partitions and order change nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import with_neighbours
from ..plans.rules import duration
from .config import Scenario


def draw(seed: int, domain: str, *parts: Column) -> Column:
    """A 60-bit whole number."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), F.lit(domain), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def draw_below(seed: int, domain: str, n: int, *parts: Column) -> Column:
    """Uniform below n, exactly: 60-bit draws at or over the largest multiple of n are rejected, and the next is taken. The
    chance of a rejection is below n / 2^60; the fold runs until one stands, over numbers 0 to 63 of which it draws only as
    many as it needs. That all are rejected has a chance below 2^-1800 for n up to 2^31, and raises."""
    top = (1 << 60) // n * n
    drawn = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(-1).cast("long"), lambda have, k: F.when(have >= 0, have).otherwise(F.when(draw(seed, domain, *parts, k) < top, draw(seed, domain, *parts, k) % n).otherwise(F.lit(-1).cast("long"))))
    return F.when(drawn >= 0, drawn).otherwise(F.raise_error(F.lit("no draw was accepted")).cast("long"))


def noise(spark: SparkSession, scenario: Scenario, seed: int) -> DataFrame:
    """Benign events: family i has one event every ``every`` ticks, jittered within half of that, of a drawn entity."""
    out = None
    for i, family in enumerate(scenario.noise):
        step = duration(family["every"])
        rows = spark.range(scenario.horizon // step).withColumnRenamed("id", "k")
        t = F.col("k") * step + draw_below(seed, f"jitter{i}", max(step // 2, 1), F.col("k"))
        pool = [e["name"] for e in scenario.entities if e["kind"] == family["kind"]]
        who = F.element_at(F.array(*[F.lit(p) for p in pool]), (draw_below(seed, f"who{i}", len(pool), F.col("k")) + 1).cast("int"))
        made = rows.select(F.lit(family["source"]).alias("source"), F.lit(family["event_type"]).alias("event_type"), t.alias("t"), F.lit(i).alias("family"), F.col("k"), F.create_map(F.lit(family["role"]), who).alias("attrs"), F.lit(False).alias("step"))
        out = made if out is None else out.unionByName(made)
    return out


def generate(spark: SparkSession, scenario: Scenario, seed: int) -> tuple[DataFrame, DataFrame]:
    """(raw, truth): raw has (source, seq, t, event_type, attrs) and nothing that tells steps from noise; seq is dense
    from 0 along (t, family, k) in each source."""
    steps = spark.createDataFrame([(s["source"], s["event_type"], s["t"], len(scenario.noise), k, s["attrs"], True) for k, s in enumerate(scenario.steps)], "source string, event_type string, t long, family int, k long, attrs map<string,string>, step boolean")
    benign = noise(spark, scenario, seed)
    every = steps if benign is None else benign.unionByName(steps)
    numbered = with_neighbours(every, ["source"], ["t", "family", "k"], [], width=3600, number="seq")
    return numbered.select("source", "seq", "t", "event_type", "attrs"), numbered.select("source", "seq", F.when(F.col("step"), "step").otherwise("noise").alias("origin"))
