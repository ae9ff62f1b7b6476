"""Temporal joins between events, and consistency of a source's times with its sequence numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .series import as_of, prefix_sum, with_bucket, with_neighbours


def sequence_join(left: DataFrame, right: DataFrame, keys: list[str], within: int, t: str = "t") -> DataFrame:
    """Pairs with left.t < right.t <= left.t + within for equal keys. Columns get the prefixes l_ and r_.

    The right side goes to the bucket of its time, the left to the two buckets that its window can touch: an equi-join
    on keys and bucket, so that a hot key is cut by time, and no pair of far times is made."""
    if within <= 0:
        within = 0
    width = max(within, 1)
    bucket = f"(`{t}` - pmod(`{t}`, {width}L)) div {width}L"
    lo = left.withColumn("\0b", F.expr(bucket)).withColumn("\0b", F.explode(F.array(F.col("\0b"), F.col("\0b") + 1)))
    lo = lo.select(*[F.col(c).alias(c if c in keys else ("\0b" if c == "\0b" else f"l_{c}")) for c in lo.columns])
    hi = right.withColumn("\0b", F.expr(bucket))
    hi = hi.select(*[F.col(c).alias(c if c in keys else ("\0b" if c == "\0b" else f"r_{c}")) for c in hi.columns])
    met = lo.join(hi, [*keys, "\0b"])
    return met.where((F.col(f"l_{t}") < F.col(f"r_{t}")) & (F.col(f"r_{t}") <= F.col(f"l_{t}") + within)).drop("\0b")


def absence_join(events: DataFrame, absent: DataFrame, keys: list[str], within: int, t: str = "t", row_id: str = "event_id") -> DataFrame:
    """Events for which no row of ``absent`` has equal keys and a time in [t - within, t)."""
    width = max(within, 1)
    bucket = f"(`{t}` - pmod(`{t}`, {width}L)) div {width}L"
    asked = events.withColumn("\0b", F.explode(F.array(F.expr(bucket), F.expr(bucket) - 1)))
    have = absent.select(*[F.col(k).alias(f"\0{k}") for k in keys], F.col(t).alias("\0t"), F.expr(bucket).alias("\0c"))
    same = F.col("\0b") == F.col("\0c")
    for k in keys:
        same = same & (F.col(k) == F.col(f"\0{k}"))
    hit = asked.join(have, same & (F.col("\0t") >= F.col(t) - within) & (F.col("\0t") < F.col(t)), "left_semi").select(row_id).distinct()
    return events.join(hit, row_id, "left_anti")


def distinct_window(events: DataFrame, keys: list[str], field: str, n: int, within: int, t: str = "t") -> DataFrame:
    """Events with ``n_distinct`` >= n values of ``field`` among rows of equal keys with a time in [t - within, t].

    A row stands in the bucket of its time, for which it is counted, and in the next, whose windows it can still be in: a
    range frame runs within (keys, bucket), so a hot key is cut by time, and a frame holds what its window holds."""
    width = max(within, 1)
    bucket = f"(`{t}` - pmod(`{t}`, {width}L)) div {width}L"
    copies = events.withColumn("\0own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("\0b", F.expr(bucket) + F.when(F.col("\0own"), 0).otherwise(1))
    frame = Window.partitionBy(*keys, "\0b").orderBy(t).rangeBetween(-within, 0)
    counted = copies.withColumn("n_distinct", F.size(F.collect_set(field).over(frame)).cast("long"))
    return counted.where(F.col("\0own") & (F.col("n_distinct") >= n)).drop("\0own", "\0b")


def without_between(pairs: DataFrame, denied: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """``pairs`` (l_t, r_t) without those that have a row of ``denied`` (keys, t) strictly between for equal keys: only
    the first denied time after the left one is looked at."""
    asked = pairs.withColumn(t, F.col(f"l_{t}"))
    met = as_of(asked, denied.select(*keys, t).distinct(), keys, t, [], ahead=True, strict=True)
    return met.where(F.col(f"as_of_{t}").isNull() | (F.col(f"as_of_{t}") >= F.col(f"r_{t}"))).drop(t, f"as_of_{t}")


def obligations(triggers: DataFrame, heads: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Triggers whose head is missing at exactly their keys and time."""
    return triggers.join(heads.select(*keys, t).distinct(), [*keys, t], "left_anti")


def order_violations(events: DataFrame, key: str = "source", seq: str = "seq", t: str = "t", width: int = 100_000) -> DataFrame:
    """Neighbours by sequence number whose time falls: (key, seq, t, prev_seq, prev_t, weight)."""
    near = with_neighbours(events, [key], [seq], [seq, t], width)
    return near.where(F.col(t) < F.col(f"prev_{t}")).withColumn("weight", F.col(f"prev_{t}") - F.col(t))


def missing_sequence(events: DataFrame, key: str = "source", seq: str = "seq", t: str = "t", tie: str = "event_id") -> DataFrame:
    """Neighbours in time between which sequence numbers are missing: (key, first_missing, last_missing, t0, t1)."""
    near = with_neighbours(events, [key], [t, seq, tie], [seq, t])
    return near.where(F.col(seq) > F.col(f"prev_{seq}") + 1).select(key, (F.col(f"prev_{seq}") + 1).alias("first_missing"), (F.col(seq) - 1).alias("last_missing"), F.col(f"prev_{t}").alias("t0"), F.col(t).alias("t1"))


def align_join(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, t: str = "t") -> DataFrame:
    """Pairs with equal keys and times at most ``tolerance`` apart, as l_ and r_ columns: the left side goes to the buckets
    beside its own too, so each pair meets in one bucket."""
    width = max(tolerance, 1)
    bucket = F.expr(f"(`{t}` - pmod(`{t}`, {width}L)) div {width}L")
    lo = left.withColumn("\0b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    lo = lo.select(*[F.col(c).alias(c if c in keys or c == "\0b" else f"l_{c}") for c in lo.columns])
    hi = right.withColumn("\0b", bucket)
    hi = hi.select(*[F.col(c).alias(c if c in keys or c == "\0b" else f"r_{c}") for c in hi.columns])
    return lo.join(hi, [*keys, "\0b"]).where(F.abs(F.col(f"l_{t}") - F.col(f"r_{t}")) <= tolerance).drop("\0b")


def overlap_join(left: DataFrame, right: DataFrame, lspan: tuple[str, str], rspan: tuple[str, str], keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Pairs of half-open spans that overlap, for equal ``keys`` (columns of one name in both). Other names must differ.

    Both sides go to the buckets that their spans touch, and a pair is kept in the first bucket that both touch, so it
    comes once. A bucket is as wide as the mean span of the larger mean, unless ``width`` says otherwise: then a side has
    at most some twice its rows, and a long span on either side costs its length and no more."""
    keys = keys or []
    if width is None:
        mean = lambda df, s: df.agg(F.avg(F.greatest(F.col(s[1]) - F.col(s[0]), F.lit(1))).alias("m")).collect()[0].m or 1
        width = max(1, int(max(mean(left, lspan), mean(right, rspan))))
    first = lambda c: F.expr(f"(`{c}` - pmod(`{c}`, {width}L)) div {width}L")
    last = lambda c: F.expr(f"(`{c}` - 1 - pmod(`{c}` - 1, {width}L)) div {width}L")
    spread = lambda df, s: df.where(F.col(s[0]) < F.col(s[1])).withColumn("\0b", F.explode(F.sequence(first(s[0]), last(s[1]))))
    met = spread(left, lspan).join(spread(right, rspan), [*keys, "\0b"])
    own = F.greatest(first(lspan[0]), first(rspan[0])) == F.col("\0b")
    return met.where(own & (F.col(lspan[0]) < F.col(rspan[1])) & (F.col(rspan[0]) < F.col(lspan[1]))).drop("\0b")


def disorder(events: DataFrame, key: str = "source", seq: str = "seq", t: str = "t", width: int = 100_000) -> DataFrame:
    """``events`` with ``knot``: stretches of a series, along seq, outside which nothing is out of order. A stretch ends where
    no later time is below the greatest so far. Both extremes are running ones over buckets, so a series is not one task."""
    rows = with_bucket(events, seq, width, "\0b")
    cut = [key, "\0b"]
    ends = rows.groupBy(*cut).agg(F.max(t).alias("\0hi"), F.min(t).alias("\0lo"))
    # What follows is what comes before in falling order: Spark goes over a frame up to the end anew for every row.
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*cut, F.max("\0hi").over(earlier([key], F.asc("\0b"))).alias("\0before"), F.min("\0lo").over(earlier([key], F.desc("\0b"))).alias("\0after"))
    within = Window.partitionBy(*cut).orderBy(seq)
    met = rows.join(ends, cut)
    top = F.greatest(F.max(t).over(within.rowsBetween(Window.unboundedPreceding, 0)), "\0before")
    low = F.least(F.min(t).over(earlier(cut, F.desc(seq))), "\0after")
    met = met.withColumn("\0last", (F.coalesce(low >= top, F.lit(True))).cast("long")).select(*events.columns, "\0last")
    closed = prefix_sum(met, key, seq, "\0last", "knot", width)
    return closed.withColumn("knot", F.col("knot") - F.col("\0last")).drop("\0last")


def corrections(events: DataFrame, key: str = "source", seq: str = "seq", t: str = "t") -> DataFrame:
    """(key, seq, t) of the records that must change for the rest of a series to rise along seq, as few as can be: what is
    outside a longest non-decreasing subsequence. Stretches of ``disorder`` are judged apart; those of one record need
    nothing, so only tangled stretches go to a worker, each whole and none larger than its own disorder."""
    from ..functions.repair import corrections as changed

    ship(events.sparkSession)
    knots = disorder(events.select(key, seq, t), key, seq, t)
    tangled = knots.join(knots.groupBy(key, "knot").agg(F.count("*").alias("\0n")).where("`\0n` > 1").drop("\0n"), [key, "knot"])

    def repair(frame):
        frame = frame.sort_values(seq, kind="stable")
        return frame.iloc[changed(frame[t].tolist())][[key, seq, t]]

    return tangled.groupBy(key, "knot").applyInPandas(repair, events.select(key, seq, t).schema)


def disputed_sources(events: DataFrame, key: str = "source", seq: str = "seq", t: str = "t") -> DataFrame:
    """(key, violations, disputed) of every source: times that fall along seq put all of it in dispute; nothing is removed."""
    found = order_violations(events, key, seq, t).groupBy(key).agg(F.count("*").alias("violations"))
    counted = events.select(key).distinct().join(found, key, "left").withColumn("violations", F.coalesce("violations", F.lit(0).cast("long")))
    return counted.withColumn("disputed", F.col("violations") > 0)


def constraints(events: DataFrame, key: str = "source", seq: str = "seq", t: str = "t", width: int = 100_000) -> DataFrame:
    """Difference constraints t[v] - t[u] >= 0 of neighbours along seq: (key, u, v, slack); negative slack is a violation."""
    near = with_neighbours(events, [key], [seq], [seq, t], width)
    return near.where(F.col(f"prev_{seq}").isNotNull()).select(key, F.col(f"prev_{seq}").alias("u"), F.col(seq).alias("v"), (F.col(t) - F.col(f"prev_{t}")).alias("slack"))
