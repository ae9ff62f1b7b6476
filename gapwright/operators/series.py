"""Order-dependent columns of event series, in a form that bears a series with a third of all rows.

A plain window over a source sorts all of its events in one task. Here a series is cut into buckets of its order (a
span of time, or of numbers): a window runs within (series, bucket), and what crosses a bucket's edge comes from a
table with one row for each bucket, joined on the same keys, so that the rows themselves are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def with_bucket(df: DataFrame, order: str, width: int, name: str = "bucket") -> DataFrame:
    """Adds the bucket of ``order``, rounded down (``div`` alone rounds towards 0)."""
    return df.withColumn(name, F.expr(f"(`{order}` - pmod(`{order}`, {width}L)) div {width}L"))


def with_neighbours(df: DataFrame, key: list[str], order: list[str], values: list[str], width: int = DAY_US, ahead: bool = False, number: str | None = None) -> DataFrame:
    """``df`` with ``prev_*`` (or ``next_*`` where ahead) of ``values``, and with ``number``: the row's place from 0.

    order: a whole-number column that buckets are cut from, then tie-breakers."""
    rows = with_bucket(df, order[0], width, "\0bucket")
    cut = [*key, "\0bucket"]
    prefix, step = ("next_", F.lead) if ahead else ("prev_", F.lag)
    place, rank = F.struct(*order), F.struct(*[F.col(v).alias(v) for v in values]) if values else F.struct(F.lit(0).alias("none"))
    edges = rows.groupBy(*cut).agg((F.min_by if ahead else F.max_by)(rank, place).alias("\0edge"), F.count("*").alias("\0n"))
    along = Window.partitionBy(*key).orderBy("\0bucket")
    edges = edges.select(*cut, step("\0edge").over(along).alias("\0carry"), F.coalesce(F.sum("\0n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("\0base"))
    within = Window.partitionBy(*cut).orderBy(*order)
    inner = rows.withColumn("\0own", step(F.struct(*values) if values else F.lit(None)).over(within))
    if number:
        inner = inner.withColumn("\0place", F.row_number().over(within) - 1)
    met = inner.join(edges, cut)
    out = {f"{prefix}{v}": F.when(F.col("\0own").isNotNull(), F.col(f"`\0own`.{v}")).otherwise(F.col(f"`\0carry`.{v}")) for v in values}
    if number:
        out[number] = F.col("\0base") + F.col("\0place")
    return met.withColumns(out).select(*df.columns, *out)


def islands(df: DataFrame, key: list[str], start: str, end: str, same: list[str], width: int = DAY_US) -> DataFrame:
    """Gaps and islands: runs of contiguous intervals that agree in ``same``, as (key, start, end, same, parts).

    An interval opens a run if the one before it differs or doesn't touch it; a run ends where its last part does."""
    marked = with_neighbours(df, key, [start], [end, *same], width)
    opens = F.col(f"prev_{end}").isNull() | (F.col(f"prev_{end}") != F.col(start))
    for c in same:
        opens = opens | ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    numbered = marked.withColumn("\0opens", opens.cast("long"))
    # The run's number is a prefix sum: within a bucket, and over the buckets' sums.
    rows = with_bucket(numbered, start, width, "\0bucket")
    cut = [*key, "\0bucket"]
    sums = rows.groupBy(*cut).agg(F.sum("\0opens").alias("\0n"))
    along = Window.partitionBy(*key).orderBy("\0bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*cut, F.coalesce(F.sum("\0n").over(along), F.lit(0)).alias("\0base"))
    own = F.sum("\0opens").over(Window.partitionBy(*cut).orderBy(start).rowsBetween(Window.unboundedPreceding, 0))
    run = rows.withColumn("\0own", own).join(sums, cut).withColumn("\0run", F.col("\0base") + F.col("\0own"))
    return run.groupBy(*key, "\0run", *same).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("\0run")


def as_of(points: DataFrame, rows: DataFrame, key: list[str], t: str, values: list[str], width: int = DAY_US, ahead: bool = False, strict: bool = False) -> DataFrame:
    """``points`` with ``as_of_*`` of ``values`` of the last row of ``rows`` at or before ``t`` (or the first at or after it
    where ``ahead``; ``strict``: not at it). Rows are unique by key and t. Points and rows are sorted together in buckets,
    and the last row of the buckets before comes from a table of a row for each bucket: nothing is compared pairwise."""
    carried = F.struct(F.col(t).alias("t"), *[F.col(v).alias(v) for v in values])
    # At equal times a row stands before a point if it counts for it.
    first = ahead == strict
    ours = rows.select(*key, F.col(t).alias("\0t"), F.lit(0 if first else 1).alias("\0side"), carried.alias("\0row"))
    every = points.select(*key, F.col(t).alias("\0t"), F.lit(1 if first else 0).alias("\0side"), F.struct(*points.columns).alias("\0point")).unionByName(ours, allowMissingColumns=True)
    every = with_bucket(every, "\0t", width, "\0bucket")
    cut = [*key, "\0bucket"]
    edges = with_bucket(ours, "\0t", width, "\0bucket").groupBy(*cut).agg((F.min_by if ahead else F.max_by)("\0row", "\0t").alias("\0edge"))
    buckets = every.select(*cut).distinct().join(edges, cut, "left")
    along = Window.partitionBy(*key).orderBy(F.desc("\0bucket") if ahead else F.asc("\0bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*cut, F.last("\0edge", True).over(along).alias("\0carry"))
    order = [F.desc("\0t"), F.desc("\0side")] if ahead else [F.asc("\0t"), F.asc("\0side")]
    within = Window.partitionBy(*cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = every.withColumn("\0own", F.last("\0row", True).over(within)).where(F.col("\0point").isNotNull()).join(buckets, cut)
    found = F.coalesce("\0own", "\0carry")
    return met.select("`\0point`.*", found["t"].alias(f"as_of_{t}"), *[found[v].alias(f"as_of_{v}") for v in values])


def prefix_sum(df: DataFrame, key: str, order: str, value: str, out: str, width: int = DAY_US) -> DataFrame:
    """Running sums along unique ``order``, in buckets."""
    rows = with_bucket(df, order, width, "\0bucket")
    sums = rows.groupBy(key, "\0bucket").agg(F.sum(value).alias("\0s"))
    before = Window.partitionBy(key).orderBy("\0bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "\0bucket", F.coalesce(F.sum("\0s").over(before), F.lit(0)).alias("\0base"))
    own = F.sum(value).over(Window.partitionBy(key, "\0bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("\0own", own).join(sums, [key, "\0bucket"]).withColumn(out, F.col("\0base") + F.col("\0own")).select(*df.columns, out)
