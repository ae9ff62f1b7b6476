"""Degradation of raw records (source, seq, t, event_type, attrs): deletion, blackout, backdating, stripped identity and
forged records. Each takes and gives a raw table; a manifest compares the two."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import with_neighbours

BLOCK_S = 1200


@dataclass(frozen=True)
class Completeness:
    """num/den in lowest terms, within 0..1."""

    num: int
    den: int

    def __post_init__(self):
        if self.den <= 0 or not 0 <= self.num <= self.den:
            raise ValueError(f"completeness {self.num}/{self.den} isn't within 0..1")
        g = math.gcd(self.num, self.den)
        object.__setattr__(self, "num", self.num // g)
        object.__setattr__(self, "den", self.den // g)

    def keep(self, n: int) -> int:
        return n * self.num // self.den

    @property
    def tag(self) -> str:
        return f"c{self.num}_{self.den}"


def delete(raw: DataFrame, completeness: Completeness, seed: int, per_second: int, key: str = "source", seq: str = "seq", t: str = "t", digest=None) -> DataFrame:
    """Drop n - floor(n * c) records of each source: whole blocks of BLOCK_S seconds in the order of their digest, and in
    the block where the cut falls the first records by their own digest. Deletions of a lower completeness hold those
    of a higher one. Blocks are counted first, so only the block with the cut is ranked row by row."""
    digest = digest or (lambda *parts: F.sha2(F.concat_ws("|", *parts), 256))
    block = F.expr(f"(`{t}` - pmod(`{t}`, {BLOCK_S * per_second}L)) div {BLOCK_S * per_second}L")
    rows = raw.withColumn("\0block", block)
    blocks = rows.groupBy(key, "\0block").agg(F.count("*").alias("\0n"))
    blocks = blocks.withColumn("\0order", digest(F.lit(str(seed)), F.lit("block"), F.col(key), F.col("\0block").cast("string")))
    every = Window.partitionBy(key)
    before = every.orderBy("\0order", "\0block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(key, "\0block", "\0n", F.coalesce(F.sum("\0n").over(before), F.lit(0)).alias("\0before"), F.sum("\0n").over(every).alias("total"))
    blocks = blocks.withColumn("\0drop", F.expr(f"total - (total * {completeness.num}) div {completeness.den}")).drop("total")
    blocks = blocks.withColumn("\0take", F.greatest(F.least(F.col("\0drop") - F.col("\0before"), F.col("\0n")), F.lit(0)))
    met = rows.join(blocks, [key, "\0block"])
    whole = met.where(F.col("\0take") == 0)
    own = digest(F.lit(str(seed)), F.lit("record"), F.col(key), F.col(seq).cast("string"))
    place = F.row_number().over(Window.partitionBy(key, "\0block").orderBy(own, seq))
    part = met.where((F.col("\0take") > 0) & (F.col("\0take") < F.col("\0n"))).withColumn("\0place", place).where(F.col("\0place") > F.col("\0take")).drop("\0place")
    return whole.unionByName(part).select(*raw.columns)


def blackout(raw: DataFrame, sources: list[str], t0: int, t1: int, key: str = "source", t: str = "t") -> DataFrame:
    """Drop rows of ``sources`` with t0 <= t < t1."""
    if t0 >= t1:
        raise ValueError("an empty blackout")
    return raw.where(~(F.col(key).isin(*sources) & (F.col(t) >= t0) & (F.col(t) < t1)))


def backdate(raw: DataFrame, source: str, event_type: str, occurrence: int, shift: int, key: str = "source", seq: str = "seq", t: str = "t") -> DataFrame:
    """Shift the time of one record, the occurrence-th of its source and type by seq (-1: the last); seq stays."""
    chosen = raw.where((F.col(key) == source) & (F.col("event_type") == event_type))
    # Counts by stretch of seq find the stretch; the record is a rank within it.
    n = chosen.count()
    rank = n + occurrence if occurrence < 0 else occurrence
    if not 0 <= rank < n:
        raise ValueError("no record was selected")
    numbered = with_neighbours(chosen.select(key, seq), [key], [seq], [], width=100_000, number="\0place")
    at = numbered.where(F.col("\0place") == rank).select(seq).collect()[0][0]
    return raw.withColumn(t, F.when((F.col(key) == source) & (F.col(seq) == at), F.col(t) + shift).otherwise(F.col(t)))


def strip_identity(raw: DataFrame, keys: list[str], where: Column | None = None, attrs: str = "attrs") -> DataFrame:
    """Remove attribute keys from the map of the rows that ``where`` holds for (all, where none)."""
    where = F.lit(True) if where is None else where
    return raw.withColumn(attrs, F.when(where, F.map_filter(attrs, lambda k, _: ~k.isin(*keys))).otherwise(F.col(attrs)))


def forge(raw: DataFrame, source: str, after_seq: int, count: int, event_type: str, key: str = "source", seq: str = "seq", t: str = "t") -> DataFrame:
    """Insert ``count`` records behind after_seq at whole-number instants between it and the next record, and renumber
    the later ones. The last record, or a gap too narrow for distinct instants, is refused."""
    ends = {r[seq]: r for r in raw.where((F.col(key) == source) & (F.col(seq).isin(after_seq, after_seq + 1))).collect()}
    if len(ends) < 2:
        raise ValueError("there is no record on both sides")
    a, b = ends[after_seq][t], ends[after_seq + 1][t]
    if b - a <= count:
        raise ValueError("the gap is too narrow")
    i = F.col("i")
    model = raw.where((F.col(key) == source) & (F.col(seq) == after_seq))
    new = model.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumns({seq: F.lit(after_seq) + i, t: F.lit(a) + F.expr(f"(i * {b - a}) div {count + 1}"), "event_type": F.lit(event_type)}).select(*raw.columns)
    later = (F.col(key) == source) & (F.col(seq) > after_seq)
    return raw.withColumn(seq, F.when(later, F.col(seq) + count).otherwise(F.col(seq))).unionByName(new)


def manifest(before: DataFrame, after: DataFrame, key: str = "source", seq: str = "seq", values: list[str] | None = None) -> DataFrame:
    """What an operator changed: (source, seq, change) with change removed, added or rewritten."""
    values = values or [c for c in before.columns if c not in (key, seq)]
    pick = lambda df, s: df.select(key, seq, F.struct(*[F.to_json(F.struct(v)).alias(v) for v in values]).alias(s))
    met = pick(before, "b").join(pick(after, "a"), [key, seq], "full")
    change = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").when(F.col("a") != F.col("b"), "rewritten")
    return met.select(key, seq, change.alias("change")).where(F.col("change").isNotNull())


def outside_of(smaller: DataFrame, larger: DataFrame, key: str = "source", seq: str = "seq") -> DataFrame:
    """Records (key, seq) of ``smaller`` that ``larger`` lacks: empty where deletions are nested."""
    return smaller.select(key, seq).join(larger.select(key, seq), [key, seq], "left_anti")


def duplicate(raw: DataFrame, every: int, seq: str = "seq") -> DataFrame:
    """Each record whose seq is a multiple of ``every`` is there twice."""
    return raw.withColumn("\0k", F.explode(F.when(F.col(seq) % every == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("\0k")


def levels(raw: DataFrame, steps: list[Completeness], seed: int, per_second: int, key: str = "source", seq: str = "seq", t: str = "t", digest=None) -> DataFrame:
    """The records that every level of completeness keeps, as rows with ``level`` (per cent), so that all levels of a ladder
    go through the operators behind it together. A record's place in the order of deletion is worked out once, and each
    level is a limit on it: what ``delete`` keeps."""
    digest = digest or (lambda *parts: F.sha2(F.concat_ws("|", *parts), 256))
    block = F.expr(f"(`{t}` - pmod(`{t}`, {BLOCK_S * per_second}L)) div {BLOCK_S * per_second}L")
    rows = raw.withColumn("\0block", block)
    blocks = rows.groupBy(key, "\0block").agg(F.count("*").alias("\0n"))
    blocks = blocks.withColumn("\0order", digest(F.lit(str(seed)), F.lit("block"), F.col(key), F.col("\0block").cast("string")))
    every = Window.partitionBy(key)
    before = every.orderBy("\0order", "\0block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(key, "\0block", F.coalesce(F.sum("\0n").over(before), F.lit(0)).alias("\0before"), F.sum("\0n").over(every).alias("\0total"))
    own = digest(F.lit(str(seed)), F.lit("record"), F.col(key), F.col(seq).cast("string"))
    placed = rows.withColumn("\0place", F.row_number().over(Window.partitionBy(key, "\0block").orderBy(own, seq)))
    met = placed.join(blocks, [key, "\0block"])
    gone = lambda c: F.expr(f"`\0total` - (`\0total` * {c.num}) div {c.den}")
    kept = [F.when(F.col("\0before") + F.col("\0place") > gone(c), F.lit(100 * c.num // c.den)) for c in steps]
    return met.withColumn("level", F.explode(F.filter(F.array(*kept), lambda x: x.isNotNull()))).select(*raw.columns, "level")
