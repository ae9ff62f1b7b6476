"""Exact arithmetic of the model: saturating 64-bit sums, floors, ceilings and ratios. No floating point."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX, MIN = (1 << 63) - 1, -(1 << 63)


def saturating_add(a: Column, b: Column) -> Column:
    """An overflow has the sign of either operand."""
    return F.coalesce(F.try_add(a, b), F.when(a.isNull() | b.isNull(), F.lit(None)).when(a > 0, F.lit(MAX)).otherwise(F.lit(MIN)))


def saturating_subtract(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a, b), F.when(a.isNull() | b.isNull(), F.lit(None)).when(b < 0, F.lit(MAX)).otherwise(F.lit(MIN)))


def floor_div(a: str, n: int) -> Column:
    """a // n, rounded down."""
    return F.expr(f"({a} - pmod({a}, {n}L)) div {n}L")


def ceil_div(a: str, n: int) -> Column:
    return F.expr(f"({a} + pmod(-({a}), {n}L)) div {n}L")


def scaled_threshold(value: str, num: int, den: int) -> tuple[Column, Column]:
    """(ceil(value * num / den), whether it is beyond unsigned 64 bits), worked out in 38 decimal digits."""
    wide = F.expr(f"(cast({value} as decimal(19,0)) * {num} + {den - 1})")
    whole = F.floor(wide / F.lit(den).cast("decimal(19,0)"))
    over = whole > F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")
    return F.when(~over & (whole <= MAX), whole.cast("long")), over


def reduced(num: int, den: int) -> tuple[int, int]:
    if den == 0:
        raise ZeroDivisionError("a ratio over 0")
    g = math.gcd(num, den) or 1
    return num // g, den // g
