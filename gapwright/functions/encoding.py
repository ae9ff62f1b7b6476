"""Byte encodings of whole numbers, as columns: big-endian words, LEB128 and an encoding whose byte order is the numbers'."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def big_endian(c: Column, size: int = 8) -> Column:
    """``size`` bytes, the highest first; of a negative number its two's complement."""
    return F.unhex(F.right(F.lpad(F.hex(c.cast("long")), F.lit(16), F.lit("0")), F.lit(2 * size)))


def from_big_endian(b: Column) -> Column:
    """The signed 64-bit number of eight bytes."""
    high = F.conv(F.hex(F.substring(b, 1, 4)), 16, 10).cast("long")
    low = F.conv(F.hex(F.substring(b, 5, 4)), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def ordered(c: Column) -> Column:
    """Eight bytes that sort as the signed numbers do: big-endian with the sign bit turned."""
    return big_endian(c.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))


def leb128(c: Column) -> Column:
    """Unsigned LEB128 of a number from 0 on: seven bits a byte, the lowest first, the top bit set on all but the last."""
    c = c.cast("long")
    byte = lambda k: F.shiftrightunsigned(c, 7 * k).bitwiseAND(F.lit(127))
    more = lambda k: F.shiftrightunsigned(c, 7 * (k + 1)) != 0 if k < 8 else F.lit(False)
    two = lambda n: F.lpad(F.hex(n), F.lit(2), F.lit("0"))
    digits = [F.when(F.lit(k == 0) | (F.shiftrightunsigned(c, 7 * k) != 0), two(byte(k) + F.when(more(k), 128).otherwise(0))).otherwise(F.lit("")) for k in range(9)]
    return F.when(c >= 0, F.unhex(reduce(F.concat, digits)))


def from_leb128(b: Column) -> Column:
    n = F.length(b)
    parts = F.transform(F.sequence(F.lit(1), n), lambda k: F.conv(F.hex(F.substring(b, k, F.lit(1))), 16, 10).cast("long").bitwiseAND(F.lit(127)))
    return F.aggregate(F.reverse(parts), F.lit(0).cast("long"), lambda acc, x: acc * 128 + x)
