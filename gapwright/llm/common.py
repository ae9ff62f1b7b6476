"""What several operators share: appended columns, word hashes and joins that bear hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: A key is hot if it has over 1 of HOT_SHARE rows, or of the shuffle partitions where these are more: over a mean task.
#: So hot keys are fewer than that number, whatever the table.
HOT_SHARE = 1000
SLICE = 512


def released(run: Callable) -> Callable:
    """``run`` for mapInArrow, and when its task ends, the memory that it has freed goes back to the system: an idle worker,
    and the next task of a smaller step, would keep it."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
            trim(0)

    return whole


def with_columns_from_text(df: DataFrame, text_col: str, fields: list[tuple[str, T.DataType, pa.DataType]], make: Callable) -> DataFrame:
    """``df`` with ``fields`` appended. ``make()`` runs in each task and gives ``f(list of str) -> list of columns``;
    a null text is an empty one. Columns of these names are replaced, all others are kept as they are."""
    ship(df.sparkSession)
    new = [n for n, _, _ in fields]
    kept = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in kept]
    source = "\0text"
    out = T.StructType(kept + [T.StructField(n, t) for n, t, _ in fields])

    def run(batches):
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                columns = f([x or "" for x in b.column(len(names)).to_pylist()])
                added = [pa.array(c, kind) for c, (_, _, kind) in zip(columns, fields)]
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + added, names=names + new)

    return df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text_col}`").alias(source)).mapInArrow(released(run), out)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; bounded: emptied when it holds ``most`` words."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        import xxhash

        self.most, self.digest = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word):
        h = self.digest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose low bits hang on all bits (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hot_limit(small: DataFrame, count: str, total: int | None = None) -> int:
    """Keys with more rows than this are hot. ``total``: the sum of ``count``, where it is known."""
    total = total if total is not None else small.agg(F.coalesce(F.sum(count), F.lit(0)).alias("t")).collect()[0].t
    share = max(HOT_SHARE, int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(total // share, HOT_SHARE)


def skewed_join(big: DataFrame, small: DataFrame, key: str, count: str, values: list[str]) -> DataFrame:
    """``big`` joined with ``small``, a written table unique by key (``count``: rows of big with that key), for ``values``,
    which replace columns of those names. Rows of hot keys meet a broadcast of these keys, which are few by their
    definition, and never go into the shuffle of the rest."""
    limit = hot_limit(small, count)
    hot = small.where(F.col(count) > limit).select(key, *values)
    rest = small.where(F.col(count) <= limit).select(key, *values)
    big = big.drop(*[v for v in values if v in big.columns])
    near = big.join(F.broadcast(hot), key)
    far = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest.hint("merge"), key)
    return near.unionByName(far)


def skewed_left_join(big: DataFrame, small: DataFrame, key: str, count: str, values: list[str], spread: Column, total: int | None = None) -> DataFrame:
    """``big`` left-joined with ``small`` (unique by key; ``count``: rows of big with that key) for ``values``.

    Hot keys are joined by a broadcast of that bounded table; the rows they match then get a key of their own
    (``spread``) for the shuffled join of the rest, so that no task gets a hot key."""
    limit = hot_limit(small, count, total)
    hot = small.where(F.col(count) > limit).select(F.col(key).alias("\0hot"), *[F.col(v).alias(f"\0h{v}") for v in values])
    rest = small.where(F.col(count) <= limit).select(F.col(key).alias("\0key"), *[F.col(v).alias(f"\0r{v}") for v in values])
    met = big.join(F.broadcast(hot), big[key] == F.col("`\0hot`"), "left")
    met = met.withColumn("\0join", F.when(F.col("`\0hot`").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("\0"), spread.cast("string"))))
    met = met.join(rest.withColumn("\0key", F.col("`\0key`").cast("string")), F.col("`\0join`") == F.col("`\0key`"), "left")
    return met.select(*big.columns, *[F.coalesce(F.col(f"`\0h{v}`"), F.col(f"`\0r{v}`")).alias(v) for v in values])
