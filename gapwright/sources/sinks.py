"""Sinks: relations as Parquet, one folder each, and as canonical JSON lines in a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canon


def write_relations(relations: dict[str, DataFrame], folder: str) -> None:
    for name, df in sorted(relations.items()):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def canonical_rows(df: DataFrame, order: list[str], wide: tuple[str, ...] = ()):
    """Rows as canonical JSON, in order; nulls are absent members and columns ``wide`` travel as text. Rows come one
    partition at a time."""
    plain = df.select([F.col(c).cast("string").alias(c) if c in wide else F.col(c) for c in sorted(df.columns)]).orderBy(*order)
    for r in plain.toLocalIterator():
        yield canon.line({k: v for k, v in r.asDict(recursive=True).items() if v is not None})


def write_jsonl(df: DataFrame, order: list[str], path: str, wide: tuple[str, ...] = ()) -> int:
    n = 0
    with open(path, "wb") as f:
        for line in canonical_rows(df, order, wide):
            f.write(line)
            n += 1
    return n
