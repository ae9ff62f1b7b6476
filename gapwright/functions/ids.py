"""Identities. ``fast`` ids are made natively; ``exact`` ids are domain-separated blake2b-256 over a caller's preimage."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Grammar of ids: a kind of two to twelve letters, a colon, 32 (run-local) or 64 (certifiable) hex digits; names.
HASH_ID = re.compile(r"^[a-z]{2,12}:(?:[0-9a-f]{32}|[0-9a-f]{64})$")
NAME = re.compile(r"^[a-z][a-z0-9_]{0,63}$")
SEPARATOR = "\x1f"


def fast(kind: str, *parts: Column) -> Column:
    """kind:sha256 over length-prefixed parts, so that no two tuples share a preimage; null is told from empty."""
    text = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.concat(F.lit(f"{kind}:"), F.sha2(F.concat_ws(SEPARATOR, F.lit(kind), *text), 256))


def digest(kind: str, payload: bytes, domain: str = "gapwright/v1/") -> str:
    """Hex of blake2b-256(domain + kind + 0x1F + payload)."""
    return hashlib.blake2b(f"{domain}{kind}{SEPARATOR}".encode() + payload, digest_size=32).hexdigest()


def exact(df: DataFrame, payload: str, kind: str, out: str, domain: str = "gapwright/v1/", short: bool = False) -> DataFrame:
    """``df`` with ``out``: the exact id of binary column ``payload`` (its first 128 bits where short)."""
    ship(df.sparkSession)
    names = [f.name for f in df.schema.fields if f.name != out]

    def run(batches):
        for b in batches:
            ids = [None if x is None else f"{kind}:{digest(kind, x, domain)[: 32 if short else 64]}" for x in b.column(b.schema.get_field_index(payload)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(ids, pa.string())], names=[*names, out])

    return df.mapInArrow(run, T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType())]))


def mask_hex(mask: Column) -> Column:
    """0x and 16 hex digits."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(mask)), 16, "0"))


def is_hash_id(c: Column) -> Column:
    return c.rlike(HASH_ID.pattern)
