"""Line dedup by a log-template tree of fixed depth.

A line is routed by its number of tokens and then, level by level, by PARTS stretches of its tokens, the leading ones
first; tokens with a digit are variable fields and become ``<*>``. Each level has a wildcard child besides those of its
tokens, so any stretch may become a field: a template is a number of tokens and the stretches that it fixes. A line of
fewer than PARTS tokens is one stretch. A template fits a line if it fixes at least half of the line's constant tokens,
and at least LEAST of them where the line has so many; so two lines share a template if they have equally many tokens
and agree in stretches that fix so much of both. A line of fields only has one template, its own text, so that lines of
mere numbers don't count as copies. Blank lines stay.

A template recurs if lines of ``min_docs`` documents have it. Its owner is the smallest id among them. A line is dropped
if one of its templates recurs and has an owner with a smaller id than the line's own document: recurring lines stay in
the first document that has them, and all else is untouched.

1. The stretches of all lines, as 64-bit hashes, are counted; stretches that one document alone has are in no recurring
   template and go, and with them nearly all lines.
2. The stretches that lines have left are combined into templates, at most 2 ^ PARTS - 1 a line, which are counted.
3. Texts meet the numbers of their dropped lines by a shuffle on a hash of id and text.

Counts are partial on the map side, so a line that a third of the documents share is no hot group, and hot stretches and
templates are joined apart.

Defined results: a null text stays null, an empty one empty; a document that loses all its lines has an empty text; a
row without an id is later than any other; ids are numbers or strings; rows that share an id never take lines from each
other (each counts for min_docs, but a template of one id alone never recurs); repeated rows get equal texts and count
once; an empty table gives no rows; other columns are kept (n_chars follows the text where a line was dropped).
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch, ship, written
from .common import WordHashes, mix, skewed_join, with_columns_from_text

PARTS, LEAST, MIN_DOCS = 4, 4, 2
_FIELD = re.compile("[0-9]")
_ODD, _MASKED = np.uint64(0x9E3779B97F4A7C15), 1
#: In place of a missing id: after every other.
LAST, LAST_TEXT = (1 << 63) - 1, "\U0010ffff" * 8


class TokenHashes(WordHashes):
    """Token -> 64-bit hash, the same one for all tokens with a digit."""

    def __missing__(self, word):
        h = _MASKED if _FIELD.search(word) else self.digest(word.encode("utf-8", "surrogatepass")) | 2
        if len(self) >= self.most:
            self.clear()
        self[word] = h
        return h


def stretches(texts: list[str], hashes: TokenHashes) -> list[list[np.ndarray]]:
    """For each text, of the stretches of its lines that have a constant token: hashes, numbers of the lines, places in
    the line, constant tokens, and how many of the line's constant tokens a template must fix."""
    found, lengths, per_text, fields = [], [], [], {}
    for text in texts:
        lines = text.split("\n")
        per_text.append(len(lines))
        for line in lines:
            tokens = line.split()
            own = list(map(hashes.__getitem__, tokens))
            if own and own.count(_MASKED) == len(own):
                fields[len(lengths)] = " ".join(tokens)
                own = [hashes.digest(fields[len(lengths)].encode("utf-8", "surrogatepass")) | 2]
            found += own
            lengths.append(len(own))
    h = np.array(found, np.uint64)
    n = np.array(lengths, np.int64)
    start = np.cumsum(n) - n
    place = np.arange(len(h)) - np.repeat(start, n)
    sums = np.r_[np.uint64(0), np.cumsum(mix(h + place.astype(np.uint64) * _ODD))]
    constant = np.r_[0, np.cumsum(h != _MASKED)]
    whole = n < PARTS
    edges = np.stack([start + np.where(whole, n if q else 0, n * q // PARTS) for q in range(PARTS)] + [start + n], axis=1)
    weight = constant[edges[:, 1:]] - constant[edges[:, :-1]]
    of_line = weight.sum(axis=1)
    need = np.maximum((of_line + 1) // 2, np.minimum(of_line, LEAST))
    # A line of fields stands alone: its hash is of its text, whatever its number of tokens.
    route = n * PARTS
    key = mix((sums[edges[:, 1:]] - sums[edges[:, :-1]]) ^ mix((route[:, None] + np.arange(PARTS)).astype(np.uint64) * _ODD + np.uint64(7)))
    line, at = np.nonzero(weight)
    first = np.cumsum(per_text) - per_text
    cuts = np.searchsorted(line, np.r_[first, len(n)])
    owner = np.repeat(first, np.diff(cuts))
    columns = (key[line, at].view(np.int64), (line - owner).astype(np.int32), at.astype(np.int8), weight[line, at].astype(np.int32), need[line].astype(np.int32))
    return [[c[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())] for c in columns]


def stretched_lines(docs: DataFrame) -> DataFrame:
    """(row_key, owner_id, parts array of key, line, at, weight, need). row_key: a hash of id and text."""

    def make():
        hashes = TokenHashes()
        return lambda texts: stretches(texts, hashes)

    ints = (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))
    fields = [("key", T.ArrayType(T.LongType()), pa.list_(pa.int64())), ("line", *ints), ("at", T.ArrayType(T.ByteType()), pa.list_(pa.int8())), ("weight", *ints), ("need", *ints)]
    text_id = isinstance(docs.schema["doc_id"].dataType, T.StringType)
    owner = F.coalesce(F.col("doc_id"), F.lit(LAST_TEXT)) if text_id else F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    slim = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), owner.alias("owner_id"), "text")
    return with_columns_from_text(slim, "text", fields, make).drop("text").where(F.size("key") > 0)


def shared(rows: DataFrame) -> DataFrame:
    """(key, owner, members) of the keys that rows of several ids have."""
    counts = rows.groupBy("key").agg(F.min("owner_id").alias("owner"), F.max("owner_id").alias("last"), F.count("*").alias("members"))
    return counts.where("owner < last").select("key", "owner", "members")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row_key, dropped array<int>): numbers of the lines that go, for each id and text that loses any."""
    space = Scratch(docs.sparkSession)
    held = space.put("held", stretched_lines(docs))
    rows = held.select("row_key", "owner_id", F.inline(F.arrays_zip("key", "line", "at", "weight", "need")))
    met = skewed_join(rows, space.put("stretches", shared(rows)), "key", "members", [])
    at = lambda q, c: F.max(F.when(F.col("at") == q, F.col(c)))
    lines = met.groupBy("row_key", "owner_id", "line", "need").agg(*[at(q, c).alias(f"{c}{q}") for q in range(PARTS) for c in ("key", "weight")])
    lines = space.put("lines", lines)
    made = []
    for size in range(1, PARTS + 1):
        for fixed in itertools.combinations(range(PARTS), size):
            weight = sum((F.col(f"weight{q}") for q in fixed[1:]), F.col(f"weight{fixed[0]}"))  # null if one is missing
            made.append(F.when(weight >= F.col("need"), F.xxhash64(F.lit(str(fixed)), *[F.col(f"key{q}") for q in fixed])))
    rows = lines.select("row_key", "owner_id", "line", F.explode(F.array_compact(F.array(*made))).alias("key"))
    templates = shared(rows)
    if min_docs > 2:
        enough = rows.groupBy("key").agg(F.count_distinct("row_key").alias("documents")).where(F.col("documents") >= min_docs)
        templates = templates.join(enough.select("key"), "key")
    met = skewed_join(rows, space.put("templates", templates), "key", "members", ["owner"]).where("owner < owner_id")
    out = written(met.groupBy("row_key").agg(F.sort_array(F.collect_set("line")).alias("dropped")))
    space.close()
    return out


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, dropped_col: str | None = None) -> DataFrame:
    """``df`` with recurring lines gone from its texts; ``dropped_col`` adds the numbers (from 0) of a row's lost lines."""
    ship(df.sparkSession)
    lost = dropped_lines(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_docs)
    lost = lost.withColumnsRenamed({"row_key": "\0row", "dropped": "\0dropped"})
    met = df.withColumn("\0key", F.xxhash64(F.col(id_col), F.col(text_col))).join(lost, F.col("\0key") == F.col("\0row"), "left")
    hit = F.col("\0dropped").isNotNull()
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col("\0dropped"), i))
    out = {text_col: F.when(hit, F.array_join(lines, "\n")).otherwise(F.col(text_col))}
    if dropped_col:
        out[dropped_col] = F.sort_array(F.coalesce(F.col("\0dropped"), F.array().cast("array<int>")))
    met = met.withColumns(out)
    if "n_chars" in df.columns:
        met = met.withColumn("n_chars", F.when(hit, F.length(text_col).cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return met.drop("\0key", "\0row", "\0dropped")


def line_dedup_query(docs: DataFrame) -> DataFrame:
    """Per document: its number of lines, the numbers of the lines that go, and the text that stays."""
    done = drop_recurring_lines(docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines")), dropped_col="dropped_lines")
    return done.select("doc_id", "n_lines", F.size("dropped_lines").cast("long").alias("n_dropped"), "dropped_lines", "text")
