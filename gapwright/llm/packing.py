"""Packing token sequences by minimum bin slack.

1. Ids of every document are cut into full windows and one remainder (< capacity), one row a piece, with its ids.
2. Counts of remainders by length are a histogram of at most ``capacity`` rows, whatever the corpus: only that goes to
   the driver. There a pattern (a multiset of lengths) is chosen that fills a window closest to capacity, by a bitset
   subset-sum over lengths, whose counts are found by backtracking. The pattern is used as often as the counts allow,
   which uses up one length at least; so there are at most ``capacity`` patterns.
3. A task numbers its own pieces of each length; prefix sums over tasks give a piece its rank among all of its length,
   so that a length that many documents share is no hot task. A rank finds its window by a join with the plan.

Defined results: a null or empty text is the end id alone; repeated rows are separate documents, told apart by nothing
but their pieces; a null doc_id is carried; empty tables give no rows; other input columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, written
from .common import released
from .tokens import encoder

CAPACITY, END = 2048, 1


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, part, own): each id of a document, its end id too, in one piece.
    ids: little-endian unsigned 32-bit integers. part: the task; own: pieces of this length before it in the task."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("part", T.LongType()), T.StructField("own", T.LongType())])
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def run(batches):
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                which, start, ids, total = [], [], [], []
                for k, text in enumerate(b.column(1)):
                    got = enc.encode(text.as_py() or "") + end
                    cuts = range(0, len(got), step)
                    which += [k] * len(cuts)
                    start += [c // 4 for c in cuts]
                    ids += [got[c : c + step] for c in cuts]
                    total += [len(got) // 4] * len(cuts)
                sizes, own = [len(x) // 4 for x in ids], []
                for n in sizes:
                    own.append(seen[n])
                    seen[n] += 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array([part] * len(ids), pa.int64()), pa.array(own, pa.int64())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), schema)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of the lengths in counts that holds the longest one and sums closest to capacity from below.

    Bit s of a set says that sum s can be reached. Lengths go in from the longest; a count is split into powers of
    two, so that each length takes a logarithm of shifts. Backtracking from the largest sum gives the counts."""
    first = max(counts)
    room, mask = capacity - first, (1 << (capacity - first + 1)) - 1
    steps, reach = [], 1
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length] - (length == first), room // length), 1
        while left > 0 and not reach >> room & 1:
            n = min(part, left)
            steps.append((length, n, reach))
            reach |= (reach << length * n) & mask
            left, part = left - n, part * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {first: 1}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + n
            at -= length * n
    return used


def plan_windows(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, ranks, in each window, first window, offset) and the number of windows."""
    left, given, rows, window = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while left:
        used = best_fill(left, capacity)
        times, offset = min(left[length] // n for length, n in used.items()), 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, given[length], n * times, n, window, offset))
            given[length] += n * times
            left[length] -= n * times
            offset += length * n
            if not left[length]:
                del left[length]
        window += times
    return rows, window


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END, carry: Sequence[Column | str] = ("ids",)) -> DataFrame:
    """(doc_id, start, length, doc_tokens, *carry, sequence_id, offset): every piece and its place in a window.
    carry: expressions over the columns of ``token_pieces``, worked out before anything is shuffled."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id))
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    full = histogram.pop(capacity, 0)
    rows, _ = plan_windows(histogram, capacity)
    rows = [(capacity, 0, full, 1, 0, 0)] * bool(full) + [(length, rank, n, each, window + full, at) for length, rank, n, each, window, at in rows]
    plan = spark.createDataFrame(rows, "length long, first_rank long, ranks long, each long, window long, at long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # The table of bases grows with the number of tasks, so it is never broadcast.
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.select("doc_id", "start", "length", "doc_tokens", "part", "own", *carry).join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("own")).alias("r")
    # The plan is bounded by the capacity, not by the corpus: a few rows for each pattern, a pattern for each length.
    hit = (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks"))
    placed = ranked.join(F.broadcast(plan.alias("p")), hit)
    names = [c for c in ranked.columns if c not in ("length", "part", "own", "base", "rank", "doc_id", "start", "doc_tokens")]
    return placed.select(
        "doc_id", "start", F.col("r.length").alias("length"), "doc_tokens", *names,
        (F.col("window") + F.expr("(rank - first_rank) div each")).alias("sequence_id"),
        (F.col("at") + F.expr("(rank - first_rank) % each") * F.col("r.length")).alias("offset"),
    )


def packing_query(docs: DataFrame, tokenizer: str) -> DataFrame:
    packed = pack(docs, tokenizer, carry=[F.crc32("ids").alias("ids_crc32")])
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
