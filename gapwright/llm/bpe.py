"""Byte-level BPE through a table of distinct words.

1. Split. Spark's tasks cut texts into words (a word carries the blank before it) where the tokenizer's own pre-tokenizer
   always cuts, by Arrow's kernels and a batch at once, and add them up: first a task its own, then a bucket of hashes
   what the tasks have of it (a compressed row from each). That gives one row a distinct word.
2. Encode. Every distinct word is encoded once, into a written table.
3. Join back. The most frequent words (at most HEAD of them and HEAD_BYTES bytes: a checked broadcast) become numbers in
   the tasks that split a document. Only its other words leave them, as rows of (text, place among its rare words, word)
   that meet the word table and come back by text; the document itself is shuffled once, as numbers.
4. Decode. The ids of the head's words are joined with the table of pieces, whose size is the vocabulary's, and their
   bytes, in order, are a word's decoded form; rare words take their pieces on the map side, as ``decode`` does for any
   ids. A document is the decoded forms of its words by position.

A word outside the head has no more than a HEAD-th of all words (where HEAD binds; HEAD_BYTES binds only if frequent words
are long), so the joins on words and on texts with such words have no hot key. A document without them has no partner: it
gets a key of its own, so copies are dealt out. Texts are told apart by 96 bits of a hash, so the order of rows is of no
account, and a task that runs again gives the same rows.

Defined results: a null or empty text has no ids and decodes to an empty text; a null array of ids decodes to an
empty text; repeated rows give repeated rows; a null doc_id is
carried; an empty table gives no rows; other columns are dropped; bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import Scratch, ship
from .tokens import encoder

#: The head: words, and their bytes, at most. Rows that are split, and that are put together, at once.
HEAD, HEAD_BYTES, PART, SLICE = 1 << 20, 64 << 20, 4096, 512
#: What stands behind a blank that isn't cut: white space of any Unicode version, so the cut holds in all of them.
_WHITE = "\x09-\x0D\x1C-\x20\x85\xA0\u1680\u180E\u2000-\u200B\u2028\u2029\u202F\u205F\u2060\u3000\uFEFF"
_LATIN = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
#: A blank before a visible character, and the place between a Latin letter and a mark that stands alone behind it.
_CUTS = rf"(?= [^{_WHITE}])|(?<=[{_LATIN}])(?=[.,;:])"
#: Texts in which some blank isn't cut, or that hold the sign that marks cuts in the others.
_UNEVEN = rf" (?:\z|[{_WHITE}])"
_MARK = "\0"
WORDS = "word string, n long, ids array<int>"
#: Distinct words that a task holds before it hands them on, buckets of words at least, rows of packed words.
HELD, BUCKETS, PACKED = 1_000_000, 256, "bucket int, many int, blob binary"
_CODEC = "zstd"


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, all first bytes first."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def split_words(texts: pa.Array, specials: tuple[str, ...] | None) -> pa.ListArray:
    """The words of each text, which put together are the text; none for a null or empty one. ``specials``: strings that a
    text must not hold to be cut; None where no cut is known to be sound, and every text is one word."""
    texts = pc.fill_null(texts, "")
    odd = pa.array(np.ones(len(texts), bool)) if specials is None else pc.or_(pc.match_substring_regex(texts, _UNEVEN), pc.match_substring(texts, _MARK))
    for special in specials or ():
        odd = pc.or_(odd, pc.match_substring(texts, special))
    marked = pc.replace_substring_regex(pc.replace_substring(texts, " ", _MARK + " "), f"([{_LATIN}])([.,;:])", rf"\1{_MARK}\2")
    parts = pc.split_pattern(marked, _MARK)
    words, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    kept = pc.and_(pc.not_equal(words, ""), pc.invert(odd.take(pa.array(owner)))) if len(owner) else pa.array([], pa.bool_())
    counts = np.bincount(owner[kept.to_numpy(zero_copy_only=False)], minlength=len(texts))
    plain = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), words.filter(kept))
    uneven = np.nonzero(odd.to_numpy(zero_copy_only=False))[0]
    if not len(uneven):
        return plain
    # The others are few as a rule: each is cut by its blanks one by one, or stays whole.
    cut = [[x] if x and (specials is None or any(k in x for k in specials)) else [w for w in re.split(_CUTS, x) if w] for x in texts.take(pa.array(uneven)).to_pylist()]
    place = np.arange(len(texts))
    place[uneven] = len(texts) + np.arange(len(uneven))
    return pa.concat_arrays([plain, pa.array(cut, pa.list_(pa.string()))]).take(pa.array(place))


def specials_of(tokenizer: str) -> tuple[str, ...] | None:
    enc = encoder(tokenizer)
    return tuple(enc.specials) if enc.kind == "blank" else None


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@functools.cache
def piece_table(tokenizer: str) -> list[bytes]:
    """Bytes of each id: as many rows as the vocabulary has."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, size = byte_alphabet(), 0
    pieces = {i: bytes(alphabet[c] for c in p) if all(c in alphabet for c in p) else p.encode("utf-8") for p, i in spec["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode("utf-8") for t in spec.get("added_tokens") or []}
    size = max(pieces, default=-1) + 1
    return [pieces.get(i, b"") for i in range(size)]


def piece_rows(spark, tokenizer: str) -> DataFrame:
    """(id, piece) of the vocabulary."""
    pieces = piece_table(tokenizer)
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.binary())}))


def encoded(counted: pa.Table, whole):
    """Rows of WORDS of (word, n): each word is in one row, so it is encoded once. ``whole``: an encoder's."""
    for b in counted.to_batches(max_chunksize=PART):
        found = [whole(w) for w in b.column(0).to_pylist()]
        ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
        ids = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["word", "n", "ids"])


def decoded(words: DataFrame, tokenizer: str) -> DataFrame:
    """``words`` with ``piece``, their bytes: ids meet the table of pieces, a bounded broadcast that keeps a word's rows
    together and in order, so they are put together where they are. Rows out of order would be refused."""
    met = words.select("word", "n", "ids", F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(piece_rows(words.sparkSession, tokenizer)), "id", "left")
    at, piece = F.coalesce("at", F.lit(0)), F.coalesce("piece", F.lit(b""))
    rows = met.select("word", "n", F.when(at == 0, F.col("ids")).alias("ids"), F.greatest(F.size("ids"), F.lit(1)).alias("many"), at.alias("at"), piece.alias("piece"))

    def run(batches):
        waiting, seen = None, 0
        for b in batches:
            word, n, ids, many, at, piece = b.columns
            many, at = many.to_numpy(), at.to_numpy()
            # a word's rows are ``many`` in a row, counted from 0; one word may go on from batch to batch
            place = 0
            while place < len(at):
                if waiting is None:
                    waiting, seen, parts = (word[place], n[place], ids[place]), 0, []
                take = min(int(many[place]) - seen, len(at) - place)
                if (at[place : place + take] != np.arange(seen, seen + take)).any():
                    raise ValueError("the pieces of a word came apart")
                parts += piece.slice(place, take).to_pylist()
                seen, place = seen + take, place + take
                if seen == many[place - 1]:
                    done.append((*waiting, b"".join(parts)))
                    waiting = None
                if len(done) >= 4096:
                    yield flushed()
        if done:
            yield flushed()

    def flushed():
        cols = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in cols[0]], pa.string()), pa.array([x.as_py() for x in cols[1]], pa.int64()), pa.array([x.as_py() for x in cols[2]], pa.list_(pa.int32())), pa.array(cols[3], pa.binary())], names=["word", "n", "ids", "piece"])

    done: list = []
    return rows.mapInArrow(run, WORDS + ", piece binary")


class Counts:
    """Counts of words, added up whenever more than ``most`` wait."""

    def __init__(self, most: int):
        self.most, self.held, self.waiting = most, [], 0

    def add(self, words: pa.Array, n: pa.Array) -> None:
        self.held.append(pa.table({"word": words, "n": n}))
        self.waiting += len(words)
        if self.waiting > self.most:
            self.held = [self.total()]
            self.waiting = self.held[0].num_rows

    def full(self) -> bool:
        """Whether adding up no longer helps."""
        return self.waiting > self.most // 2

    def total(self) -> pa.Table:
        return pa.concat_tables(self.held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def taken(self) -> pa.Table | None:
        out = self.total() if self.held else None
        self.held, self.waiting = [], 0
        return out


def packed(counted: pa.Table, buckets: int) -> pa.RecordBatch:
    """Rows of PACKED, one for each bucket of words' hashes: lengths and counts of its words, then their bytes."""
    words = counted.column("word").combine_chunks().cast(pa.binary())
    hashes = [np.fromiter(map(zlib.crc32, words.slice(at, 65_536).to_pylist()), np.int64) for at in range(0, len(words), 65_536)]
    bucket = np.concatenate([*hashes, np.zeros(0, np.int64)]) % buckets
    order = np.argsort(bucket, kind="stable")
    bucket, words, counts = bucket[order], words.take(pa.array(order)), counted.column("n").to_numpy()[order]
    offsets, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset :], memoryview(words.buffers()[2] or b"")
    starts = np.nonzero(np.diff(bucket, prepend=-1))[0]
    ends, codec, blobs = np.append(starts[1:], len(bucket)), pa.Codec(_CODEC, 9), []
    for at, to in zip(starts.tolist(), ends.tolist()):
        sizes = np.diff(offsets[at : to + 1]).astype(np.int64)
        raw = planes(np.concatenate([sizes, counts[at:to] >> 32, counts[at:to]]) & 0xFFFFFFFF) + bytes(data[offsets[at] : offsets[to]])
        blobs.append(len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(ends - starts, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "many", "blob"])


def unpacked(many: int, blob: bytes) -> tuple[pa.Array, pa.Array]:
    """Words and counts of a row of PACKED."""
    raw = pa.Codec(_CODEC).decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    sizes, high, low = unplaned(raw[: 12 * many]).astype(np.int64).reshape(3, many)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), many, [None, pa.py_buffer(offsets), pa.py_buffer(raw[12 * many :])])
    return words, pa.array(high << 32 | low)


def word_table(docs: DataFrame, tokenizer: str, buckets: int | None = None) -> DataFrame:
    """(word, n, ids), a row a distinct word. docs: ``text``. A task adds its words up and hands them on packed, a row for
    each bucket of hashes; a bucket is added up where Spark brings its rows together. There are as many buckets as tasks,
    so a bucket holds about what a task has counted."""
    specials, most = specials_of(tokenizer), HELD
    texts = docs.select("text")
    buckets = buckets or max(BUCKETS, texts.rdd.getNumPartitions())

    def count(batches):
        held = Counts(most)
        for b in batches:
            for at in range(0, b.num_rows, PART):
                counted = pc.value_counts(split_words(b.column(0).slice(at, PART), specials).flatten())
                held.add(counted.field("values"), counted.field("counts"))
                if held.full():
                    yield packed(held.taken(), buckets)
        if held.held:
            yield packed(held.taken(), buckets)

    def add_up(batches):
        held, now, whole = Counts(most), None, encoder(tokenizer).whole
        for b in batches:
            for bucket, many, blob in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now and held.held:
                    yield from encoded(held.taken(), whole)
                now = bucket
                held.add(*unpacked(many, blob))
        if held.held:
            yield from encoded(held.taken(), whole)

    rows = texts.mapInArrow(count, PACKED)
    met = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(add_up, WORDS)


def head_cut(words: DataFrame, most: int, most_bytes: int) -> int:
    """The least n so that the words with n or more are within both bounds; counts are rounded down to three digits, so a
    table of few rows decides."""
    size = F.greatest(F.length(F.col("n").cast("string")) - 3, F.lit(0))
    step = F.pow(F.lit(10), size).cast("long")
    rows = words.groupBy((F.expr("n") - F.pmod(F.col("n"), step)).alias("n")).agg(F.count("*").alias("c"), F.sum(2 * F.octet_length("word") + 4 * F.size("ids")).alias("b")).orderBy(F.desc("n")).collect()
    cut, count, size = (rows[0].n + 1) * 1000 if rows else 0, 0, 0
    for r in rows:
        count, size = count + r.c, size + r.b
        if count > most or size > most_bytes:
            break
        cut = r.n
    return cut


class Head:
    """The most frequent words as Arrow columns: a word's number is its place."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("n", "descending")])  # frequent words get small numbers, which take little room
        one = lambda c: pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], table.schema.field(c).type)
        self.words, self.ids, self.pieces = one("word"), one("ids"), one("piece")

    def __reduce__(self):
        """Compressed, since a broadcast is a file in every executor; pieces that are the words themselves go once."""
        same = self.pieces.equals(self.words.cast(pa.binary()))
        table = pa.table({"word": self.words, "ids": self.ids} | ({} if same else {"piece": self.pieces}))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as out:
            out.write_table(table)
        return _head, (sink.getvalue().to_pybytes(),)


def _head(data: bytes) -> Head:
    table = pa.ipc.open_stream(data).read_all()
    head = Head.__new__(Head)
    one = lambda c: pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], table.schema.field(c).type)
    head.words, head.ids = one("word"), one("ids")
    head.pieces = one("piece") if "piece" in table.column_names else head.words.cast(pa.binary())
    return head


def _numbered(texts: pa.Array, head: Head, specials):
    """Of each text: numbers of its words in the head, or from len(head) on the place among its own rare words; these; and
    the text's key."""
    import xxhash

    column = split_words(texts, specials)
    flat = column.flatten()
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    found = pc.index_in(flat, value_set=head.words)
    rare = np.nonzero(found.is_null().to_numpy(zero_copy_only=False))[0]
    numbers = found.fill_null(0).to_numpy().astype(np.int64)
    rare_words = flat.take(pa.array(rare)).to_pylist()
    owner = np.searchsorted(offsets, rare, side="right") - 1
    per_row: dict[int, dict[str, int]] = {}
    size = len(head.words)
    for k, (row, word) in enumerate(zip(owner.tolist(), rare_words)):
        places = per_row.setdefault(row, {})
        numbers[rare[k]] = size + places.setdefault(word, len(places))
    for row in range(len(texts)):
        own = per_row.get(row)
        key = xxhash.xxh3_128_digest(texts[row].as_py().encode())[:12] if own else None
        yield numbers[offsets[row] : offsets[row + 1]], own, key


def squeeze_ints(values: np.ndarray) -> bytes:
    """Unsigned integers below 2 ** 52, small ones being the most frequent: each goes as the number of its bits, which
    compresses well, and the bits below its first one, as they are."""
    x = values.astype(np.int64) + 1
    width = np.frexp(x.astype(np.float64))[1].astype(np.int64) - 1
    below = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    bits = (np.repeat(x, width) >> below & 1).astype(np.uint8)
    widths = pa.Codec(_CODEC).compress(width.astype(np.uint8).tobytes(), asbytes=True)
    return len(x).to_bytes(4, "little") + len(widths).to_bytes(4, "little") + widths + np.packbits(bits).tobytes()


def unsqueeze_ints(data: bytes) -> np.ndarray:
    n, at = int.from_bytes(data[:4], "little"), 8 + int.from_bytes(data[4:8], "little")
    width = np.frombuffer(pa.Codec(_CODEC).decompress(data[8:at], n, asbytes=True), np.uint8).astype(np.int64)
    ends = np.cumsum(width)
    total = int(ends[-1]) if n else 0
    below = np.arange(total) - np.repeat(ends - width, width)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at), count=total).astype(np.int64) << below
    sums = np.concatenate([[0], np.cumsum(bits)])
    return sums[ends] - sums[ends - width] + (1 << width) - 1


def rare_rows(docs: DataFrame, tokenizer: str, shared) -> DataFrame:
    """(key, place, word): the words of each text that aren't in the head."""
    specials = specials_of(tokenizer)

    def run(batches):
        head = shared.value
        for b in batches:
            for at in range(0, b.num_rows, PART):
                rows = [(key, j, w) for _, own, key in _numbered(b.column(1).slice(at, PART), head, specials) if own for w, j in own.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.string()))], names=["key", "place", "word"])

    return docs.mapInArrow(run, "key binary, place int, word string")


def numbered(docs: DataFrame, tokenizer: str, shared) -> DataFrame:
    """(key, doc_id, codes): documents as numbers. Those without rare words have keys that no other row has."""
    id_field, specials = docs.schema["doc_id"], specials_of(tokenizer)

    def run(batches):
        head, task, n = shared.value, TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, PART):
                keys, codes = [], []
                for numbers, own, key in _numbered(b.column(1).slice(at, PART), head, specials):
                    n += 1
                    keys.append(key if own else b"no rare words %d:%d" % (task, n))
                    codes.append(squeeze_ints(numbers))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0).slice(at, PART), pa.array(codes, pa.binary())], names=["key", "doc_id", "codes"])

    return docs.mapInArrow(run, T.StructType([T.StructField("key", T.BinaryType()), id_field, T.StructField("codes", T.BinaryType())]))


def answer(text: str) -> tuple[int, list[int]]:
    """Place and ids of a rare word, as ``encode`` sends them."""
    place, ids = text.split(":")
    raw = base64.b64decode(ids)
    return int(place), [int.from_bytes(raw[at : at + 3]) for at in range(0, len(raw), 3)]


def put_together(rows: DataFrame, tokenizer: str, shared) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, codes, answers)."""
    id_field = rows.schema["doc_id"]
    id_type = to_arrow_type(id_field.dataType)

    def run(batches):
        head, table = shared.value, piece_table(tokenizer)
        size, starts = len(head.words), head.ids.offsets.to_numpy().astype(np.int64)
        flat = head.ids.values.to_numpy()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                codes = [unsqueeze_ints(x).astype(np.int64) for x in b.column(1).to_pylist()]
                extra_ids, extra_pieces, base = [], [], 0
                for row, found in enumerate(b.column(2).to_pylist()):
                    if found:
                        c = codes[row]
                        c[c >= size] += base
                        found = sorted(answer(x) for x in found)
                        if [x[0] for x in found] != list(range(len(found))):
                            raise ValueError("a text's rare words came back twice or not at all")
                        extra_ids += [x[1] for x in found]
                        extra_pieces += [b"".join([table[i] for i in x[1]]) for x in found]
                        base += len(found)
                lengths = np.concatenate([np.diff(starts), np.fromiter(map(len, extra_ids), np.int64, len(extra_ids))])
                begin = np.concatenate([starts[:-1], starts[-1] + np.cumsum(lengths[size:]) - lengths[size:]]).astype(np.int64)
                every = np.concatenate([flat[: starts[-1]], *[np.array(x, np.int32) for x in extra_ids]]) if extra_ids else flat
                c = np.concatenate([*codes, np.zeros(0, np.int64)])
                n = lengths[c]
                before = np.concatenate([[0], np.cumsum(n)])
                own = every[np.repeat(begin[c] - before[:-1], n) + np.arange(before[-1])]
                words_to = np.concatenate([[0], np.cumsum([len(x) for x in codes])]).astype(np.int64)
                pieces = pa.chunked_array([head.pieces, pa.array(extra_pieces, pa.binary())]).take(pa.array(c)).combine_chunks()
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(words_to, pa.int32()), pieces), b"")
                ids = pa.ListArray.from_arrays(pa.array(before[words_to], pa.int32()), pa.array(own.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), ids, pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())], names=["doc_id", "ids", "text"])

    return rows.mapInArrow(run, T.StructType([id_field, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())]))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(doc_id, ids, text): the ids that the tokenizers library gives for whole texts, no special tokens added, and the
    text that they decode to."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    asked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    table = scratch.put("words", word_table(asked, tokenizer), _CODEC)
    cut = head_cut(table, head, head_bytes)
    frequent = table.where(F.col("n") >= cut)
    shared = spark.sparkContext.broadcast(Head(decoded(frequent, tokenizer).toArrow()))  # bounded by head_cut
    # An answer is a short string, place:ids of three bytes each in base64: it goes through two shuffles.
    if len(piece_table(tokenizer)) > 1 << 24:
        raise ValueError("ids of over three bytes")
    ids = F.base64(F.unhex(F.array_join(F.transform("ids", lambda x: F.lpad(F.hex(x), 6, "0")), "")))
    met = rare_rows(asked, tokenizer, shared).join(table.where(F.col("n") < cut).select("word", ids.alias("ids")), "word")
    answers = met.groupBy("key").agg(F.collect_set(F.concat_ws(":", "place", "ids")).alias("answers"))
    return put_together(numbered(asked, tokenizer, shared).join(answers, "key", "left").select("doc_id", "codes", "answers"), tokenizer, shared)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with column ``out``, the text of any ids: a map-side join with the table of pieces."""
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]

    def run(batches):
        pieces = np.array(piece_table(tokenizer), object)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [b"".join(pieces[x.values.to_numpy()].tolist()).decode("utf-8", "replace") if x.is_valid else "" for x in b.column(b.schema.get_field_index(ids_col))]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(texts, pa.string())], names=[*names, out])

    return df.mapInArrow(run, T.StructType(kept + [T.StructField(out, T.StringType())]))


def bpe_query(docs: DataFrame, tokenizer: str) -> DataFrame:
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encode(docs, tokenizer).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
