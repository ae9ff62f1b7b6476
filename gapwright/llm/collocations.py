"""Phrases of two to four words by the stripes pattern, ranked by how much likelier they are than their parts.

A stripe belongs to a prefix of one to three words of one language: how often the prefix occurs, and an associative
counter of the next words. Tasks build stripes over their own texts and hand them on when they hold many, a row for each
bucket of prefixes; stripes of a prefix are then merged elementwise. Everything is read off them: a phrase's frequency is an entry, the frequencies of
its parts are prefix totals, and what may subsume a phrase is the largest entry of its own stripe and of the stripes
that it ends. A phrase is subsumed by a longer one only if it is by one of a single word more, since that one lies
between them and is at least as frequent.

There are four passes over the texts: words, and stripes of one, two and three words. A phrase can only be frequent if
the two shorter ones in it are, which bitmaps of hashes say to the tasks: their size is bounded (2 to the power of
MOST_BITS bits, 16 bits a phrase below that), and a hash that is met by chance costs a row and changes nothing. Counts
are of the words themselves.

A prefix has at most as many next words as it has occurrences. That of one with over PART of them (another bitmap) is
cut by a hash of the next word into parts, as many as there are PARTs of frequent words; so a part is bounded. A task
merges sorted buckets piece by piece and carries the last one on, added up whenever it has grown by CARRIED bytes.

Defined results: a null text is empty, a null language is ``und`` (an empty one is its own); rows are counted as often as they come; ties are
broken by the phrase; a language without frequent phrases, or an empty table, gives no rows. Only the text and the
language are read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch, ship
from .common import mix, released, skewed_left_join

#: Words of a phrase at most, occurrences at least, the score's factor, the share that subsumes, rows a
#: language, what splits pieces, the language of a null.
LONGEST, LEAST, FACTOR, SHARE, TOP = 4, 30, 2_000_000, 80, 2000
SPLITS, NO_LANG = b".,;:!?\n\x0b\x0c\r", "und"
#: Entries that a task holds before it hands them on, bytes of text that it works on at once, next words in a part.
HELD, CHUNK, PART = 2_000_000, 6_000_000, 65_536
#: Buckets of prefixes in a language, rows that are merged at once, bytes of a bucket that are carried before they are added up.
BUCKETS, PIECE, CARRIED = 2048, 512, 64_000_000
LEAST_BITS, MOST_BITS = 20, 28
#: A byte that no UTF-8 text has marks the end of a piece.
_END = b"\xff"
_PLAIN = bytes(0xFF if b in SPLITS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Stripes on their way, those of a bucket of prefixes in a row: line breaks between the prefixes and blanks between the
#: next words, which have neither; parts and numbers of next words are 32-bit integers, totals and counts 64-bit ones.
PACKED = "lang string, bucket int, prefixes string, parts binary, totals binary, sizes binary, nexts string, counts binary"
MERGED = "lang string, prefix string, part int, total long, nexts array<string>, counts array<long>"
NAMES = ["lang", "prefix", "part", "total", "nexts", "counts"]


class Tokens:
    """The words of some texts in order, with a mark after every piece, as places in a list of the distinct ones."""

    def __init__(self, docs: list[tuple[str, bytes]]):
        self.names = list(dict.fromkeys(lang for lang, _ in docs))
        number = {lang: k for k, lang in enumerate(self.names)}
        parts = pc.split_pattern(pa.array([text.translate(_PLAIN).replace(_END, b" \xff ") + b" \xff" for _, text in docs], pa.binary()), b" ")
        coded = parts.flatten().dictionary_encode()
        self.distinct = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        langs = np.repeat(np.array([number[lang] for lang, _ in docs], np.int64), np.diff(parts.offsets.to_numpy()))
        words = pc.not_equal(self.distinct, b"").to_numpy(zero_copy_only=False)[codes]  # blanks in a row have nothing between
        self.codes, self.langs = codes[words], langs[words]
        self.end = int(np.nonzero(pc.equal(self.distinct, _END).to_numpy(zero_copy_only=False))[0][0])
        self.word_hashes, self.lang_hashes = byte_hashes(self.distinct), byte_hashes(pa.array(self.names, pa.string()))

    def __len__(self) -> int:
        return len(self.codes)

    def _spread(self, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (language, word) pairs of a stretch, as one number each, and for each word the place of its pair."""
        pairs = self.langs[at:to] * len(self.distinct) + self.codes[at:to]
        many = len(self.names) * len(self.distinct)
        if many > 16 * len(pairs) + (1 << 20):
            return np.unique(pairs, return_inverse=True)
        used = np.zeros(many, bool)
        used[pairs] = True
        found = np.nonzero(used)[0]
        table = np.zeros(many, np.int64)
        table[found] = np.arange(len(found))
        return found, table[pairs]

    def counts(self) -> pa.RecordBatch:
        """lang, word, n of the words, without marks."""
        found, where = self._spread(0, len(self))
        n = np.bincount(where, minlength=len(found))
        kept = found % len(self.distinct) != self.end
        found, n = found[kept], n[kept]
        langs, words = pa.array(self.names, pa.string()).take(pa.array(found // len(self.distinct))), self.distinct.take(pa.array(found % len(self.distinct)))
        return pa.RecordBatch.from_arrays([langs, words.cast(pa.string()), pa.array(n)], names=["lang", "word", "n"])

    def places(self, at: int, to: int, known, place) -> np.ndarray:
        """``place(language, word, hash)`` of the words from ``at`` to ``to`` whose hashes ``known`` holds, asked once for each
        distinct one; 0 for the others and for a mark."""
        found, where = self._spread(at, to)
        lang, code = found // len(self.distinct), found % len(self.distinct)
        own = extended(self.lang_hashes[lang], self.word_hashes[code])
        some = np.nonzero((code != self.end) & _holds(*known, extended(np.zeros(len(own), np.uint64), own)))[0]
        out = np.zeros(len(found), np.int64)
        out[some] = [place(self.names[x], word, h) for x, word, h in zip(lang[some].tolist(), self.distinct.take(pa.array(code[some])).to_pylist(), own[some].tolist())]
        return out[where]


def chunks(batches, size: int):
    """Texts as Tokens, ``size`` bytes or a longer text at once."""
    waiting, held = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            waiting.append((lang.as_py(), text.as_py()))
            held += len(waiting[-1][1])
            if held > size:
                yield Tokens(waiting)
                waiting, held = [], 0
    if waiting:
        yield Tokens(waiting)


def extended(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more, from those of the phrases and of the words."""
    return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + more)


#: A number for each byte: a word's hash adds them up, each times an odd number of its place.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def byte_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings or binaries, without nulls."""
    words = words.cast(pa.binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, size = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], np.diff(at)
    odd = mix(np.arange(1, size.max() + 1, dtype=np.uint64)) | np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * odd[np.arange(len(data)) - np.repeat(at[:-1] - at[0], size)])])
    return mix(sums[at[1:] - at[0]] - sums[at[:-1] - at[0]] + size.astype(np.uint64))


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """Hashes of phrases of words with blanks between, as ``extended`` makes them word by word."""
    words = pc.split_pattern(phrases, " ")
    at, coded = words.offsets.to_numpy().astype(np.int64), langs.dictionary_encode()
    own = extended(np.repeat(byte_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)], np.diff(at)), byte_hashes(words.flatten()))
    at, size = at - at[0], np.diff(at)
    h = np.zeros(len(size), np.uint64)
    for k in range(size.max(initial=0)):
        some = size > k
        h[some] = extended(h[some], own[at[:-1][some] + k])
    return h


def summed(counts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Rows (lang, word, n) with equal ones added up."""
    if not counts:
        return []
    table = pa.Table.from_batches(counts).group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")])
    return table.select(["lang", "word", "n_sum"]).rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()


def word_totals(docs: DataFrame) -> DataFrame:
    """lang, word, n of all words. ``docs``: lang and text."""

    chunk, most = CHUNK, HELD // 3

    def run(batches):
        held, rows = [], 0
        for tokens in chunks(batches, chunk):
            held.append(tokens.counts())
            rows += held[-1].num_rows
            if rows > most:
                held = summed(held)
                rows = sum(b.num_rows for b in held)
                if rows > most // 2:
                    yield from held
                    held, rows = [], 0
        yield from summed(held)

    return docs.mapInArrow(released(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequent_bits(phrases: DataFrame, many: int):
    """A bitmap of the hashes of ``phrases`` (lang, phrase): bytes, and the power of two of its bits."""
    power = min(max(LEAST_BITS, int(16 * many).bit_length()), MOST_BITS)

    def run(batches):
        for batch in batches:
            at = phrase_hashes(batch.column(0), batch.column(1)) & np.uint64((1 << power) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + 1)], names=["at"])

    places = phrases.select("lang", "phrase").mapInArrow(released(run), "at long")
    blocks = places.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros(1 << power - 3, np.uint8)
    for r in blocks.toLocalIterator():  # at most 2 ** (MOST_BITS - 15) blocks of 4 KB
        bits[(r.block - 1) * 4096 : r.block * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits, power


def _holds(bits: np.ndarray, power: int, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64((1 << power) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: Bits of a word's place in a task: a key holds three of them.
_BITS = 21
_MASK = (1 << _BITS) - 1


def _added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of keys as one, the counts of equal ones added."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.diff(keys, prepend=-1))[0]
    return keys[first], np.add.reduceat(counts, first)


class Stripes:
    """The stripes of a task, of prefixes of ``level`` words. ``known``: bitmaps of the frequent phrases of 1 to ``level``
    words; ``wide``: that of the prefixes which are cut into ``parts``. A key is a prefix and a next word: places of words,
    or, where the prefix has three, its number among those of the task. Next word 0 counts the prefix itself."""

    def __init__(self, level: int, known: list, wide, parts: int, most: int):
        self.level, self.known, self.wide, self.parts, self.most = level, known, wide, parts, most
        self.reset()

    def reset(self) -> None:
        self.text: list[bytes] = [b""]
        self.hashes: list[int] = [0]
        self.lang_of: list[str] = [""]
        self.place: dict[tuple[str, bytes], int] = {}
        self.number: dict[int, int] = {}
        self.raw: list[np.ndarray] = []
        self.waiting = 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def place_of(self, lang: str, word: bytes, h: int) -> int:
        held = self.place.get((lang, word))
        if held is None:
            held = self.place[lang, word] = len(self.text)
            self.text.append(word)
            self.hashes.append(h)
            self.lang_of.append(lang)
        return held

    def add(self, tokens: Tokens, at: int, count: int) -> None:
        """Count the phrases that start at the ``count`` words from ``at`` on; they may end in the words behind."""
        here = tokens.places(at, at + count + LONGEST - 1, self.known[0], self.place_of)
        ids = np.append(here, np.zeros(LONGEST, np.int64))
        starts = np.arange(len(ids)) < count
        own = np.array(self.hashes, np.uint64)[ids]
        h = extended(np.zeros(len(ids), np.uint64), own)
        ok = ids > 0  # places are those of frequent words alone
        for k in range(1, self.level):  # whether a frequent phrase of k + 1 words starts here
            h = extended(h[:-1], own[k:])
            ok = ok[:-1] & ok[1:] & _holds(*self.known[k], h)
        at = np.nonzero(ok & starts[: len(ok)])[0]
        follows = np.append(ok, False)[at + 1] if self.level > 1 else ok[at + 1]
        code = ids[at]
        for k in range(1, self.level):
            code = code << _BITS | ids[at + k]
        if self.level == 3:
            found, place = np.unique(code, return_inverse=True)
            number = self.number
            code = np.array([number.setdefault(c, len(number)) for c in found.tolist()], np.int64)[place] if len(found) else code
        code <<= _BITS
        self.raw += [code, code[follows] | ids[at[follows] + self.level]]
        self.waiting += len(code) + int(follows.sum())
        if self.waiting > self.most:
            self._settle()

    def full(self) -> bool:
        """Whether three quarters of ``most`` different entries are held, or a quarter as many words."""
        return len(self.keys) > self.most * 3 // 4 or len(self.text) > min(self.most // 4, 1 << _BITS - 1)

    def _settle(self) -> None:
        new, counts = np.unique(np.concatenate(self.raw or [self.keys[:0]]), return_counts=True)
        self.keys, self.counts = _added_up(np.concatenate([self.keys, new]), np.concatenate([self.counts, counts]))
        self.raw, self.waiting = [], 0

    def out(self):
        """Rows of PACKED, the parts of a prefix apart; part 0 carries its total."""
        self._settle()
        if not len(self.keys):
            return
        code, nexts, counts = self.keys >> _BITS, self.keys & _MASK, self.counts
        first = np.nonzero(np.diff(code, prepend=-1))[0]  # of each prefix
        # the places of a prefix's words, first to last
        whole = np.fromiter(self.number, np.int64, len(self.number))[code[first]] if self.level == 3 else code[first]
        places = [whole >> _BITS * k & _MASK for k in range(self.level - 1, -1, -1)]
        hashes = np.array(self.hashes, np.uint64)
        h = np.zeros(len(first), np.uint64)
        for p in places:
            h = extended(h, hashes[p])
        prefix = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
        part = np.zeros(len(code), np.int64)
        if self.parts > 1 and (wide := _holds(*self.wide, h)).any():
            part = np.where(wide[prefix] & (nexts > 0), (hashes[nexts] % np.uint64(self.parts)).astype(np.int64), 0)
            order = np.lexsort((nexts, part, prefix))
            prefix, nexts, part, counts = prefix[order], nexts[order], part[order], counts[order]
        starts = np.nonzero((np.diff(prefix, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))[0]
        total = np.where(nexts[starts] > 0, 0, counts[starts])  # a total comes first in its part 0
        entry = nexts > 0
        ends = np.concatenate([[0], np.cumsum(entry)])
        at, size = ends[starts], np.diff(ends[np.append(starts, len(prefix))])
        nexts, counts, prefix, part = nexts[entry], counts[entry], prefix[starts], part[starts]
        bucket = (extended(h[prefix], part.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
        langs = pa.array(self.lang_of, pa.string()).dictionary_encode()
        lang = langs.indices.to_numpy()[places[0][prefix]]
        order = np.lexsort((bucket, lang))
        at, size, total, prefix, part, row = at[order], size[order], total[order], prefix[order], part[order], (lang * BUCKETS + bucket)[order]
        moved = np.repeat(at - np.cumsum(size) + size, size) + np.arange(len(nexts))
        nexts, counts = nexts[moved], counts[moved]
        text = pa.array(self.text, pa.binary()).cast(pa.string())
        prefixes = pc.binary_join_element_wise(*[text.take(pa.array(p[prefix])) for p in places], " ")
        here = np.nonzero(np.diff(row, prepend=-1))[0]
        made = packed(langs.dictionary.take(pa.array(row[here] // BUCKETS)), row[here] % BUCKETS, here, Rows(None, prefixes, part, total, size, text.take(pa.array(nexts)), counts))
        for k in range(0, made.num_rows, PIECE):
            yield made.slice(k, PIECE)


@dataclass
class Rows:
    """Stripes: language, prefix, part and total of each, its number of next words, and all next words with their counts."""

    langs: pa.Array | None
    prefixes: pa.Array
    parts: np.ndarray
    totals: np.ndarray
    sizes: np.ndarray
    words: pa.Array
    counts: np.ndarray

    def take(self, some: np.ndarray) -> "Rows":
        """The stripes of a mask."""
        held, mask = np.repeat(some, self.sizes), pa.array(some)
        return Rows(self.langs.filter(mask), self.prefixes.filter(mask), self.parts[some], self.totals[some], self.sizes[some], self.words.filter(pa.array(held)), self.counts[held])


def together(several: list[Rows]) -> Rows:
    joined = lambda name: (pa.concat_arrays if name in ("langs", "prefixes", "words") else np.concatenate)([getattr(r, name) for r in several])
    return several[0] if len(several) == 1 else Rows(*[joined(f.name) for f in fields(Rows)])


def _numbers(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)


def _bytes(values: np.ndarray, at: np.ndarray, kind) -> pa.Array:
    """Binaries of the stretches between ``at``."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * np.dtype(kind).itemsize).astype(np.int32)), pa.py_buffer(values.astype(kind).tobytes())])


def _words(column: pa.Array) -> pa.Array:
    """The words of strings with blanks between; an empty string has none."""
    return pc.split_pattern(column.filter(pc.not_equal(column, "")), " ").flatten()


def packed(langs: pa.Array, buckets: np.ndarray, first: np.ndarray, r: Rows) -> pa.RecordBatch:
    """Rows of PACKED from stripes in order; ``first``: the first stripe of each row."""
    at = np.append(first, len(r.sizes))
    entries = np.concatenate([[0], np.cumsum(r.sizes)])[at]
    texts = lambda values, at, between: pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values), between)
    columns = [langs, pa.array(buckets.astype(np.int32)), texts(r.prefixes, at, "\n"), _bytes(r.parts, at, np.int32), _bytes(r.totals, at, np.int64), _bytes(r.sizes, at, np.int32), texts(r.words, entries, " "), _bytes(r.counts, entries, np.int64)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "prefixes", "parts", "totals", "sizes", "nexts", "counts"])


def unpacked(b: pa.RecordBatch) -> Rows:
    prefixes = pc.split_pattern(b.column(2), "\n")
    langs = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(prefixes.offsets.to_numpy()))))
    return Rows(langs, prefixes.flatten(), _numbers(b.column(3), np.int32), _numbers(b.column(4), np.int64), _numbers(b.column(5), np.int32), _words(b.column(6)), _numbers(b.column(7), np.int64))


def added(r: Rows, least: int) -> Rows | None:
    """``r`` with stripes of equal language, prefix and part added elementwise; entries below ``least`` go, and stripes with
    none left and a total below it."""
    codes = lambda x: x.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lang, prefix, parts = r.langs.dictionary_encode(), r.prefixes.dictionary_encode(), int(r.parts.max(initial=0)) + 1
    key = (codes(lang) * len(prefix.dictionary) + codes(prefix)) * parts + r.parts
    found, stripe = np.unique(key, return_inverse=True)
    totals = np.zeros(len(found), np.int64)
    np.add.at(totals, stripe, r.totals)
    words = r.words.dictionary_encode()
    spread = max(len(words.dictionary), 1)
    entry, where = np.unique(np.repeat(stripe, r.sizes) * spread + codes(words), return_inverse=True)
    sums = np.zeros(len(entry), np.int64)
    np.add.at(sums, where, r.counts)
    kept = sums >= least
    of, entry, sums = entry[kept] // spread, entry[kept] % spread, sums[kept]
    sizes = np.bincount(of, minlength=len(found))
    shown = np.nonzero((sizes > 0) | (totals >= least))[0]
    if not len(shown):
        return None
    whole = found[shown] // parts
    return Rows(lang.dictionary.take(pa.array(whole // len(prefix.dictionary))), prefix.dictionary.take(pa.array(whole % len(prefix.dictionary))), found[shown] % parts, totals[shown], sizes[shown], words.dictionary.take(pa.array(entry)), sums)


def listed(r: Rows | None) -> pa.RecordBatch | None:
    """Rows of MERGED."""
    if r is None:
        return None
    offsets = pa.array(np.concatenate([[0], np.cumsum(r.sizes)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([r.langs, r.prefixes, pa.array(r.parts.astype(np.int32)), pa.array(r.totals), pa.ListArray.from_arrays(offsets, r.words), pa.ListArray.from_arrays(offsets, pa.array(r.counts))], names=NAMES)


def stripes(docs: DataFrame, level: int, known: list, wide, parts: int) -> DataFrame:
    """Stripes of the tasks, not merged. ``docs``: lang and text (binary), without nulls."""
    shared, most, chunk = docs.sparkSession.sparkContext.broadcast((known, wide)), HELD, CHUNK

    def run(batches):
        held = Stripes(level, *shared.value, parts, most)
        for tokens in chunks(batches, chunk):
            # A long text goes in stretches that see the words after them, so none brings a task too many words.
            for at in range(0, len(tokens), chunk // 4):
                held.add(tokens, at, chunk // 4)
                if held.full():
                    yield from held.out()
                    held.reset()
        yield from held.out()

    return docs.mapInArrow(released(run), PACKED)


class Merge:
    """Adds up sorted stripes (NAMES: next words with blanks between, counts as 64-bit integers). The last one of a batch may
    go on in the next, so it is carried, whole."""

    def __init__(self, least: int):
        self.least, self.held = least, None

    def batch(self, b: pa.RecordBatch | None):
        """Rows of MERGED that ``b`` completes; None ends."""
        if b is None:
            return listed(added(self.held, self.least)) if self.held else None
        raw = b.column(5).to_pylist()
        new = Rows(b.column(0), b.column(1), b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(), np.array([len(x) // 8 for x in raw], np.int64), _words(b.column(4)), np.frombuffer(b"".join(raw), np.int64))
        new = together([self.held, new] if self.held else [new])
        last = pc.and_(pc.equal(new.langs, new.langs[-1]), pc.equal(new.prefixes, new.prefixes[-1])).to_numpy(zero_copy_only=False) & (new.parts == new.parts[-1])
        self.held = added(new.take(last), 0)
        return listed(added(new.take(~last), self.least))


def buckets_merged(batches, least: int):
    """Rows of MERGED from rows of PACKED in the order of language and bucket."""
    carried, key, limit = [], None, CARRIED
    for whole in batches:
        for at in range(0, whole.num_rows, PIECE):
            b = whole.slice(at, PIECE)
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            tail = next((k + 1 for k in range(len(keys) - 1, -1, -1) if keys[k] != keys[-1]), 0)
            if tail or keys[0] != key:  # what was carried is whole, with the rows of its bucket here
                done = [unpacked(x) for x in [*carried, b.slice(0, tail)] if x.num_rows]
                if done and (made := listed(added(together(done), least))) is not None:
                    yield made
                carried, key, limit = [], keys[-1], CARRIED
            carried.append(b.slice(tail))
            if sum(x.nbytes for x in carried) > limit:
                r = added(together([unpacked(x) for x in carried]), 0)
                carried = [packed(pa.array([key[0]], pa.string()), np.array([key[1]]), np.zeros(1, np.int64), r)]
                limit = CARRIED + carried[0].nbytes
    if carried and (made := listed(added(together([unpacked(x) for x in carried]), least))) is not None:
        yield made


def merged(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """Stripes with equal prefix and part, added elementwise; entries and totals below ``least`` go."""
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lang", "bucket")
    return dealt.sortWithinPartitions("lang", "bucket").mapInArrow(released(lambda batches: buckets_merged(batches, least)), MERGED)


def exact(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(38,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """lang, phrase, a, l, r, score of all phrases that are not subsumed, and n of the language."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = word_totals(texts)
    words = scratch.put("words", counted.groupBy("lang", F.when(F.col("n") >= least, F.col("word")).alias("phrase")).agg(F.sum("n").alias("a")))
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent, known, tables = words.where(F.col("phrase").isNotNull()), [], []
    parts = None
    for level in range(1, LONGEST):
        many = frequent.count()
        parts = parts or max(1, -(-many // PART))
        known.append(frequent_bits(frequent, many))
        wide = frequent_bits(frequent.where(F.col("a") > PART), 0)
        tables.append(scratch.put(f"stripes{level}", merged(stripes(texts, level, known, wide, parts), least)))
        frequent = entries(tables[-1])
    return scored(functools.reduce(DataFrame.unionByName, tables), totals, scratch)


def entries(held: DataFrame) -> DataFrame:
    """lang, prefix, phrase, a of the entries of merged stripes."""
    one = F.explode(F.arrays_zip("nexts", "counts")).alias("e")
    return held.select("lang", "prefix", one).select("lang", "prefix", F.concat_ws(" ", "prefix", "e.nexts").alias("phrase"), F.col("e.counts").alias("a"))


def scored(held: DataFrame, totals: DataFrame, scratch: Scratch) -> DataFrame:
    """Phrases of merged stripes that are not subsumed, with the score of their lowest cut."""
    found = entries(held)
    prefix_totals = held.where(F.col("total") > 0).select("lang", F.col("prefix").alias("phrase"), F.col("total").alias("f"))
    # the largest entry of a phrase's own stripe, and of the phrases that it ends
    several = lambda c: F.col(c).contains(" ")
    ahead = held.where(several("prefix") & (F.size("counts") > 0)).select("lang", F.col("prefix").alias("phrase"), F.array_max("counts").alias("longer"))
    behind = found.where(several("prefix")).select("lang", F.regexp_replace("phrase", "^[^ ]+ ", "").alias("phrase"), F.col("a").alias("longer"))
    above = ahead.unionByName(behind)
    found = scratch.put("phrases", found.drop("prefix"))
    top = above.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    found = found.join(top, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * exact("longer") < SHARE * exact("a"))).drop("longer")
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("rest")))
    sides = found.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.k", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("c.first").alias("part")), F.struct(F.lit("r").alias("side"), F.col("c.rest").alias("part")))).alias("s"))
    asked = scratch.put("asked", sides.select("lang", "phrase", "a", "k", "s.side", F.concat_ws("\0", "lang", "s.part").alias("key")))
    uses = asked.groupBy("key").agg(F.count("*").alias("uses"))
    parts = scratch.put("parts", prefix_totals.select(F.concat_ws("\0", "lang", "phrase").alias("key"), "f").join(uses, "key"))
    met = skewed_left_join(asked, parts, "key", "uses", ["f"], F.concat_ws("\0", "phrase", "k", "side"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    cut = met.groupBy("lang", "phrase", "a", "k").agg(side("l"), side("r"))
    cut = cut.withColumn("score", F.expr(f"(cast({FACTOR} as decimal(20,0)) * cast(a as decimal(18,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score").join(totals, "lang")


def collocations_query(docs: DataFrame) -> DataFrame:
    """The first TOP phrases of each language: Spark keeps no more rows than that of a language in any task."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= TOP)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws
  FROM documents),
g AS (SELECT lang, m, list_slice(ws, i, i + m - 1) AS ws FROM p, range(1, 5) AS u(m), unnest(range(1, len(ws) - m + 2)) AS v(i)),
f AS (SELECT lang, m, ws, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND a >= 30),
k AS (SELECT c.lang, c.m, c.ws, c.a, k, list_slice(c.ws, 1, k) AS left_ws, list_slice(c.ws, k + 1, c.m) AS right_ws FROM c, range(1, 4) AS u(k) WHERE k < c.m),
s AS (SELECT k.lang, k.ws, k.a, k, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * k.a // (x.a::HUGEINT + y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.ws = left_ws JOIN f y ON y.lang = k.lang AND y.ws = right_ws),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS place FROM s),
d AS (SELECT DISTINCT s.lang, s.ws FROM c q, range(2, 4) AS u(m), range(1, 4) AS v(i), c s
  WHERE q.m > u.m AND i + u.m - 1 <= q.m AND s.lang = q.lang AND s.ws = list_slice(q.ws, i, i + u.m - 1) AND 100::HUGEINT * q.a >= 80::HUGEINT * s.a),
z AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, score FROM b ANTI JOIN d ON b.lang = d.lang AND b.ws = d.ws WHERE place = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT o.lang, rank, phrase, a, l, r, t.n, score FROM o JOIN t ON o.lang = t.lang WHERE rank <= 2000
"""
