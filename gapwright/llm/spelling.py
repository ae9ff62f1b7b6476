"""Groups of spelling variants: k-d trees over letter counts give the words within one edit, most frequent ones are forms.

One edit changes the letter counts of a word by at most one surplus and one missing letter, so an L1 distance of two at
most: a replaced letter between words of one length (one of each), an added letter between neighbouring lengths (a
surplus only). ``Tree`` is a k-d tree over count vectors whose range search takes a block of queries down together and
drops those that a node's box puts out of reach. A tree a length, grown from a bounded sample of words, deals all words
into cells of some ``CELL`` words; a word is data in one cell and asks in every cell whose box its range meets. In a
cell a second tree is grown over the cell's words, and the letter order of what it finds is verified. A pair is found
once, and counts for both its words, whose partial results are added over cells.

A cell that holds more than twice CELL words (one set of letters in many orders) is tiled: data and queries are dealt
into blocks, and every pair of blocks is a task of bounded size. So no pair is lost, and no group is unbounded.

Defined results: a null or empty text has no words; a null id counts as an empty one in the checksum; repeated rows
count again; ties in n go to the word that is smallest in code-point order; a word without near words has n_near 0, no
form and is its own root; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, ship

#: The least length and occurrences of a word, the divisor that picks damaged runs, a form's least ratio.
MIN_LENGTH, MIN_COUNT, DAMAGE, RATIO = 7, 2, 31, 10
#: Words of a cell, words of the sample that cells are cut by, vectors of a leaf inside a cell.
CELL, SAMPLE, LEAF = 16_384, 200_000, 48
#: Words of this length and above share a tree; distinct words that a task counts before it hands them on.
LONG, HELD = 40, 400_000
#: Places of the letters: a to z, then U+00C0 to U+00FF (only A to Z are lower-cased).
LETTERS = 90
_PLACE = np.full(256, -1, np.int16)
_PLACE[97:123] = np.arange(26)
_PLACE[192:256] = np.arange(26, 90)
#: Bytes of Latin-1 to a lower-cased letter, or a blank for all that ends a run.
_RUNS = bytes(b if _PLACE[b] >= 0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def damaged_words(doc_id, text: str) -> Counter:
    """The words of a text of MIN_LENGTH letters or more (Latin-1 bytes), damaged ones without their letter."""
    found: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(_RUNS).split()).items():
        if len(run) < MIN_LENGTH:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= MIN_LENGTH:
            found[run] += n
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: every distinct word with MIN_COUNT occurrences or more. Tasks add up their own words first."""
    ship(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    held.update(damaged_words(doc_id, text))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    asked = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    return asked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """A row of letter counts (at most 255) a word."""
    flat = _PLACE[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
    rows = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    counts = np.bincount(rows * LETTERS + flat, minlength=len(words) * LETTERS).reshape(len(words), LETTERS)
    return np.minimum(counts, 255).astype(np.int16)


def sketch(counts: np.ndarray) -> np.ndarray:
    """Counts up to 3 as unary bits in 21 folded places: bits that differ are never more than the L1 distance."""
    folded = np.zeros((len(counts), 21), np.int64)
    for place in range(LETTERS):
        folded[:, place % 21] += counts[:, place]
    bits = (1 << np.minimum(folded, 3)) - 1
    return (bits.astype(np.uint64) << (3 * np.arange(21)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)


@dataclass
class Node:
    place: int = -1
    cut: int = 0
    low: "Node | None" = None
    high: "Node | None" = None
    leaf: int = -1


class Tree:
    """A k-d tree over rows of letter counts; ``leaf_size`` rows to a leaf where rows differ."""

    def __init__(self, counts: np.ndarray, leaf_size: int):
        self.members: list[np.ndarray] = []
        self.root = self._grow(counts, np.arange(len(counts)), max(leaf_size, 1))

    def _grow(self, counts: np.ndarray, rows: np.ndarray, size: int) -> Node:
        if len(rows) > size:
            here = counts[rows]
            # the place whose median cut is the evenest; of equal ones the widest spread
            median = np.sort(here, axis=0)[(len(rows) - 1) // 2]
            share = (here <= median).sum(axis=0)
            below = (here < median).sum(axis=0)
            cut = np.where(np.abs(2 * share - len(rows)) <= np.abs(2 * below - len(rows)), median, median - 1)
            left = np.where(cut == median, share, below)
            place = int(np.argmin(np.abs(2 * left - len(rows))))
            if 0 < left[place] < len(rows):
                to_low = here[:, place] <= cut[place]
                return Node(place, int(cut[place]), self._grow(counts, rows[to_low], size), self._grow(counts, rows[~to_low], size))
        self.members.append(rows)
        return Node(leaf=len(self.members) - 1)

    def home(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out = np.zeros(len(counts), np.int64)
        todo = [(self.root, np.arange(len(counts)))]
        while todo:
            node, rows = todo.pop()
            if node.leaf >= 0:
                out[rows] = node.leaf
            elif len(rows):
                to_low = counts[rows, node.place] <= node.cut
                todo += [(node.low, rows[to_low]), (node.high, rows[~to_low])]
        return out

    def reach(self, counts: np.ndarray, surplus: int, missing: int):
        """(leaf, rows of ``counts``) for every leaf whose box holds vectors with at most ``surplus`` letters more and
        ``missing`` letters less than a row has."""
        n = len(counts)
        todo = [(self.root, np.arange(n), np.zeros(n, np.int16), np.zeros(n, np.int16), {})]
        while todo:
            node, rows, more, less, box = todo.pop()
            if node.leaf >= 0:
                yield node.leaf, rows
                continue
            at = counts[rows, node.place]
            low, high = box.get(node.place, (0, 1 << 14))
            top = min(high, node.cut)  # the lower child: at most ``cut`` of this letter
            now = less + np.maximum(at - top, 0) - np.maximum(at - high, 0)
            ok = now <= missing
            if ok.any():
                todo.append((node.low, rows[ok], more[ok], now[ok], box | {node.place: (low, top)}))
            bottom = max(low, node.cut + 1)
            now = more + np.maximum(bottom - at, 0) - np.maximum(low - at, 0)
            ok = now <= surplus
            if ok.any():
                todo.append((node.high, rows[ok], now[ok], less[ok], box | {node.place: (bottom, high)}))


def _padded(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def one_edit(short: np.ndarray, other: np.ndarray, added: bool) -> np.ndarray:
    """Rows (padded to one width, real bytes first) that differ by one replaced letter, or by one that ``other`` adds."""
    if not added:
        return (short != other).sum(axis=1) == 1
    before, after = short[:, :-1] != other[:, :-1], short[:, :-1] != other[:, 1:]
    first = np.where(before.any(axis=1), before.argmax(axis=1), before.shape[1])
    last = np.where(after.any(axis=1), after.shape[1] - 1 - after[:, ::-1].argmax(axis=1), -1)
    return last < first


def near_pairs(data: list[bytes], asked: list[bytes], added: bool):
    """(places in asked, places in data) of words one edit apart, in blocks: by a replaced letter where the asked word is
    the smaller one, or where the data word has one letter more. All data have one length, all asked have one."""
    vectors, queries = letter_counts(data), letter_counts(asked)
    marks, asks = sketch(vectors), sketch(queries)
    width = len(data[0]) + 1
    shown, sought = _padded(data, width), _padded(asked, width)
    tree = Tree(vectors, LEAF)
    for leaf, rows in tree.reach(queries, 1, 0 if added else 1):
        inside = tree.members[leaf]
        for at in range(0, len(rows), step := max(1, 2_000_000 // len(inside))):
            part = rows[at : at + step]
            q, d = np.nonzero(np.bitwise_count(asks[part][:, None] ^ marks[inside][None, :]) <= 2)
            q, d = part[q], inside[d]
            ok = one_edit(sought[q], shown[d], added)
            q, d = q[ok], d[ok]
            if not added:
                ok = np.fromiter((asked[i] < data[j] for i, j in zip(q, d)), bool, len(q))
                q, d = q[ok], d[ok]
            if len(q):
                yield q, d


class Best:
    """Near-word counts, and the near word of largest n (ties: the smallest), of the words of one cell."""

    def __init__(self):
        self.of: dict[bytes, list] = {}

    def add(self, words: list[bytes], near: list[bytes], n: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
        for i, j in zip(at.tolist(), to.tolist()):
            held = self.of.get(words[i])
            key = (-int(n[j]), near[j])
            if held is None:
                self.of[words[i]] = [1, key]
            else:
                held[0] += 1
                held[1] = min(held[1], key)


def search_cell(kind: np.ndarray, words: list[bytes], n: np.ndarray) -> Best:
    """``kind``: 0 data, 1 asks for words of its length, 2 asks for words with a letter more."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    best = Best()
    for length in np.unique(lengths[kind == 0]):
        rows = np.nonzero((kind == 0) & (lengths == length))[0]
        data, data_n = [words[i] for i in rows], n[rows]
        for k, asking in ((1, length), (2, length - 1)):
            rows = np.nonzero((kind == k) & (lengths == asking))[0]
            if not len(rows):
                continue
            asked, asked_n = [words[i] for i in rows], n[rows]
            for q, d in near_pairs(data, asked, k == 2):
                best.add(asked, data, data_n, q, d)
                best.add(data, asked, asked_n, d, q)
    return best


def _length_class(length: int) -> int:
    return min(length, LONG)


def cells(words: DataFrame, seed_size: int = SAMPLE, cell: int = CELL) -> dict[int, Tree]:
    """A tree a length class, from a hashed sample of at most ``seed_size`` words; its leaves hold ``cell`` words or so."""
    by = F.least(F.length("word"), F.lit(LONG))
    sizes = {r.length: r.n for r in words.groupBy(by.alias("length")).agg(F.count("*").alias("n")).collect()}  # LONG rows at most
    total = sum(sizes.values())
    share = max(1, -(-2 * total // seed_size)) if total > seed_size else 1
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select("word").limit(seed_size).collect()
    by_class: dict[int, list[bytes]] = {k: [] for k in sizes}
    for r in drawn:
        by_class[_length_class(len(r.word))].append(r.word.encode("latin-1"))
    return {k: Tree(letter_counts(v) if v else np.zeros((0, LETTERS), np.int16), max(1, len(v) * cell // sizes[k])) for k, v in sorted(by_class.items())}


def _numbered(trees: dict[int, Tree]) -> dict[int, int]:
    """The number of the first cell of each length class."""
    first, at = {}, 0
    for k in sorted(trees):
        first[k] = at
        at += len(trees[k].members)
    return first


def routed(words: DataFrame, trees: dict[int, Tree], blocks: dict[int, int]) -> DataFrame:
    """cell, tile, kind, word, n: each word as data of its cell and as a query of every cell in its reach.
    ``blocks``: blocks of data, and of queries, of the cells that are tiled."""
    shared, first = words.sparkSession.sparkContext.broadcast((trees, blocks)), _numbered(trees)

    def tiles(cell, rows, hashes, data):
        """Rows once for every tile they are in."""
        many = blocks.get(cell, 1)
        if many == 1:
            return rows, np.zeros(len(rows), np.int32)
        own = hashes[rows] % many
        other = np.tile(np.arange(many), len(rows))
        mine = np.repeat(own, many)
        return np.repeat(rows, many), (mine * many + other if data else other * many + mine).astype(np.int32)

    def run(batches):
        trees, _ = shared.value
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            counts = letter_counts(words)
            classes = np.fromiter((_length_class(len(w)) for w in words), np.int64, len(words))
            hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
            for length in np.unique(classes):
                rows = np.nonzero(classes == length)[0]
                found = [(0, length, leaf, rows[homes == leaf]) for homes in [trees[length].home(counts[rows])] for leaf in np.unique(homes)]
                found += [(1, length, leaf, rows[hit]) for leaf, hit in trees[length].reach(counts[rows], 1, 1)]
                longer = _length_class(int(length) + 1)
                if longer in trees:
                    found += [(2, longer, leaf, rows[hit]) for leaf, hit in trees[longer].reach(counts[rows], 1, 0)]
                for kind, k, leaf, hit in found:
                    cell = first[k] + int(leaf)
                    out, tile = tiles(cell, hit, hashes, kind == 0)
                    if len(out):
                        fixed = lambda v, t: pa.array(np.full(len(out), v), t)
                        take = pa.array(out)
                        yield pa.RecordBatch.from_arrays([fixed(cell, pa.int32()), pa.array(tile), fixed(kind, pa.int32()), batch.column(0).take(take), batch.column(1).take(take)], names=["cell", "tile", "kind", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "cell int, tile int, kind int, word string, n long")


def near_words(words: DataFrame, seed_size: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """word, n_near, best (struct of -n and word): of the words that have near ones. ``words``: a written table."""
    ship(words.sparkSession)
    trees = cells(words, seed_size, cell)
    first = _numbered(trees)

    def homes(batches):
        trees = shared.value
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            counts = letter_counts(words)
            classes = np.fromiter((_length_class(len(w)) for w in words), np.int64, len(words))
            out = np.zeros(len(words), np.int32)
            for length in np.unique(classes):
                rows = np.nonzero(classes == length)[0]
                out[rows] = first[length] + trees[length].home(counts[rows])
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["cell"])

    shared = words.sparkSession.sparkContext.broadcast(trees)
    sizes = words.select("word").mapInArrow(homes, "cell int").groupBy("cell").agg(F.count("*").alias("n"))
    blocks = {r.cell: -(-r.n // cell) for r in sizes.where(F.col("n") > 2 * cell).collect()}  # at most the trees' leaves

    def search(table):
        words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        found = search_cell(table.column("kind").to_numpy(), words, table.column("n").to_numpy()).of
        return pa.table({
            "word": pa.array([w.decode("latin-1") for w in found], pa.string()),
            "near": pa.array([v[0] for v in found.values()], pa.int64()),
            "less": pa.array([v[1][0] for v in found.values()], pa.int64()),
            "best": pa.array([v[1][1].decode("latin-1") for v in found.values()], pa.string()),
        })

    partial = routed(words, trees, blocks).groupBy("cell", "tile").applyInArrow(search, "word string, near long, less long, best string")
    return partial.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "best")).alias("best"))


def with_roots(formed: DataFrame, scratch: Scratch) -> DataFrame:
    """``formed`` (word, form) with ``root``. Along a chain n grows by RATIO, so doubling ends after a few rounds; a word
    is the form of no more words than it has near ones, so no key is hot."""
    links = scratch.put("links", formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    round_ = 0
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        stepped = links.join(onward, "root", "left")
        if stepped.where(F.col("beyond").isNotNull()).limit(1).count() == 0:
            break
        round_ += 1
        before = f"links{round_ - 1}" if round_ > 1 else "links"
        links = scratch.put(f"links{round_}", stepped.select("word", F.coalesce("beyond", "root").alias("root")))
        scratch.drop(before)
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed_size: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n of every distinct word."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.put("words", word_counts(docs, id_col, text_col))
    met = words.join(near_words(words, seed_size, cell), "word", "left")
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    formed = scratch.put("formed", met.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.best")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    ))
    scratch.drop("words")
    return with_roots(formed, scratch).select("word", "form", "root", "n", "n_near", "form_n")


def spelling_query(docs: DataFrame) -> DataFrame:
    return spelling_groups(docs)
