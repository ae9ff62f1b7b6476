"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

Two small collections of ``tables`` half keys each are made from ``rows`` minhashes a half key. A bucket combines a half
key of the first collection with one of the second: tables * tables buckets of 2 * rows minhashes for 2 * tables * rows
minhashes in all, where plain banding would take tables * tables * 2 * rows. Documents at similarity s share no bucket
with chance 1 - (1 - (1 - s^rows)^tables)^2: 0.04 % at s = 0.8, and falling fast above.

1. Documents with equal sets form a class; only its representative, the smallest id, goes on.
2. A bucket can only be shared if both its half keys are. Half keys that one representative alone has go before any are
   combined, and so do most documents.
3. First links: over the diagonal of the table of buckets, each representative is paired with the smallest id of a
   bucket that most of its buckets have. Sizes that rule a link out drop the pair; the rest are verified on sets made
   again from their texts. Most members of a group of near copies are in one component after that.
4. Half keys whose members are all of one component need no test and go. For each half key of the first collection that
   is left, members outside its usual component are compared with all members of other components, in cells of bounded
   size and where the two share a bucket; the first half key that they share counts, so a pair is compared once. A
   sketch of FINE bytes, one for each of as many more minhashes, made for these documents only, drops pairs of which
   fewer than AGREE agree: at similarity 0.8 that loses a pair with a chance of 2e-8. Then the sets themselves are
   compared, unless one has over LONGEST shingles. No pair is left out for the size of its bucket, and none is a row
   before it passes; of a document's links with one component one is enough. What passes is verified like first links.
5. Components of all links, by alternating large and small stars; copies get the component of their class.

Hot classes, half keys, buckets and centres are joined apart or dealt out by a salt; tables between steps go after their
last use.

Defined results: a null or empty text, or one of white space alone, has no shingles and is linked with nothing; fewer
words than a shingle are one shingle; rows that share an id are one document, with the links of each of its texts; a row
without an id is linked with nothing, has no component and is kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch, ship, written
from .common import WordHashes, mix, released, skewed_join, skewed_left_join, with_columns_from_text

SHINGLE, PERCENT, TABLES, ROWS, FAN = 5, 80, 12, 3, 1000
#: Ids are broadcast up to so many (8 bytes each), and shuffled beyond.
FEW_IDS = 1_000_000
#: Minhashes of the fine sketch, and how many of a hundred must agree in a pair worth verifying.
FINE, AGREE = 512, 70
#: Sets of up to so many shingles are brought to the cells in which documents are compared.
LONGEST = 2048
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, hashes: WordHashes, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, in ascending order; A-Z are lower-cased."""
    words = hashes.of(text.encode("utf-8").lower().split())
    n = min(size, len(words))
    if n == 0:
        return np.empty(0, np.uint64)
    h = words[: len(words) - n + 1]
    for k in range(1, n):
        h = mix(h * _ODD + words[k : len(words) - n + 1 + k])
    return np.unique(h if n == size else mix(h + np.uint64(n)))


def minhashes(shingles: np.ndarray, first: int, count: int) -> np.ndarray:
    """``count`` minhashes, numbered from ``first`` on."""
    salts = mix(np.arange(first + 1, first + count + 1, dtype=np.uint64) * _ODD)
    least = np.full(count, np.iinfo(np.uint64).max)
    step = max(1, (1 << 18) // count)
    for at in range(0, len(shingles), step):
        h = (shingles[None, at : at + step] ^ salts[:, None]) * (salts[:, None] | np.uint64(1))
        h ^= h >> np.uint64(31)
        h *= _ODD
        least = np.minimum(least, h.min(axis=1))
    return least


def half_keys(shingles: np.ndarray, tables: int = TABLES, rows: int = ROWS) -> np.ndarray:
    """2 * tables keys: those of the first collection, then those of the second."""
    keys = minhashes(shingles, 0, 2 * tables * rows).reshape(2 * tables, rows)
    out = keys[:, 0].copy()
    for k in range(1, rows):
        out = mix(out * _ODD + keys[:, k])
    return out


def signatures(docs: DataFrame, shingle: int, tables: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, keys): set_key is a 128-bit hash of the set."""

    def make():
        import xxhash

        hashes = WordHashes()

        def run(texts):
            sets = [shingle_set(t, hashes, shingle) for t in texts]
            return [[len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], [half_keys(s, tables, rows).view(np.int64) if len(s) else None for s in sets]]

        return run

    fields = [("n_shingles", T.LongType(), pa.int64()), ("set_key", T.BinaryType(), pa.binary()), ("keys", T.ArrayType(T.LongType()), pa.list_(pa.int64()))]
    return with_columns_from_text(docs, "text", fields, make).drop("text")


def fine_sketches(docs: DataFrame, shingle: int, after: int) -> DataFrame:
    """(doc_id, n, fine, shingles): the last bytes of FINE minhashes that follow the first ``after``; sets of over LONGEST
    shingles are null."""

    def make():
        hashes = WordHashes()

        def run(texts):
            sets = [shingle_set(t, hashes, shingle) for t in texts]
            return [[len(s) for s in sets], [(mix(minhashes(s, after, FINE)) & np.uint64(0xFF)).astype(np.uint8).tobytes() for s in sets], [s.view(np.int64) if len(s) <= LONGEST else None for s in sets]]

        return run

    return with_columns_from_text(docs, "text", [("n", T.LongType(), pa.int64()), ("fine", T.BinaryType(), pa.binary()), ("shingles", T.ArrayType(T.LongType()), pa.list_(pa.int64()))], make).select("doc_id", "n", "fine", "shingles")


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in the table ``ids``: it is broadcast up to FEW_IDS, else both are shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids.hint("merge"), "doc_id", "left_semi")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles array<bigint>)."""

    def make():
        hashes = WordHashes()
        return lambda texts: [[shingle_set(t, hashes, shingle).view(np.int64) for t in texts]]

    return with_columns_from_text(docs, "text", [("shingles", T.ArrayType(T.LongType()), pa.list_(pa.int64()))], make).select("doc_id", "shingles")


def verified(space: Scratch, pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``pairs`` (a, b) with the sizes of their sets' intersection (inter) and union (uni), as a table of ``space``. A
    document's set is dealt to as many keys as it has thousands of partners, so no task gets a document that many others
    are paired with."""
    a_side = pairs.groupBy(F.col("a").alias("doc_id")).agg(F.count("*").alias("n_a"))
    b_side = pairs.groupBy(F.col("b").alias("doc_id")).agg(F.count("*").alias("n_b"))
    wanted = a_side.join(b_side, "doc_id", "full").select("doc_id", *[F.expr(f"coalesce({n}, 0) div {FAN}").alias(n) for n in ("n_a", "n_b")])
    wanted = space.put("wanted", wanted)
    sets = shingle_sets(of_ids(docs, wanted.select("doc_id")), shingle)
    sets = space.put("sets", sets.join(wanted, "doc_id"))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), F.explode(F.sequence(F.lit(0), F.col(f"n_{name}"))).alias(f"salt_{name}"), F.col("shingles").alias(f"set_{name}"))

    counted = wanted.select(F.col("doc_id").alias("a"), "n_a")
    salted = pairs.join(counted.hint("merge"), "a").join(wanted.select(F.col("doc_id").alias("b"), "n_b").hint("merge"), "b")
    salted = salted.withColumns({"salt_a": F.pmod(F.xxhash64("b"), F.col("n_a") + 1), "salt_b": F.pmod(F.xxhash64("a"), F.col("n_b") + 1)}).drop("n_a", "n_b")
    met = salted.join(side("b").hint("merge"), ["b", "salt_b"]).join(side("a").hint("merge"), ["a", "salt_a"])
    inter = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    met = met.select("a", "b", inter.alias("inter"), F.size("set_a").cast("long").alias("size_a"), F.size("set_b").cast("long").alias("size_b")).withColumn("uni", F.col("size_a") + F.col("size_b") - F.col("inter"))
    met = space.put("verified", met)
    space.drop("wanted", "sets")
    return met


def components(space: Scratch, links: DataFrame) -> DataFrame:
    """(node, component) of each node of ``links`` (a, b): component is the smallest node that it reaches.

    Rounds of large and small stars; a round's links are written, so the lineage stays short. They end when a round
    changes nothing, and then every node is linked to its component's smallest."""
    edges = space.put("edges", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = skewed_left_join(both, least, "u", "n", ["m"], F.col("v"), 2 * before[0]).where("v > u")
        edges = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        near = skewed_left_join(edges, least, "u", "n", ["m"], F.col("v"), before[0])
        edges = space.put("edges", near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = space.put("found", nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    space.drop("edges")
    return found


def shared_halves(space: Scratch, name: str, held: DataFrame, label: str) -> DataFrame:
    """``held`` (doc_id, n, ``label``, halves) with those half keys (at, key) only that documents of several labels have,
    without the documents that have none left; a table of ``space``."""
    own = list(dict.fromkeys(["doc_id", "n", label]))
    rows = held.select(*own, F.inline("halves"))
    mixed = rows.groupBy("key").agg(F.min(label).alias("low"), F.max(label).alias("high"), F.count("*").alias("members"))
    mixed = space.put("mixed", mixed.where("low <> high").select("key", "members"))
    met = skewed_join(rows, mixed, "key", "members", [])
    return space.put(name, met.groupBy(*own).agg(F.collect_set(F.struct("at", "key")).alias("halves")))


def shared_counts(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets[a[k]] and sets[b[k]], which are ascending; equal a stand together."""
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    edges = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)]
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own, others = sets[a[lo]], [sets[k] for k in b[lo:hi].tolist()]
        flat = np.concatenate(others)
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        out[lo:hi] = np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)
    return out


def compared(rows: DataFrame, tables: int, percent: int) -> DataFrame:
    """(a, b) of the pairs worth verifying, of rows sorted by ``cell`` and ``side``: each row of side 0 is compared with the
    rows of side 1 in its cell. Of the pairs of b with a label that are links for sure, the closest goes out."""

    def pairs(t: pa.Table):
        column = lambda name: t.column(name).to_numpy()
        cell, side, at, n, label, usual, order = map(column, ("cell", "side", "at", "n", "label_hash", "usual_hash", "doc_hash"))
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(cell), 2 * tables)
        fine = np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(len(cell), FINE)
        held = t.column("shingles").combine_chunks()
        flat, offsets = held.values.to_numpy().view(np.uint64), held.offsets.to_numpy()
        sets = [flat[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(cell)]))
        others = np.bincount(group, side, len(starts)).astype(np.int64)
        ends = np.r_[starts[1:], len(cell)]
        left = np.flatnonzero(side == 0)
        count, begin = others[group[left]], (ends - others)[group[left]]
        part = np.cumsum(count) // (1 << 14)
        sure, rest = [], []
        for rows_at in np.split(np.arange(len(left)), np.flatnonzero(np.diff(part)) + 1):
            c = count[rows_at]
            a = np.repeat(left[rows_at], c)
            b = np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[rows_at], c)
            kept = (label[a] != label[b]) & ((label[a] == usual[a]) | (order[b] < order[a])) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            a, b = a[kept], b[kept]
            same = keys[a] == keys[b]
            kept = (same[:, :tables].argmax(axis=1) == at[a]) & same[np.arange(len(a)), at[a]] & same[:, tables:].any(axis=1)
            a, b = a[kept], b[kept]
            kept = 100 * (fine[a] == fine[b]).sum(axis=1) >= AGREE * FINE
            a, b = a[kept], b[kept]
            long = np.maximum(n[a], n[b]) > LONGEST
            rest.append((a[long], b[long]))
            a, b = a[~long], b[~long]
            inter = shared_counts(a, b, sets)
            kept = 100 * inter >= percent * (n[a] + n[b] - inter)
            sure.append((a[kept], b[kept], inter[kept] / (n[a] + n[b] - inter)[kept]))
        a, b, alike = (np.concatenate(x) for x in zip(*sure))
        by = np.lexsort((alike, label[a], order[b]))
        a, b = a[by], b[by]
        last = np.r_[(order[b][1:] != order[b][:-1]) | (label[a][1:] != label[a][:-1]), True][: len(a)]
        a, b = np.concatenate([a[last], *(x for x, _ in rest)]), np.concatenate([b[last], *(x for _, x in rest)])
        ids = t.column("doc_id").combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            cell = t.column("cell").to_numpy()
            last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # sorted: the last cell may go on
            if last:
                yield pairs(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    kind = rows.schema["doc_id"].dataType
    return rows.mapInArrow(released(run), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def candidates(space: Scratch, halves: DataFrame, signed: DataFrame, percent: int, tables: int) -> DataFrame:
    """(a, b) of documents of different labels that share a bucket and whose sizes, sketches and sets allow a link.
    signed: (doc_id, n, keys, fine, shingles)."""
    halves = halves.where(F.exists("halves", lambda h: h.at < tables) & F.exists("halves", lambda h: h.at >= tables))
    held = halves.select("doc_id", "n", "label", F.inline(F.filter("halves", lambda h: h.at < tables)))
    usual = held.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("usual"), F.sum("c").alias("members"), (F.sum("c") - F.max("c")).alias("others"))
    met = skewed_join(held, space.put("usual", usual.where("others > 0")), "key", "members", ["usual", "members", "others"])
    met = met.withColumns({"doc_hash": F.xxhash64("doc_id"), "label_hash": F.xxhash64("label"), "usual_hash": F.xxhash64("usual")})
    parts = lambda c: F.expr(f"{c} div {FAN}")
    dealt = lambda c, seed: F.pmod(F.xxhash64("doc_hash", F.lit(seed)), parts(c) + 1)
    each = lambda c: F.sequence(F.lit(0).cast("long"), parts(c))
    cell = lambda side, row, column: F.struct(F.lit(side).alias("side"), F.xxhash64("key", row, column).alias("cell"))
    one = F.transform(each("others"), lambda x: cell(0, dealt("members", 0), x))
    two = F.when(F.col("label_hash") != F.col("usual_hash"), F.transform(each("members"), lambda x: cell(1, x, dealt("others", 1)))).otherwise(F.array().cast("array<struct<side:int,cell:bigint>>"))
    met = met.select("at", "doc_id", "n", "doc_hash", "label_hash", "usual_hash", F.inline(F.concat(one, two)))
    met = met.join(signed, ["doc_id", "n"]).repartition("cell").sortWithinPartitions("cell", "side")
    return compared(met, tables, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, tables: int = TABLES, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    space = Scratch(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = space.put("signed", signatures(docs, shingle, tables, rows))
    known = signed.where(F.col("doc_id").isNotNull())
    classes = space.put("classes", known.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    shared = classes.where("copies > 1")
    # Representatives: the row of a class with its smallest id. Rows of copies drop out at this join.
    reps = known.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"]).dropDuplicates(["doc_id", "set_key"])
    reps = space.put("reps", reps.select("doc_id", F.col("n_shingles").alias("n"), F.transform("keys", lambda k, i: F.struct(i.alias("at"), k.alias("key"))).alias("halves")))
    linked = 100 * F.col("inter") >= percent * F.col("uni")

    # First links: the diagonal buckets, one centre for each document.
    halves = shared_halves(space, "halves", reps, "doc_id")
    diagonal = lambda x: F.transform(F.filter("halves", lambda y: y.at == x.at + tables), lambda y: F.xxhash64(x.at, x.key, y.key))
    keyed = halves.select("doc_id", "n", F.explode(F.flatten(F.transform(F.filter("halves", lambda h: h.at < tables), diagonal))).alias("key"))
    centres = keyed.groupBy("key").agg(F.min("doc_id").alias("centre"), F.min_by("n", "doc_id").alias("centre_n"), F.count("*").alias("members"))
    centres = space.put("centres", centres.where("members > 1"))
    near = skewed_join(keyed, centres, "key", "members", ["centre", "centre_n"])
    near = near.where((F.col("centre") < F.col("doc_id")) & (100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")))
    near = near.groupBy("doc_id", "centre").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.max_by("centre", F.struct("c", "centre")).alias("centre"))
    tested = verified(space, space.put("pairs", near.select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))), docs, shingle)
    # An id with several texts links their classes.
    whole = F.coalesce(F.xxhash64("set_key"), F.lit(0))
    several = known.groupBy("doc_id").agg(F.min(whole).alias("low"), F.max(whole).alias("high")).where("low <> high").select("doc_id")
    several = known.join(several, "doc_id", "left_semi").join(classes, "set_key").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = components(space, tested.where(linked).select("a", "b").union(several))

    # What is left: half keys whose members are of several components.
    labelled = halves.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    halves = shared_halves(space, "halves", space.put("labelled", labelled), "label")
    own = space.put("own", halves.select("doc_id").distinct())
    fine = fine_sketches(of_ids(docs, own), shingle, 2 * tables * rows).join(reps.select("doc_id", "n", F.col("halves.key").alias("keys")), ["doc_id", "n"])
    pairs = candidates(space, halves, space.put("fine", fine), percent, tables)
    tested = verified(space, space.put("pairs", pairs), docs, shingle)
    found = components(space, found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(tested.where(linked).select("a", "b")))
    space.drop("centres", "labelled", "mixed", "usual", "own", "fine", "halves", "pairs", "verified")

    # Classes, then components: both joins may have one class or component with most of the rows.
    placed = skewed_left_join(signed, shared, "set_key", "copies", ["rep"], F.xxhash64("doc_id", "n_shingles")).select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    sizes = shared.groupBy("rep").agg(F.sum("copies").alias("copies"))
    named = found.select(F.col("node").alias("rep"), "component").join(sizes, "rep", "left").select("rep", "component", F.coalesce("copies", F.lit(1)).alias("copies"))
    placed = skewed_left_join(placed, space.put("named", named), "rep", "copies", ["component"], F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    out = written(placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
    space.close()
    return out


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, all columns kept; of rows that share an id one stays. Rows without
    an id stay. The other rows of the table meet the kept ids by a shuffle on the id alone."""
    kept = near_duplicates(docs, shingle, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias("\0id")).where(F.col("\0id").isNotNull()).distinct()
    have = docs.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).join(kept, F.col(id_col) == F.col("\0id"), "left_semi")
    return have.unionByName(docs.where(F.col(id_col).isNull()))


def minhash_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, shingle=2)
