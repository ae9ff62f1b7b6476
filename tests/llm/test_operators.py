"""Every operator on the awkward cases, against brute force."""

import collections
import hashlib
import io
import json
import pickle
import re
import wave
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gapwright.llm import bpe, common, line_dedup, media, minhash, packing, quality_classifier, quality_rules, token_files, toxicity, warc
from gapwright.session import shared_dir

from .cases import BASE, LINE, LONG_LINE, NEAR, ROWS, documents, empty

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_released_after_the_last_batch(monkeypatch):
    """A task's batches come as they are, and its memory goes back once, when they are through."""
    done = []

    class Pool:
        def release_unused(self):
            done.append("released")

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    got = common.released(lambda batches: (x * 2 for x in batches))(iter([1, 2]))
    assert (next(got), next(got), done) == (2, 4, [])
    assert list(got) == [] and done == ["released"]


def test_media_round_trip(spark):
    rows = media.media_query(documents(spark)).collect()
    assert len(rows) == len(ROWS) and media.media_query(empty(spark)).count() == 0
    want = collections.Counter()
    for doc_id, text in ROWS:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want[(doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert want == collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    by = {}
    for r in rows:
        text = [t for d, t in ROWS if d == r.doc_id and hashlib.sha256((t or "").encode() + bytes(-len((t or "").encode()) % 64 if t else 64)).hexdigest() == r.payload_sha256][0] or ""
        assert by.setdefault(text, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)
    with wave.open(io.BytesIO(media.to_wav(b"abc"))) as w:
        assert w.getparams()[:2] == (1, 1) and w.readframes(64).rstrip(b"\0") == b"abc"
    assert media.from_wav(b"no wav") is None and media.from_wav(None) is None
    tone = (128 + 100 * np.sin(np.arange(2048) * 2 * np.pi * 20 / 256)).astype(np.uint8).tobytes()
    assert set(media.frequency_peaks(tone)[:, 0]) == {20}


def test_media_last_hop_counts():
    rng = np.random.default_rng(5)
    for n in (64, 256, 320, 384, 448, 8192 * 128 + 320):
        raw = rng.bytes(n)
        other = raw[:-64] + bytes(x ^ 85 for x in raw[-64:])
        assert len(media.frequency_peaks(raw)) == max(1, -(-n // 128) - 1)
        if n > 256 and n % 128 == 64:
            assert media.peak_pairs(media.frequency_peaks(raw)).tolist() != media.peak_pairs(media.frequency_peaks(other)).tolist()


def test_best_fill_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(rng.integers(8, 40))
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, capacity, 5)}
        used = packing.best_fill(counts, capacity)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= capacity}
        with_first = {max(counts)}
        for length, n in counts.items():
            n -= length == max(counts)
            with_first = {s + length * k for s in with_first for k in range(n + 1) if s + length * k <= capacity}
        assert all(used[x] <= counts[x] for x in used) and used[max(counts)] >= 1
        assert sum(x * n for x, n in used.items()) == max(with_first)


def test_packing(spark):
    rows = packing.packing_query(documents(spark), BYTE).collect()
    own = Tokenizer.from_file(BYTE)
    want = collections.Counter()
    for doc_id, text in ROWS:
        ids = np.array(own.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[(doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert want == collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    padding = []
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding.append(2048 - at)
    assert sum(padding) < 2048
    assert packing.packing_query(empty(spark), BYTE).count() == 0


def test_quality_rules(spark, duck):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.rules_query(documents(spark)).collect()}
    for doc_id, text in ROWS:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        r = rows[doc_id, len(words)]
        seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        cover = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)), doc_id
        assert r.base_failed == (len(words) < 20 or 100 * len(cover) > 30 * len(words))
        assert not (r.base_failed and r.kept)
    assert rows[1, 23].kept and quality_rules.rules_query(empty(spark)).count() == 0


def test_cascade_order_changes_no_verdict(spark):
    rules, df = quality_rules.default_rules(), documents(spark)
    judged = quality_rules.base_counts(df)
    a = judged.select("doc_id", quality_rules.cascade(rules).isNull().alias("k")).collect()
    b = judged.select("doc_id", quality_rules.cascade(rules[::-1]).isNull().alias("k")).collect()
    assert a == b
    made = [quality_rules.Estimate(r.name, 1.0, i) for i, r in enumerate(rules)]
    assert [r.name for r in quality_rules.ordered(rules, made)] == [r.name for r in rules[::-1]]


def labelled(spark, column, rows):
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


def test_costs_order_rules(spark):
    """Of two rules that reject as much, the one that does a hundred times the work comes last, and has the larger cost."""
    dear = quality_rules.matches(F.col("__text"), "\\p{Lu}")
    for k in range(12):
        dear = dear + quality_rules.matches(F.concat(F.col("__text"), F.lit(str(k))), "[\\p{Ll}0-9]")
    rules = [quality_rules.Rule("dear", dear > 0), quality_rules.Rule("cheap", F.col("n_words") > 0)]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(400))) for i in range(60)]
    for _ in range(2):
        made = quality_rules.estimate(documents(spark, rows), rules)
        assert [e.rejected for e in made] == [60, 60] and made[0].seconds > made[1].seconds > 0
        assert [r.name for r in quality_rules.ordered(rules, made)] == ["cheap", "dear"]


@pytest.mark.parametrize("name, least_hits, most_flagged", [("quality", 0.9, 0.03), ("toxic", 0.8, 0.02)])
def test_held_out_labels(spark, name, least_hits, most_flagged):
    """On held-out labels of the bench tables: of the documents to catch so many are caught, and of the others at most so
    many are flagged."""
    from gapwright.session import table

    sf = "/root/testdata/sf0.1"
    query = quality_classifier.classifier_query if name == "quality" else toxicity.toxicity_query
    label = {r.doc_id: r[name] for r in table(spark, sf, "labels").collect()}
    rows = [(r.predicted, label[r.doc_id]) for r in query(table(spark, sf, "documents"), table(spark, sf, "labels")).collect() if r.held_out and r.doc_id in label]
    bad = 0 if name == "quality" else 1
    caught = [p == bad for p, y in rows if y == bad]
    flagged = [p == bad for p, y in rows if y != bad]
    print(name, len(caught), sum(caught), len(flagged), sum(flagged))
    assert sum(caught) >= least_hits * len(caught) and sum(flagged) <= max(1, most_flagged * len(flagged))


def test_pairs_against_a_plain_fit():
    """The fit is the optimum of the logistic loss over pairs: no small step lowers it."""
    rng = np.random.default_rng(3)
    x = rng.random((80, 3))
    label = (x @ [1.5, -1.0, 0.2] + rng.normal(size=80) / 2 > 0.3).astype(float)
    model = quality_classifier.fit_pairs(x, label, pairs=1, ridge=0.01, seed=5)
    z = (quality_classifier.expand(x) - model.mean) / model.scale
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    draw = np.random.default_rng(5)
    most = max(len(good), len(bad))
    left, right = np.resize(draw.permutation(good), most), draw.permutation(np.resize(bad, most))
    loss = lambda w: np.mean(np.log1p(np.exp(-(z[left] - z[right]) @ w))) + 0.005 * w @ w
    for k in range(z.shape[1]):
        for step in (-0.02, 0.02):
            other = model.weights.copy()
            other[k] += step
            assert loss(other) > loss(model.weights)
    worth = np.sort(z @ model.weights)
    below = np.searchsorted(worth, model.cut)
    assert 0 < below < 80 and np.isclose(model.cut, (worth[below - 1] + worth[below]) / 2)


def test_classifier(spark, sf):
    from gapwright.session import table

    rows = quality_classifier.classifier_query(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()
    label = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    model = quality_classifier.train(documents(spark), labelled(spark, "quality", [(1, 1), (18, 0), (19, 0), (8, 1), (4, None), (999, 1)]))
    scored = quality_classifier.score(documents(spark), model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    by = {r.doc_id: r.score for r in scored}
    assert by[18] < 0.7 <= by[2] and by[4] == by[5]
    none = quality_classifier.train(documents(spark), labelled(spark, "quality", []))
    assert {round(r.score, 9) for r in quality_classifier.score(documents(spark), none).collect()} == {0.7}
    assert quality_classifier.score(empty(spark), model).count() == 0


def test_toxicity(spark, sf):
    from gapwright.session import table

    rows = toxicity.toxicity_query(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    docs = spark.createDataFrame([(i, f"word{i} nice idiot" if i % 3 == 0 else f"word{i} nice calm day") for i in range(60)], "doc_id long, text string")
    model = toxicity.train(docs, labelled(spark, "toxic", [(i, int(i % 3 == 0)) for i in range(60)]))
    assert 0 < len(model.buckets) < 200
    by = {r.doc_id: r.toxicity for r in toxicity.score(documents(spark), model).collect()}
    assert by[20] >= 0.7 > by[1] and by[4] == by[5] and by[9] < 0.7
    none = toxicity.train(docs, labelled(spark, "toxic", []))
    assert {r.toxicity for r in toxicity.score(documents(spark), none).collect()} == {0.5}
    assert toxicity.score(empty(spark), model).count() == 0


@pytest.mark.parametrize("head", [0, 7, bpe.HEAD])
def test_bpe(spark, head):
    """With all words rare, a few of them in the head, or all; ids, decoded texts and the query's digests."""
    own = Tokenizer.from_file(BYTE)
    rows = ROWS + [(21, "it's  two   blanks.\nEnd., a;b:c 1.5 é. ß,x \u00a0 y \u3000z \u200b w"), (22, "x " * 3000 + "\U0001d4b3" * 20), (23, " <|endoftext|>"), (24, "\n\n a\t b")]
    got = bpe.encode(documents(spark, rows), BYTE, head=head)
    want = collections.Counter((d, tuple(own.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    found = bpe.decode(got, BYTE, out="again").collect()
    assert want == collections.Counter((r.doc_id, tuple(r.ids)) for r in found)
    assert all(r.text == r.again == own.decode(r.ids, skip_special_tokens=False) for r in found)


def test_bpe_query(spark):
    own = Tokenizer.from_file(BYTE)
    want = collections.Counter()
    for d, t in ROWS:
        ids = own.encode(t or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[d, len(ids), digest(",".join(map(str, ids))), digest(own.decode(ids, skip_special_tokens=False))] += 1
    assert want == collections.Counter(tuple(r) for r in bpe.bpe_query(documents(spark), BYTE).collect())
    assert bpe.bpe_query(empty(spark), BYTE).count() == 0
    odd = spark.createDataFrame([([220, 50256, 162],), (None,), ([],)], "ids array<int>")
    assert [r.text for r in bpe.decode(odd, BYTE).collect()] == [own.decode([220, 50256, 162], skip_special_tokens=False), "", ""]


def test_bpe_words(spark):
    """Words put together are the text; the table has each once; the head stays within both bounds."""
    docs = documents(spark)
    texts = [r.text for r in docs.collect()]
    split = bpe.split_words(pa.array(texts, pa.string()), bpe.specials_of(BYTE)).to_pylist()
    assert all("".join(words) == (text or "") and "" not in words for words, text in zip(split, texts))
    assert bpe.split_words(pa.array(["a b", "", None]), None).to_pylist() == [["a b"], [], []]
    table = bpe.word_table(docs, BYTE).collect()
    assert len({r.word for r in table}) == len(table)
    pieces = {r.word: bytes(r.piece).decode() for r in bpe.decoded(spark.createDataFrame(table), BYTE).collect()}
    assert all(pieces[r.word] == r.word for r in table)
    assert {r.word: r.n for r in table} == collections.Counter(w for words in split for w in words)
    held = spark.createDataFrame(table)
    for most, size in ((5, 10**9), (10**9, 200), (0, 10**9), (10**9, 10**9)):
        head = [r for r in table if r.n >= bpe.head_cut(held, most, size)]
        assert len(head) <= most and sum(2 * len(r.word.encode()) + 4 * len(r.ids) for r in head) <= size
    assert len(head) == len(table)
    values = np.array([0, 1, 2**32 - 1, 255, 256])
    assert bpe.unsqueeze_ints(bpe.squeeze_ints(values)).tolist() == values.tolist()


def test_bpe_packs_words(spark, monkeypatch):
    """A task hands on a row for each bucket and no row for each word, in parts where it holds many; words stay whole."""
    monkeypatch.setattr(bpe, "HELD", 40)
    words = ["", "\0", " a", "\u00df\U0001d4b3"] + [f"w{i}" for i in range(300)]
    batch = bpe.packed(pa.table({"word": words, "n": [2**40 + i for i in range(len(words))]}), 16)
    assert batch.num_rows == 16
    found = {w: n for r in batch.to_pylist() for w, n in zip(*(x.to_pylist() for x in bpe.unpacked(r["many"], r["blob"])))}
    assert found == {w: 2**40 + i for i, w in enumerate(words)}
    for pieces in ([b"a", b"b"], [b"a", b"x"]):
        head = bpe.Head(pa.table({"word": ["a", "b"], "n": [2, 1], "ids": [[1], [2, 3]], "piece": pieces}))
        again = pickle.loads(pickle.dumps(head))
        assert again.words.equals(head.words) and again.ids.equals(head.ids) and again.pieces.to_pylist() == pieces
    docs = documents(spark, [(i, " ".join(f"v{i * j % 701}" for j in range(90))) for i in range(60)] + [(-1, None)])
    want = collections.Counter(w for x in bpe.split_words(pa.array([r.text for r in docs.collect()], pa.string()), bpe.specials_of(BYTE)).to_pylist() for w in x)
    table = bpe.word_table(docs, BYTE, 7).collect()
    assert len(table) == len(want) and {r.word: r.n for r in table} == want


def test_token_files(spark):
    folder = shared_dir(spark)
    index = token_files.write_tokens(documents(spark), WORD, folder, shards=3)
    own = Tokenizer.from_file(WORD)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, collections.Counter()
    rows = token_files.read_tokens(spark, folder, documents_per_task=4).collect()
    for doc_id, text in order:
        ids = np.array(own.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        want[(doc_id, at, ids)] += 1
        at += len(ids) // 4
    assert want == collections.Counter((r.doc_id, r.start, bytes(r.ids)) for r in rows)
    assert index["width"] == 2 and sum(s["ids"] for s in index["shards"]) == at
    store = token_files.Store(folder)
    assert json.loads(store.read("index.json")) == index and not [n for n in store.names() if n.startswith("_")]
    assert token_files.token_files_query(empty(spark), WORD).count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        token_files.write_tokens(documents(spark).withColumn("doc_id", F.lit("x")), WORD, shared_dir(spark))


def brute_components(rows, size, percent=80):
    sets, nodes = collections.defaultdict(list), {}
    for d, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[d].append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    ids = [d for d in sets if d is not None]
    nodes = {d: d for d in ids}

    def find(x):
        while nodes[x] != x:
            x = nodes[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = find(a), find(b)
                nodes[max(u, v)] = min(u, v)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = minhash.near_duplicates(documents(spark), size).collect()
    want = brute_components(ROWS, size)
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert minhash.near_duplicates(empty(spark), size).count() == 0


def test_chains_and_leftovers(spark):
    """A chain in which neighbours are linked and ends are not, among many copies of its first text."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[k * 8 : k * 8 + 100]) for k in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[0]) for i in range(50)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), 2).collect()}
    assert got == brute_components(rows, 2)


def test_ids_with_several_texts(spark):
    """An id with a copy of two unlike documents links both; sizes of sets are those of the row's own text."""
    other = " ".join(f"q{i}" for i in range(40))
    rows = [(1, BASE), (2, other), (5, BASE), (5, other), (6, None), (6, NEAR), (7, "lone words here")]
    got = minhash.near_duplicates(documents(spark, rows), 2).collect()
    want = brute_components(rows, 2)
    assert want == {1: 1, 2: 1, 5: 1, 6: 1, 7: 7} and all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    size = lambda t: len({tuple(w) for w in zip((t or "").lower().split(), (t or "").lower().split()[1:])})
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((d, size(t)) for d, t in rows)


def test_many_alike_but_apart(spark):
    """A group in which all share half keys and few are linked: cells find just the links, and no pair is lost."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(120, size=int(rng.integers(2, 14)), replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), 2).collect()}
    assert got == brute_components(rows, 2) and 1 < len(set(got.values())) < 60


def test_deduplicated_keeps_columns(spark):
    df = documents(spark)
    done = minhash.deduplicated(df, 2)
    rows = done.collect()
    assert done.columns == df.columns
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(d for d, c in brute_components(ROWS, 2).items() if d == c)
    assert sum(r.doc_id is None for r in rows) == 2


def parts_of(line):
    """A line's stretches as (place, masked tokens), with how many constant tokens each has; written apart from the code."""
    tokens = line.split()
    masked = ["<*>" if any(c in "0123456789" for c in t) else t for t in tokens]
    if tokens and set(masked) == {"<*>"}:
        return {(0, "raw", " ".join(tokens)): 1}
    n = len(masked)
    bounds = [(0, n)] if n < 4 else [(n * q // 4, n * (q + 1) // 4) for q in range(4)]
    out = {(n, q, tuple(masked[a:b])): sum(t != "<*>" for t in masked[a:b]) for q, (a, b) in enumerate(bounds)}
    return {k: w for k, w in out.items() if w}


def same_template(one, other):
    a, b = parts_of(one), parts_of(other)
    agreed = sum(w for k, w in a.items() if k in b)
    need = lambda x: max((sum(x.values()) + 1) // 2, min(sum(x.values()), 4))
    return bool(a and b) and agreed >= max(need(a), need(b))


def brute_lost(rows, last):
    order = lambda d: last if d is None else d
    lines = [(order(d), line) for d, t in rows for line in (t or "").split("\n")]
    for d, t in rows:
        yield d, t, [i for i, x in enumerate((t or "").split("\n")) if any(o < order(d) and same_template(x, y) for o, y in lines)]


MORE = [
    (31, "user alice logged in from the front office desk\n" + " ".join("abcdefghijklmnop")), (32, "user bob logged in from the front office desk\n" + " ".join("abcdXfghijkYmnop")),
    (33, " ".join("Zbcdefghijklmnop") + "\n1 2 3\n1 2 3 4 5 6 alpha beta"), (34, "1 2 3\n9 8 7 6 5 4 gamma delta\nits first half is this and rest is other"), (35, "its first half is this but none like it\na b c X\nits first half is"),
]


@pytest.mark.parametrize("text_ids", [False, True])
def test_line_dedup(spark, text_ids):
    cases = [(d if d is None or not text_ids else f"k{d:03}", t) for d, t in ROWS + MORE]
    df = documents(spark, ROWS + MORE)
    if text_ids:
        df = df.withColumn("doc_id", F.format_string("k%03d", "doc_id")).withColumn("doc_id", F.when(F.col("doc_id") != "knull", F.col("doc_id")))
    done = line_dedup.drop_recurring_lines(df, dropped_col="lost")
    got = collections.Counter((r.doc_id, tuple(r.lost), r.text) for r in done.collect())
    want = collections.Counter((d, tuple(lost), None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost)) for d, t, lost in brute_lost(cases, chr(0x10FFFF) if text_ids else line_dedup.LAST))
    assert got == want and done.drop("lost").columns == df.columns
    name = (lambda d: f"k{d:03}") if text_ids else (lambda d: d)
    lost = {d: list(x) for d, x, _ in got}
    assert lost[name(32)] == [0, 1] and lost[name(33)] == [0] and lost[name(34)] == [0] and lost[name(13)] == [] and lost[name(14)] == [0]
    assert line_dedup.drop_recurring_lines(empty(spark)).count() == 0


def test_line_dedup_of_three(spark):
    rows = [(1, "one line of text here\nother line of the text"), (2, "one line of text here\nother line of the text"), (3, "one line of text here")]
    done = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(documents(spark, rows), min_docs=3).collect()}
    assert done == {1: rows[0][1], 2: "other line of the text", 3: ""}


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "All rights reserved.\n7\npage 3\n\none"), (2, "All  rights reserved.\n8\npage 4\n\ntwo"), (3, "\nthree\nAll rights reserved.\n9\npage 5"), (4, "8\n\nfour"), (5, "five\n8")]
    done = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(documents(spark, rows)).collect()}
    assert done == {1: rows[0][1], 2: "8\n\ntwo", 3: "\nthree\n9", 4: "\nfour", 5: "five"}


def test_line_dedup_of_pairs(spark):
    rows = [(1, "this line is in two documents\nShort one."), (2, "Short one.\nalpha"), (3, "beta\nthis line is in two documents")]
    done = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(documents(spark, rows)).collect()}
    assert done == {1: rows[0][1], 2: "alpha", 3: "beta"}


PAGES = [(1, "u1", "<a>"), (2, "u2\r\nX: y", "<a>"), (3, None, None), (4, "u4", ""), (None, "u5", "zz"), (6, "u6", "é" * 100000), (6, "u6", "é" * 100000), (7, "u7", "<a>")]


@pytest.mark.parametrize("least", [0, 3])
def test_warc(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "'x' AS digest")
    folder = shared_dir(spark)
    warc.write_warc(pages, folder, least)
    rows = warc.read_warc(spark, folder).collect()
    last = collections.defaultdict(list)
    for p, _, h in PAGES:
        last[h or ""].append(p if p is not None else -1)
    want = collections.Counter()
    for p, u, h in PAGES:
        body = (h or "").encode()
        top = max(last[h or ""])
        old = len(body) >= least and len(last[h or ""]) > 1 and p != top
        digest = __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
        want[(p, u and u.replace("\r\n", "  "), "revisit" if old else "response", len(body), digest, top if old else None, None if old else body)] += 1
    assert want == collections.Counter((r.page_id, r.target_uri, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows)
    slim = warc.read_warc(spark, folder, "page_id long, record_type string").where("record_type = 'revisit' AND page_id >= 2")
    assert sorted(r.page_id for r in slim.collect()) == [p for p, t in sorted((r.page_id, r.record_type) for r in rows if r.page_id and r.page_id >= 2) if t == "revisit"]
    none = shared_dir(spark)
    warc.write_warc(pages.limit(0), none)
    assert warc.read_warc(spark, none).count() == 0


def test_warc_skips_payloads_it_need_not_read():
    big = warc.member(warc.record_bytes({"page_id": 1, "target_uri": "u", "record_type": "response", "payload_bytes": 400000, "payload_digest": "D", "refers_to": None, "payload": np.random.default_rng(1).bytes(400000)}))

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    raw = Counting(big * 3)
    reader = warc.WarcReader({"path": "/tmp"}, ["page_id", "record_type"])
    rows = [reader.record(f, "x", False, False) for f in reader.records(raw)]
    assert [r["page_id"] for r in rows] == [1, 1, 1] and raw.taken < 20000


def test_near_and_base_differ():
    assert BASE != NEAR
