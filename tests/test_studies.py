"""Queries over states, paths, late data and skewed clocks against SQL, and their operators against plain Python."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from gapwright.operators import automaton, envelopes, late, paths, temporal
from gapwright.plans import studies  # noqa: F401  (adds its queries)
from gapwright.plans.queries import ORACLE_SQL, QUERIES

NAMES = ["continuity", "continuity_moves", "time_paths", "blast_radius", "best_paths", "late_records", "late_generations", "late_corrected", "envelope_sequence", "envelope_absence", "envelope_distinct"]


@pytest.mark.parametrize("name", NAMES)
def test_studies_against_sql(spark, sf, duck, name):
    want = duck.sql(ORACLE_SQL[name])
    rows = QUERIES[name](spark, sf).select(*want.columns)
    held = want.fetchall()
    assert held and sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, held))


MACHINE = automaton.Machine(["a", "b", "c"], {("a", "x"): "b", ("b", "x"): "c", ("c", "y"): "a", ("b", "y"): "b"})


@pytest.mark.parametrize("width", [2, 3, 512])
def test_machine_is_a_sequential_fold(spark, width):
    """In blocks of two (and blocks of blocks) as in one; unknown and null symbols change nothing."""
    rng = random.Random(width)
    rows = [(i, "k" if i % 10 else "other", rng.randint(-400, 400), rng.choice(["x", "y", "z", None])) for i in range(150)]
    events = spark.createDataFrame(rows, "event_id long, key string, t long, symbol string")
    got = {r.event_id: (r.state_before, r.state_after) for r in automaton.run(events, MACHINE, ["key"], ["t", "event_id"], MACHINE.function(F.col("symbol")), "a", width, span=50).collect()}
    want, state = {}, {"k": "a", "other": "a"}
    for i, key, _, symbol in sorted(rows, key=lambda r: (r[2], r[0])):
        after = MACHINE.moves.get((state[key], symbol), state[key])
        want[i] = (state[key], after)
        state[key] = after
    assert got == want
    empty = automaton.run(events.where("false"), MACHINE, ["key"], ["t", "event_id"], MACHINE.function(F.col("symbol")), "a", width)
    assert empty.count() == 0 and empty.columns == [*events.columns, "state_before", "state_after"]


def test_machine_refuses():
    with pytest.raises(ValueError):
        automaton.Machine(["a"], {("a", "x"): "b"})
    with pytest.raises(ValueError):
        automaton.Machine(["a", "a"], {})


def random_edges(seed, nodes=7, n=40):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes), rng.randrange(30)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_arrivals_against_search(spark, seed):
    edges = random_edges(seed)
    best: dict = {}
    todo = [(0, 5, 0)]
    while todo:  # every walk of four steps at most
        node, t, steps = todo.pop()
        best[node, steps] = min(t, best.get((node, steps), t))
        if steps < 4:
            todo += [(dst, at, steps + 1) for src, dst, at in edges if src == node and at > t]
    want = {(0, node, steps, t) for (node, steps), t in best.items() if all(best.get((node, s), t + 1) > t for s in range(steps))}
    df = spark.createDataFrame(edges, "src long, dst long, t long")
    seeds = spark.createDataFrame([(0, 0, 5), (0, 0, 9)], "seed long, node long, t long")
    front = paths.arrivals(df, seeds, 4)
    assert {tuple(r) for r in front.collect()} == want
    assert {tuple(r) for r in paths.arrivals(df, seeds, 4, until=12).collect()} == {tuple(r) for r in paths.arrivals(df.where("t <= 12"), seeds, 4).collect()}
    kinds = spark.createDataFrame([(n, "even" if n % 2 == 0 else "odd") for n in range(7)], "node long, kind string")
    counted = {(r.steps, r.kind): r.n for r in paths.blast_radius(front, kinds).collect()}
    fewest = {n: min(s for m, s in best if m == n) for n, _ in best}
    assert counted == {(s, k): sum(1 for n, m in fewest.items() if m == s and ("even" if n % 2 == 0 else "odd") == k) for s, k in {(s, "even" if n % 2 == 0 else "odd") for n, s in fewest.items() if s}}
    with pytest.raises(ValueError):
        paths.arrivals(df, seeds, -1)


@pytest.mark.parametrize("k,least", [(1, 1), (3, 1), (2, 2)])
def test_best_paths_against_search(spark, k, least):
    rng = random.Random(k)
    edges = [(s, d, t, rng.randint(1, 3)) for (s, d), t in {(s, d): t for s, d, t in random_edges(5)}.items()]
    found = []
    todo = [(0, 2, 0, (0,))]
    while todo:
        node, t, evidence, path = todo.pop()
        for s, d, at, e in edges:
            if s == node and at > t and e >= least and len(path) <= 3:
                step = (d, at, evidence + e, (*path, d))
                found.append(step)
                todo.append(step)
    want = set()
    for node in {f[0] for f in found}:
        order = sorted((len(p) - 1, -e, p) for n, _, e, p in found if n == node)[:k]
        want |= {(0, node, place, steps, -e, p) for place, (steps, e, p) in enumerate(order, 1)}
    df = spark.createDataFrame(edges, "src long, dst long, t long, evidence long")
    got = paths.best_paths(df, spark.createDataFrame([(0, 0, 2)], "seed long, node long, t long"), k, 3, least).collect()
    assert {(r.seed, r.node, r.place, r.steps, r.evidence, tuple(r.path)) for r in got} == want


@pytest.mark.parametrize("hubs", [3, 0])
def test_hubs_give_what_rounds_give(spark, monkeypatch, hubs):
    """Edges between items and users: by hubs (few of them, or too many) as by rounds; users aren't joined with seeds."""
    rng = random.Random(11)
    sides = [(f"k{rng.randint(0, 2)}", f"u{rng.randint(0, 5)}") for _ in range(60)]
    rows = [(*(p if rng.random() < 0.5 else p[::-1]), rng.randint(0, 25)) for p in sides]
    edges = spark.createDataFrame(rows, "src string, dst string, t long")
    seeds = spark.createDataFrame([(f"u{i}", f"u{i}", i * 2) for i in range(4)], "seed string, node string, t long")
    monkeypatch.setattr(paths, "HUBS", hubs)
    is_hub = lambda c: c.startswith("k")
    for steps in (1, 4, 5):
        want = sorted(map(tuple, paths.arrivals(edges, seeds, steps).collect()))
        assert sorted(map(tuple, paths.fronts(edges, seeds, steps, is_hub).collect())) == want
        fewest = {}
        for seed, node, n, _ in want:
            fewest[seed, node] = min(n, fewest.get((seed, node), n))
        counts = collections.Counter((seed, n, "hub" if node[0] == "k" else "spoke") for (seed, node), n in fewest.items() if n)
        assert {(r.seed, r.steps, r.kind): r.n for r in paths.fronts(edges, seeds, steps, is_hub, counted=True).collect()} == counts
    pairs = edges.groupBy("src", "dst").agg(F.min("t").alias("t"), F.count("*").alias("evidence"))
    for k in (1, 3):
        columns = ["seed", "node", "place", "steps", "evidence", "path"]
        want = paths.best_paths(pairs, seeds, k, 3).select(columns).collect()
        assert want and sorted(map(repr, paths.best_by_hubs(pairs, seeds, k, is_hub).select(columns).collect())) == sorted(map(repr, want))


def test_late_windows_settle(spark):
    """Whatever the delays, the last generation is a full recount, and watermarks never fall."""
    rng = random.Random(4)
    rows = [(i, "s", t, (t + rng.choice([0, 0, 0, 40, 300])) // 10) for i, t in enumerate(rng.randint(0, 500) for _ in range(200))]
    events = spark.createDataFrame(rows, "event_id long, source string, t long, epoch long")
    marks = late.watermarks(events, 20)
    held = sorted((r.epoch, r.watermark) for r in marks.collect())
    assert held[0][1] is None and all(a[1] <= b[1] for a, b in itertools.pairwise(held[1:]))
    rows_of = late.generations(events, marks, ["source"], 50).collect()
    last = {r.t0: r.n for r in sorted(rows_of, key=lambda r: r.generation)}
    assert last == {t0: sum(t0 <= t < t0 + 50 for _, _, t, _ in rows) for t0 in {t // 50 * 50 for _, _, t, _ in rows}}
    assert max(r.generation for r in rows_of) > 1 and all(r.epoch is not None for r in rows_of if r.generation)
    mark = dict(held)
    for r in late.judged(events, marks, 20).collect():
        w = mark[r.epoch]
        assert r.standing == ("ON_TIME" if w is None or r.t >= w else "REOPENED" if r.t >= w - 20 else "QUARANTINED")


def test_no_skew_is_certain(spark):
    """Exact clocks: what is possible is certain, and what the point operators give."""
    rng = random.Random(6)
    rows = [(i, rng.choice("lr"), rng.randint(0, 2), rng.randint(0, 300)) for i in range(120)]
    e = envelopes.enveloped(spark.createDataFrame(rows, "event_id long, source string, user long, t long"), {})
    lo, hi = e.where("source = 'l'"), e.where("source = 'r'")
    got = envelopes.sequence(lo, hi, ["user"], 25, 0).collect()
    want = temporal.sequence_join(lo, hi, ["user"], 25).collect()
    assert all(r.certain for r in got) and sorted((r.l_event_id, r.r_event_id) for r in got) == sorted((r.l_event_id, r.r_event_id) for r in want)
    gone = {r.event_id for r in temporal.absence_join(lo, hi, ["user"], 25).collect()}
    assert {r.event_id: r.absent for r in envelopes.absence(lo, hi, ["user"], 25, 0).collect()} == {r.event_id: "CERTAIN" if r.event_id in gone else "NEVER" for r in lo.collect()}
    assert all(r.n_certain == r.n_possible for r in envelopes.distinct(e, ["user"], "source", 25, 0).collect())
    with pytest.raises(ValueError):
        envelopes.enveloped(e, {"l": (5, 1)})


@pytest.mark.parametrize("seed", [1, 2])
def test_skew_bounds_every_placement(spark, seed):
    """Certain pairs hold, and pairs that aren't possible fail, under any placement of the events."""
    rng = random.Random(seed)
    skews = {"l": (-7, 3), "r": (0, 9)}
    rows = [(i, rng.choice("lr"), 0, rng.randint(0, 120)) for i in range(40)]
    e = envelopes.enveloped(spark.createDataFrame(rows, "event_id long, source string, user long, t long"), skews)
    got = {(r.l_event_id, r.r_event_id): r.certain for r in envelopes.sequence(e.where("source = 'l'"), e.where("source = 'r'"), ["user"], 15, envelopes.most(skews)).collect()}
    for i, a, _, t in rows:
        for j, b, _, u in rows:
            if (a, b) == ("l", "r"):
                held = [0 < y - x <= 15 for x in range(t - 7, t + 4) for y in range(u, u + 10)]
                assert got.get((i, j)) == (None if not any(held) else all(held))
