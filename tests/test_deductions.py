"""Components, evidence, difference constraints and covers against plain Python, and their queries against SQL."""

import itertools
import random

import pytest

from gapwright.functions import repair
from gapwright.operators import evidence, ordering
from gapwright.operators.components import components
from gapwright.plans import deductions  # noqa: F401  (adds its queries)
from gapwright.plans.queries import ORACLE_SQL, QUERIES


def python_components(links):
    root = {x: x for e in links for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (200, 200)]
    frame = spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long")
    assert {r.node: r.component for r in components(frame).collect()} == python_components(links)
    assert components(frame.where("false")).count() == 0


def constraint_case(seed, n=14, m=6):
    rng = random.Random(seed)
    nodes = []
    for i in range(n):
        t = rng.randrange(60)
        nodes.append((i, "ab"[i % 2], i // 2, t - rng.randrange(40), t + rng.randrange(40)))
    return nodes, [(rng.randrange(n), rng.randrange(n), rng.randrange(-15, 40)) for _ in range(m)]


@pytest.mark.parametrize("seed", range(3))
def test_conflicts_are_infeasible_and_witnessed(spark, seed):
    nodes, pairs = constraint_case(seed)
    got = ordering.conflicts(spark.createDataFrame(nodes, "node long, source string, seq long, lo long, hi long"), spark.createDataFrame(pairs, "u long, v long, w long"), width=3).collect()
    every = [("zero", i, hi) for i, _, _, _, hi in nodes] + [(i, "zero", -lo) for i, _, _, lo, _ in nodes] + list(pairs)
    every += [(b[0], a[0], 0) for a in nodes for b in nodes if a[1] == b[1] and a[2] < b[2]]
    assert repair.feasible(every) == (not got)
    weight = {}
    for u, v, w in every:
        weight[u, v] = min(w, weight.get((u, v), w))
    hi, lo = {x[0]: x[4] for x in nodes}, {x[0]: x[3] for x in nodes}
    for r in got:
        bound = hi[r.path[0]] + sum(weight[e] for e in itertools.pairwise(r.path))
        assert r.path[-1] == r.node and bound <= r.bound
        if r.state == ordering.PINNED:
            assert r.bound < lo[r.node]
        else:
            at = r.path.index(r.node)
            assert sum(weight[e] for e in itertools.pairwise(r.path[at:])) < 0


@pytest.mark.parametrize("seed, n, m, cap", [(1, 30, 25, 64), (2, 14, 20, 64), (3, 40, 36, 8), (4, 12, 30, 5)])
def test_cover(spark, seed, n, m, cap):
    rng = random.Random(seed)
    pairs = [p for p in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if p[0] != p[1]]
    got = ordering.cover(spark.createDataFrame(pairs, "u long, v long"), cap).collect()
    chosen = {r.node for r in got}
    assert len(chosen) == len(got) and all(u in chosen or v in chosen for u, v in pairs)
    best, _ = repair.vertex_cover(pairs)
    if cap == 64:
        assert sorted(chosen) == best
    if all(r.exact for r in got):
        assert len(chosen) == len(best)


def test_vertex_cover_is_the_first_of_the_smallest():
    for seed in range(60):
        rng = random.Random(seed)
        pairs = [p for p in ((rng.randrange(10), rng.randrange(10)) for _ in range(rng.randrange(25))) if p[0] != p[1]]
        nodes = sorted({v for p in pairs for v in p})
        want = next(list(c) for size in range(len(nodes) + 1) for c in itertools.combinations(nodes, size) if all(u in c or v in c for u, v in pairs))
        assert repair.vertex_cover(pairs) == (want, True)


def test_cover_greedy_is_the_list_version(spark):
    rng = random.Random(9)
    pairs = sorted({tuple(sorted(rng.sample(range(12), 2))) for _ in range(50)})
    assert min(sum(v in p for p in pairs) for v in range(12)) > 1
    got = ordering.cover(spark.createDataFrame(pairs, "u long, v long"), 5).collect()
    assert (sorted(r.node for r in got), any(r.exact for r in got)) == repair.vertex_cover(pairs, 5)
    assert ordering.cover(spark.createDataFrame([], "u long, v long")).count() == 0


A, L, H = evidence.ANCHOR, evidence.LINK, evidence.HINT


def test_evidence(spark):
    rows = [
        (1, "ACC", "x", A, 0, 10, False), (2, "ACC", "x", A, 5, 15, False), (3, "ACC", "x", A, 15, 20, False),  # 3 begins anew
        (4, "DEV", "d", L, 0, 9, False), (4, "IP", "i", L, 0, 9, False), (1, "DEV", "d", L, 0, 9, False), (1, "IP", "i", L, 2, 9, False),
        (5, "DEV", "d", L, 0, 9, False), (5, "NAME", "n", H, 0, 9, False), (4, "NAME", "n", H, 0, 9, False),  # one link and a hint: nothing
        (6, "ACC", "y", A, 0, 9, False), (6, "DEV", "e", L, 0, 9, False), (6, "IP", "j", L, 0, 9, False),
        (7, "ACC", "z", A, 0, 9, False), (7, "DEV", "e", L, 0, 9, False), (7, "IP", "j", L, 0, 9, False),  # two accounts: refused
        (8, "DEV", "f", L, 0, 9, True), (8, "IP", "k", L, 0, 9, False), (9, "DEV", "f", L, 0, 9, False), (9, "IP", "k", L, 0, 9, None),  # provisional
        (None, "ACC", "x", A, 0, 9, False), (1, None, "x", A, 0, 9, False), (10, "ACC", "q", A, None, None, False), (11, "ACC", "q", A, 3, 4, False),
    ]
    frame = spark.createDataFrame(rows, "obs long, kind string, norm string, class string, t_lo long, t_hi long, provisional boolean")
    got = {r.obs: (r.entity, r.status) for r in evidence.resolve(frame, ["ACC"]).collect()}
    sure, torn, none = evidence.RESOLVED, evidence.AMBIGUOUS, evidence.UNRESOLVED
    assert got == {1: (1, sure), 2: (1, sure), 3: (3, sure), 4: (1, sure), 5: (5, none), 6: (6, torn), 7: (7, torn), 8: (8, torn), 9: (9, torn), 10: (10, sure), 11: (10, sure)}
    assert evidence.resolve(frame.where("false"), ["ACC"]).count() == 0


@pytest.mark.parametrize("width", [3, 1000])
def test_islands_across_buckets(spark, width):
    rng = random.Random(width)
    spans = [(i, "k", t, t + rng.randrange(1, 12)) for i, t in ((i, rng.randrange(-60, 120)) for i in range(40))]
    links = evidence.overlapping(spark.createDataFrame(spans, "obs long, key string, t_lo long, t_hi long"), ["key"], width)
    want = python_components([(a[0], b[0]) for a in spans for b in spans if max(a[2], b[2]) < min(a[3], b[3])])
    assert {r.node: r.component for r in components(links).collect()} == want


@pytest.mark.parametrize("name", ["evidence_entities", "order_conflicts", "order_broken"])
def test_deductions_against_sql(spark, sf, duck, name):
    want = duck.sql(ORACLE_SQL[name])
    rows = QUERIES[name](spark, sf).select(*want.columns)
    held = want.fetchall()
    assert held and sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, held))


def test_order_cover_is_the_list_version(spark, sf, duck):
    pairs = duck.sql(f"SELECT u, v FROM ({ORACLE_SQL['order_broken']})").fetchall()
    rows = QUERIES["order_cover"](spark, sf).collect()
    groups: dict = {}
    root = python_components(pairs)
    for u, v in pairs:
        groups.setdefault(root[u], []).append((u, v))
    assert pairs and all(r.exact for r in rows)
    assert sorted(r.event_id for r in rows) == sorted(v for g in groups.values() for v in repair.vertex_cover(g)[0])


def test_order_cover_against_sql(spark, sf, duck):
    want = duck.sql(ORACLE_SQL["order_cover"])
    assert sorted(map(tuple, QUERIES["order_cover"](spark, sf).select(*want.columns).collect())) == sorted(want.fetchall()) != []


def test_cover_sql_takes_the_first_smallest(duck):
    """A path of four, a triangle and a star, in place of the broken claims."""
    pairs = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (10, 12), (20, 23), (21, 23), (22, 23)]
    sql = ORACLE_SQL["order_cover"].replace(ORACLE_SQL["order_broken"], "SELECT * FROM (VALUES " + ", ".join(map(str, pairs)) + ") p(u, v)")
    want = [v for g in ([p for p in pairs if p[0] // 10 == d] for d in range(3)) for v in repair.vertex_cover(g)[0]]
    assert sorted(n for n, _ in duck.sql(sql).fetchall()) == sorted(want)
