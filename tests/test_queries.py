"""Queries of the core against their DuckDB SQL, and operators that SQL can't express."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gapwright.functions import canon
from gapwright.operators import degrade, liveness, series, temporal
from gapwright.plans import antichain, audit, cuts, fixpoint, queries, reach  # noqa: F401  (audit adds its queries)
from gapwright.plans.queries import CONTROLS, ORACLE_SQL, QUERIES
from gapwright.plans.rules import compile_table
from gapwright.session import written
from gapwright.sources import config, generate, ingest, sinks
from gapwright.sources.events import EventStore, telemetry
from gapwright.streaming import windows

CHEAP = ["source_stats", "gaps", "window_scan", "event_lookup", "gap_profile", "liveness_islands", "absence_status", "seq_join", "absence_join", "distinct_window", "entity_resolve", "resolve_counts", "degrade_delete", "chain_forge", "strip_identity", "degrade_manifest", "order_violations", "missing_sequence", "fixpoint_pmin"]


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_hidden_steps_of_every_user(spark, sf, duck):
    rows = QUERIES["fixpoint_pmax_users"](spark, sf).collect()
    want = duck.sql(ORACLE_SQL["fixpoint_pmax_users"]).fetchall()
    assert sorted((r.predicate, r.entity, r.tick) for r in rows) == sorted(want)
    named = {str(u) for (u,) in duck.sql("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL").fetchall()}
    hidden = {(u, k) for p, u, k in want if p == "escalated"} - {(u, k) for p, u, k in duck.sql(ORACLE_SQL["fixpoint_pmin"]).fetchall() if p == "escalated"}
    assert {u for u, _ in hidden} == named and len(named) > 8


@pytest.mark.parametrize("name", ["fixpoint_pmin_observed", "fixpoint_pmax_observed", "instance_counts_observed"])
def test_observed_absences(spark, sf, duck, name):
    rows = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(map(repr, map(tuple, rows.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
    assert set(want.fetchall()) != set(duck.sql(ORACLE_SQL[name.replace("pmax_observed", "pmax_users").replace("_observed", "")]).fetchall())


def test_absence_gate(spark):
    rule = {"id": "r", "kind": "detect", "head": "alone(user, t)", "body": ["error(user, t)"], "temporal": {"op": "absence", "of": "view(user, tv)", "before": "a", "within": "10s"}, "producing_sources": ["error"]}
    table = compile_table([rule], CONTROLS, {"error", "view"})
    seeds = fixpoint.seed(spark.createDataFrame([(i, p, ["u"], t) for i, (p, t) in enumerate([("error", 20), ("error", 45), ("error", 70), ("error", 95), ("view", 65)])], "event_id long, predicate string, args array<string>, tick long"))
    ticks = spark.createDataFrame([("error", 0, 40, "LIVE", "x"), ("error", 40, 80, "BLIND", "y")], "source string, t0 long, t1 long, verdict string, reason string")
    heads = lambda absence: sorted(r.tick for r in fixpoint.saturate(seeds, table, absence=absence).facts.where("predicate = 'alone'").collect())
    assert heads(None) == [20, 45, 95] and heads(fixpoint.absence_by(ticks)) == [20]


CUT_PROGRAMS = {"": queries.all_absences, "_events": queries.programs, "_dark": lambda spark, sf: queries.all_absences(spark, sf, queries.dark(spark, sf))}


def rows_of(df, columns):
    return sorted(map(repr, map(tuple, df.select(*columns).collect())))


@pytest.mark.parametrize("suffix", list(CUT_PROGRAMS))
def test_cuts_of_events(spark, sf, duck, suffix):
    """The cut queries over one pair of programs, each against its SQL, and the corridor search against the antichains."""
    both = CUT_PROGRAMS[suffix](spark, sf)
    clauses = queries.clauses(both)
    found = written(queries.severed_cuts(spark, clauses))
    made = {
        "reach_under_cuts": found, "min_cuts": queries.best_cuts(found).select("side", "cut_id", "n_controls"), "raised_levels": queries.levels_of(queries.best_cuts(found)),
        "premium": queries.premium_of(spark, clauses), "verdict": queries.verdict_of(spark, clauses), "cut_choices": queries.choices_of(spark, clauses), "cut_probe": queries.probe(found),
    }
    for name, rows in made.items():
        want = duck.sql(ORACLE_SQL[name + suffix])
        assert rows_of(rows, want.columns) == sorted(map(repr, want.fetchall())), name
    assert found.where("severed").count() not in (0, found.count())
    verdicts = {r.side: r.verdict for r in made["verdict"].collect()}
    assert verdicts["none"] == "UNSAFE"
    for side, program in zip(("min", "max"), both):
        learnt = cuts.learn(*queries.on_driver(program), CONTROLS)
        assert learnt.cut == antichain.psi_of(clauses[side], CONTROLS).cut and set(learnt.clauses) <= set(clauses[side])
    if suffix == "_dark":
        assert verdicts == {"none": "UNSAFE", "min": "OPTIMISTIC_ONLY", "max": "ROBUST"}
        assert [r.control for r in made["premium"].collect()] == ["retry_limit"]


def random_program(rng, n_facts=12, n_instances=30, bits=5):
    names = [f"f{i}" for i in range(n_facts)]
    given = names[:3]
    rows = []
    for i in range(n_instances):
        body = rng.sample(names, rng.randint(0 if i % 9 == 0 else 1, 3))
        rows.append((f"i{i}", rng.choice(names[3:]), body + body[:1], [1 << b for b in rng.sample(range(bits), rng.randint(0, 2))]))
    return names, given, rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_antichains_against_closures(spark, seed):
    """Cyclic programs with repeated body facts and empty bodies: what the antichains say under every cut is what a closure
    under that cut says, and no set of a fact includes another."""
    import random

    names, given, rows = random_program(random.Random(seed))
    instances = spark.createDataFrame(rows, "instance_id string, head string, body array<string>, blockers array<long>")
    facts = spark.createDataFrame([(g,) for g in given], "fact_id string")
    held = {r.fact_id: r.masks for r in antichain.corridors(facts, instances).collect()}
    program = [reach.Instance(i, h, tuple(b), tuple(m)) for i, h, b, m in rows]
    for mask in range(32):
        assert {f for f, masks in held.items() if any(not m & mask for m in masks)} == set(reach.closure(set(given), program, mask))
    for masks in held.values():
        assert not any(a != b and a & b == a for a in masks for b in masks)
    cut_rows = spark.createDataFrame([(str(m), m) for m in (0, 5, 31)], "cut_id string, mask long")
    got = {(r.cut_id, r.fact_id) for r in antichain.reached(spark.createDataFrame([(f, m) for f, m in held.items()], "fact_id string, masks array<long>"), cut_rows).collect()}
    assert got == {(str(m), f) for m in (0, 5, 31) for f in reach.closure(set(given), program, m)}


def test_index_refuses(spark):
    make = lambda rows: spark.createDataFrame(rows, "instance_id string, head string, body array<string>, blockers array<long>")
    facts, good = spark.createDataFrame([("a",), ("b",)], "fact_id string"), ("i", "b", ["a"], [4])
    antichain.checked(make([good]), facts.where("fact_id = 'b'"), facts)
    for rows in ([("i", "b", ["a"], [3])], [("i", "b", ["a"], [0])], [good, good], [("i", None, ["a"], [])], [("i", "b", ["c"], [])]):
        with pytest.raises(ValueError):
            antichain.checked(make(rows), None, facts)
    with pytest.raises(ValueError):
        antichain.checked(make([good]), spark.createDataFrame([("z",)], "fact_id string"), facts)


def test_unblockable_goals():
    assert antichain.psi_of((0,), CONTROLS).unblockable and antichain.psi_of((0,), CONTROLS).cut is None
    assert antichain.psi_of((), CONTROLS).cut == {} and antichain.severs((), 0) and not antichain.severs((8,), 4)


def test_overlap_join(spark):
    import random

    rng = random.Random(7)
    spans = lambda n: [(i, rng.choice("xy"), a, a + rng.choice([0, 1, 3, 40, 900])) for i, a in enumerate(rng.randint(-500, 500) for _ in range(n))]
    left, right = spans(120), spans(150)
    one = spark.createDataFrame(left, "i long, k string, a0 long, a1 long")
    two = spark.createDataFrame(right, "j long, k string, b0 long, b1 long")
    want = sorted((i, j) for i, k, a, b in left for j, m, c, d in right if k == m and a < d and c < b and a < b and c < d)
    for width in (None, 1, 7, 5000):
        met = temporal.overlap_join(one, two, ("a0", "a1"), ("b0", "b1"), ["k"], width)
        assert sorted((r.i, r.j) for r in met.select("i", "j").collect()) == want


@pytest.mark.parametrize("name", ["encodings", "align_join", "gap_digest", "order_constraints", "order_knots", "absence_proxy", "degrade_duplicate"])
def test_audit_against_sql(spark, sf, duck, name):
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, sf).select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_obligations_in_the_envelope(spark):
    owed = {"id": "o1", "kind": "obligation", "head": "approved(user, t)", "body": ["error(user, t)"], "temporal": {"op": "obligation", "within": "10s"}, "blocked_when": "ctl.payment_check >= card", "producing_sources": ["iam"]}
    then = {"id": "r1", "kind": "detect", "head": "taken(user, t1)", "body": ["approved(user, t0)", "purchase(user, t1)"], "evidence": ["b"], "producing_sources": ["purchase"]}
    table = compile_table([owed, then], CONTROLS, {"error", "purchase", "approved"})
    events = [("error", "dark", 50), ("error", "live", 20), ("error", "partly", 44), ("error", "met", 60), ("approved", "met", 60), ("error", "start", 0)] + [("purchase", u, 90) for u in ("dark", "live", "partly", "start")]
    seeds = fixpoint.seed(spark.createDataFrame([(i, p, [u], t) for i, (p, u, t) in enumerate(events)], "event_id long, predicate string, args array<string>, tick long"))
    ticks = spark.createDataFrame([("iam", 0, 40, "LIVE", "x"), ("iam", 40, 100, "BLIND", "y")], "source string, t0 long, t1 long, verdict string, reason string")
    low = fixpoint.saturate(seeds, table)
    high = fixpoint.envelope(low, table, ticks, spark.createDataFrame([], "kind string, entity_id string"))
    grown = high.facts.join(low.facts, "fact_id", "left_anti").collect()
    assert sorted((r.predicate, r.args[0], r.tick) for r in grown) == [("approved", "dark", 50), ("taken", "dark", 90)]
    (ghost,) = high.instances.where("ghost").collect()
    assert ghost.rule_id == "o1" and len(ghost.body) == len(ghost.license_ids) == len(ghost.blockers) == 1 and ghost.observed == "LICENSED"
    assert fixpoint.missing_from(low, high).isEmpty()
    with pytest.raises(ValueError):
        fixpoint.saturate(seeds, [replace(table[0], kind="other")])
    with pytest.raises(ValueError):
        spread = compile_table([owed, then | {"body": ["approved(user, t0)"], "head": "taken(user, t0)", "evidence": ["a"], "causal_relation": "PROPAGATES"}], CONTROLS, {"error", "approved"})
        made = spark.createDataFrame([("i", "r1", "h", "taken", ["dark"], 50, [r.fact_id for r in grown if r.predicate == "approved"], [], "LICENSED", [], [], False, None, None)], fixpoint.INSTANCES)
        fixpoint.envelope(fixpoint.Program(seeds, made, 0), spread, ticks, spark.createDataFrame([], "kind string, entity_id string"))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_store_refuses(spark, sf):
    e = telemetry(spark, sf)
    with pytest.raises(ValueError):
        EventStore.load(e.union(e.limit(1)))
    with pytest.raises(ValueError):
        EventStore(e).window("view", 5, 5)


def test_neighbours_across_empty_buckets(spark):
    times = [-250, -101, -100, 0, 1, 1, 950, 2000]
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)] + [("b", 7, 0)], "source string, t long, event_id long")
    for ahead in (False, True):
        rows = sorted(series.with_neighbours(df, ["source"], ["t", "event_id"], ["t"], width=100, ahead=ahead, number="n").where("source = 'a'").collect(), key=lambda r: r.event_id)
        shifted = times[1:] + [None] if ahead else [None] + times[:-1]
        assert [r["next_t" if ahead else "prev_t"] for r in rows] == shifted and [r.n for r in rows] == list(range(8))
    parts = spark.createDataFrame([("a", 0, 5, "x"), ("a", 5, 9, "x"), ("a", 9, 12, "y"), ("a", 20, 30, "y"), ("a", 30, 31, "x")], "source string, t0 long, t1 long, v string")
    got = sorted((r.t0, r.t1, r.v, r.parts) for r in series.islands(parts, ["source"], "t0", "t1", ["v"], width=4).collect())
    assert got == [(0, 9, "x", 2), (9, 12, "y", 1), (20, 30, "y", 1), (30, 31, "x", 1)]


def test_rank_statistic(spark):
    values = [((i * 37) % 101) for i in range(240)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 4)], "source string, gap long")
    for p, q in ((95, 100), (1, 2), (1, 100)):
        got = {r.source: r for r in liveness.rank_statistic(df, ["source"], "gap", p, q).collect()}
        assert got["a"].order_statistic == sorted(values)[max(1, -(-len(values) * p // q)) - 1] and got["b"].order_statistic == 4


def test_degrade_refusals_and_nesting(spark):
    raw = spark.createDataFrame([("s", i, i * 700, "view") for i in range(40)], "source string, seq long, t long, event_type string")
    sizes, last = [], None
    for num in (10, 8, 5, 0):
        kept = {r.seq for r in degrade.delete(raw, degrade.Completeness(num, 10), 3, 1).collect()}
        assert last is None or kept <= last
        sizes.append(len(kept))
        last = kept
    assert sizes == [40, 32, 20, 0]
    for bad in (lambda: degrade.blackout(raw, ["s"], 5, 5), lambda: degrade.backdate(raw, "s", "none", 0, -1), lambda: degrade.forge(raw, "s", 39, 1, "view"), lambda: degrade.forge(raw, "s", 3, 900, "view"), lambda: degrade.Completeness(3, 2)):
        with pytest.raises(ValueError):
            bad()


def test_sequence_join_edges(spark):
    lo = spark.createDataFrame([(1, "u", 100)], "event_id long, user string, t long")
    hi = spark.createDataFrame([(i, "u", t) for i, t in enumerate((99, 100, 101, 110, 111))], "event_id long, user string, t long")
    assert sorted(r.r_t for r in temporal.sequence_join(lo, hi, ["user"], 10).collect()) == [101, 110]
    assert temporal.sequence_join(lo, hi, ["user"], 0).count() == 0


SOURCES = [ingest.Source("iam", "CHAINED", ("login", "logout")), ingest.Source("net")]


def record(**change):
    base = {"attrs": {"user": "p"}, "event_type": "login", "seq": 0, "source_id": "iam", "t_evt_ns": "5"}
    return canon.dumps(base | change).encode()


def test_ingest(spark):
    good = [record(seq=i, t_evt_ns=str(10 + i)) for i in range(5)]
    bad = {b"": "empty_line", b"\xff": "invalid_utf8", b"{": "not_json", b"[]": "not_object", b'{"a":1}': "member_set", record(source_id="who"): "source_undeclared", record(event_type="other"): "event_type_undeclared", record(t_evt_ns="05"): "t_evt_ns_form", record(attrs={"User": "x"}): "attr_key_form", b" " + record(seq=9): "reserialise_differs", record(seq=8).replace(b'"seq":8', b'"seq":8,"seq":8'): "duplicate_key", record(seq=8).replace(b'"seq":8', b'"seq":8.0'): "float_literal"}
    lines = [*good, good[1], record(seq=20, t_evt_ns="1"), record(seq=20, t_evt_ns="2"), *bad]
    frame = spark.createDataFrame(list(enumerate(lines)), "line_no long, raw binary")
    accepted, quarantine = ingest.ingest(spark, frame, SOURCES)
    assert sorted(r.seq for r in accepted.collect()) == [0, 1, 2, 3, 4]
    details = {r.line_no: r.detail for r in quarantine.collect()}
    assert len(details) + 5 == len(lines) and details[5] == "identical_line" and details[6] == details[7] == "seq_collision"
    assert [details[8 + k] for k in range(len(bad))] == list(bad.values())
    with pytest.raises(ingest.LabelImpurity):
        ingest.ingest(spark, spark.createDataFrame([(0, record(attrs={"label": "x"}))], "line_no long, raw binary"), SOURCES)
    sealed = ingest.seal(accepted)
    assert ingest.verify_chain(sealed).count() == 0
    forged = sealed.withColumn("record_id", F.when(F.col("seq") == 2, "x").otherwise(F.col("record_id")))
    assert [r.seq for r in ingest.verify_chain(forged).collect()] == [2]
    assert {r.seq for r in ingest.verify_chain(sealed.where("seq <> 2")).collect()} == {3}


SCENARIO = {
    "horizon": 7200, "source": [{"source_id": "iam", "integrity_class": "CHAINED"}, {"source_id": "net", "integrity_class": "NONE"}],
    "phase": [{"regime": "a", "t0": 0, "t1": 3600}, {"regime": "b", "t0": 3600, "t1": 7200}], "entity": [{"kind": "user", "name": f"u{i}"} for i in range(3)],
    "noise": [{"source": "net", "event_type": "flow", "every": "30s", "kind": "user", "role": "user"}], "step": [{"source": "iam", "event_type": "login", "t": 4000, "attrs": {"user": "u1"}}],
}


def test_generator_and_config(spark, tmp_path):
    made = config.scenario(SCENARIO)
    raw, truth = generate.generate(spark, made, 7)
    rows = sorted(map(str, raw.collect()))
    assert rows == sorted(map(str, generate.generate(spark, made, 7)[0].repartition(7).collect())) and rows != sorted(map(str, generate.generate(spark, made, 8)[0].collect()))
    assert len(rows) == 241 and [r.seq for r in raw.where("source = 'net'").orderBy("seq").collect()] == list(range(240))
    assert truth.where("origin = 'step'").count() == 1 and set(made.frames(spark)) == {"sources", "phases", "entities", "excluded", "blind"}
    for change in ({"horizon": 1}, {"phase": SCENARIO["phase"][:1]}, {"source": SCENARIO["source"][:1]}):
        with pytest.raises(config.ConfigError):
            config.scenario(SCENARIO | change)
    with pytest.raises(config.ConfigError):
        config.liveness({"quantile": "0.95", "slack_num": 3, "slack_den": 2, "k_tail": 5, "n_floor": 30, "m_min": 2})
    assert config.liveness({"quantile": "95/100", "slack_num": 3, "slack_den": 2, "k_tail": 5, "n_floor": 30, "m_min": 2}).n_min == 100
    c = config.controls({"control": [{"id": "x", "levels": ["a", "b", "c"]}]})
    grown = config.controls({"control": [{"id": "a", "levels": ["a", "b"]}, {"id": "x", "levels": ["a", "b", "c"]}]}, config.read_lock(config.render_lock(c)))
    assert grown.bit("x", 2) == c.bit("x", 2) and grown.bit("a", 1) == 2
    path = str(tmp_path / "out.jsonl")
    assert sinks.write_jsonl(raw.drop("attrs"), ["source", "seq"], path) == 241
    assert [json.loads(x)["source"] for x in open(path)][:2] == ["iam", "net"]


def test_streams_agree_with_batches(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    got = {tuple(r) for r in windows.collect_stream(spark, windows.sliding(stream, "6 hours"), "w6").collect()}
    want = {tuple(r) for r in windows.sliding(events, "6 hours").collect()}
    assert got <= want and len(got) > 0.9 * len(want)
    pairs = windows.collect_stream(spark, windows.sequence(stream.where("event_type = 'signup'"), stream.where("event_type = 'purchase'"), 86400), "pairs").count()
    assert pairs == windows.sequence(events.where("event_type = 'signup'"), events.where("event_type = 'purchase'"), 86400).count()
