"""Operators of disputes, regimes, encodings, flags, bundles and caps, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from gapwright.functions import encoding, repair
from gapwright.operators import degrade, liveness, series, temporal
from gapwright.plans import fixpoint, flags
from gapwright.plans.queries import CONTROLS
from gapwright.plans.rules import compile_table
from gapwright.session import shared_dir
from gapwright.sources import generate, ingest


def test_as_of_against_brute_force(spark):
    rng = random.Random("as of")
    rows = sorted({(rng.choice("ab"), rng.randrange(-60, 60)) for _ in range(30)})
    points = [(i, rng.choice("abc"), rng.randrange(-80, 80)) for i in range(60)]
    r = spark.createDataFrame([(k, t, t * 10) for k, t in rows], "key string, t long, v long")
    p = spark.createDataFrame(points, "id long, key string, t long")
    for ahead in (False, True):
        for strict in (False, True):
            got = {x.id: (x.as_of_t, x.as_of_v) for x in series.as_of(p, r, ["key"], "t", ["v"], width=7, ahead=ahead, strict=strict).collect()}
            for i, key, t in points:
                fits = [x for k, x in rows if k == key and ((x > t or (x == t and not strict)) if ahead else (x < t or (x == t and not strict)))]
                want = (min if ahead else max)(fits) if fits else None
                assert got[i] == (want, None if want is None else want * 10)


def test_corrections_against_brute_force(spark):
    rng = random.Random("corrections")
    rows = [(s, i, 10 * i + rng.choice([0, 0, 0, rng.randrange(-60, 60)])) for s in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "source string, seq long, t long")
    got = {(r.source, r.seq) for r in temporal.corrections(df).collect()}
    for s in "ab":
        times = [t for k, _, t in rows if k == s]
        assert len([x for x in got if x[0] == s]) == len(repair.corrections(times))
        left = [t for k, i, t in rows if k == s and (s, i) not in got]
        assert left == sorted(left)
    knots = {(r.source, r.seq): r.knot for r in temporal.disorder(df, width=8).collect()}
    for s in "ab":
        times, knot = [t for k, _, t in rows if k == s], 0
        for i in range(60):
            assert knots[s, i] == knot
            knot += i == 59 or max(times[: i + 1]) <= min(times[i + 1 :])
    assert temporal.corrections(df.where("seq < 0")).count() == 0


def test_regime_pieces(spark):
    events = spark.createDataFrame([("a", t, k) for k, t in enumerate((10, 20, 32, 90))], "source string, t long, seq long")
    profile = spark.createDataFrame([("a", "x", 15, False), ("a", "y", None, False)], "source string, regime string, threshold long, overflow boolean")
    got = sorted((r.t0, r.t1, r.reason) for r in liveness.regime_timeline(events, profile, [("x", 0, 25), ("y", 25, 60)], 0, 100).collect())
    assert got == [(0, 10, "B_UNBRACKETED"), (10, 25, "L_CALIBRATED_OK"), (25, 60, "B_PROFILE_INSUFFICIENT"), (60, 100, "B_REGIME_UNKNOWN")]
    declared = sorted((r.t0, r.t1, r.reason) for r in liveness.regime_timeline(events, profile, [("x", 0, 25), ("y", 25, 60)], 0, 100, declared={"a": 12}).collect())
    assert declared == [(0, 10, "B_UNBRACKETED"), (10, 32, "L_CALIBRATED_OK"), (32, 60, "B_GAP_EXCEEDS_THRESHOLD"), (60, 100, "B_REGIME_UNKNOWN")]


def test_encodings(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, (1 << 56) - 1, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for r in df.select("v", encoding.leb128(F.col("v")).alias("l"), encoding.from_leb128(encoding.leb128(F.col("v"))).alias("back"), encoding.big_endian(F.col("v")).alias("b")).collect():
        n, out = r.v, bytearray()
        while True:
            out.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                break
        assert bytes(r.l) == bytes(out) and r.back == r.v and bytes(r.b) == r.v.to_bytes(8, "big")
    signed = spark.createDataFrame([(v,) for v in (-(1 << 63), -5, -1, 0, 7, (1 << 63) - 1)], "v long")
    rows = signed.select("v", encoding.ordered(F.col("v")).alias("o"), encoding.from_big_endian(encoding.big_endian(F.col("v"))).alias("back")).collect()
    assert [r.v for r in sorted(rows, key=lambda r: bytes(r.o))] == sorted(r.v for r in rows) and all(r.v == r.back for r in rows)


def test_flags():
    assert flags.names(flags.mask(["grounding_capped", "greedy_cover"])) == ["grounding_capped", "greedy_cover"]
    assert sum(1 << bit for bit, against in flags.FLAGS.values() if against) == 0b100111011
    flags.check("ROBUST", flags.mask(["greedy_cover"]), False, False, "CARDINALITY", True)
    flags.check("INDETERMINATE", flags.mask(["er_ambiguous"]), False, True, "SUBSET", False)
    for bad in (("ROBUST", 1, False, False, "SUBSET", False), ("ROBUST", 0, False, True, "SUBSET", False), ("UNSAFE", 0, False, True, "SUBSET", False), ("OPTIMISTIC_ONLY", 1, False, True, "SUBSET", False), ("INDETERMINATE", 0, False, True, "SUBSET", False), ("ROBUST", 4, False, False, "CARDINALITY", False), ("ROBUST", 1 << 9, False, False, "SUBSET", False), ("FINE", 0, False, False, "SUBSET", False), ("UNSAFE", 2, True, True, "SUBSET", True)):
        with pytest.raises(flags.IllegalVerdict):
            flags.check(*bad)


def test_bundles(spark, tmp_path):
    lines = [b'{"attrs":{"user":"u"},"event_type":"a","seq":%d,"source_id":"s","t_evt_ns":"%d"}' % (k, 1000 + k) for k in range(5)] + [b"broken"]
    path = tmp_path / "raw.jsonl"
    path.write_bytes(b"\n".join(lines) + b"\n")
    accepted, quarantine = ingest.ingest(spark, ingest.read_lines(spark, str(path)), [ingest.Source("s")])
    assert accepted.count() == 5 and [r.detail for r in quarantine.collect()] == ["not_json"]
    (tmp_path / "cut.jsonl").write_bytes(b"\n".join(lines))
    with pytest.raises(ValueError, match="no line feed"):
        ingest.read_lines(spark, str(tmp_path / "cut.jsonl"))
    rows = sorted(((r.source_id, r.seq, bytes(r.raw)) for r in ingest.write_bundle(accepted).collect()))
    read = lambda raws: ingest.read_bundle(spark.createDataFrame(list(enumerate(raws)), "line_no long, raw binary"))
    raws = [x for _, _, x in rows]
    back = read(raws)
    assert sorted(map(tuple, back.select("source_id", "seq", "record_id").collect())) == sorted(map(tuple, accepted.select("source_id", "seq", "record_id").collect()))
    for bad, why in (([raws[1], raws[0]], "order"), ([raws[0], raws[0]], "order"), ([raws[0].replace(b":", b": ", 1)], "reserialise_differs"), ([raws[0].replace(b'"u"', b'"v"')], "record_id"), ([b"{}"], "members"), ([b"x"], "not_json")):
        with pytest.raises(ValueError, match=why):
            read(bad)
    with pytest.raises(ValueError, match="the limit is 2"):
        ingest.ingest(spark, ingest.read_lines(spark, str(path)), [ingest.Source("s")], ingest.Limits(records=2))


def test_caps(spark):
    step = {"id": "r", "kind": "detect", "head": "next(user, t1)", "body": ["step(user, t0)", "step(user, t1)"], "temporal": {"op": "seq", "left": "a", "right": "b", "within": "10s"}, "evidence": ["b"], "producing_sources": ["step"], "silent_possible": True, "silent_bind_kinds": {"user": "user"}}
    rules = compile_table([step], CONTROLS, {"step"})
    seeds = fixpoint.seed(spark.createDataFrame([(i, "step", [u], 4 * i) for i in range(6) for u in "xy"], "event_id long, predicate string, args array<string>, tick long"))
    free = fixpoint.saturate(seeds, rules)
    assert not free.capped and free.instances.count() == 18
    capped = fixpoint.saturate(seeds, rules, caps=fixpoint.Caps(instances=5))
    assert capped.capped and capped.caps == ("instances",)
    ticks = spark.createDataFrame([("step", 0, 100, "BLIND", "x")], "source string, t0 long, t1 long, verdict string, reason string")
    pools = spark.createDataFrame([("user", u) for u in "xyz"], "kind string, entity_id string")
    whole = fixpoint.envelope(free, rules, ticks, pools)
    few = fixpoint.envelope(free, rules, ticks, pools, caps=fixpoint.Caps(bindings=2))
    hidden = lambda p: sorted(r.args[0] for r in p.instances.where("observed = 'LICENSED' and not ghost").collect())
    assert not whole.caps and {"x", "y", "z"} <= set(hidden(whole))
    assert few.caps == ("bindings",) and "z" not in hidden(few) and fixpoint.missing_from(free, few).isEmpty()


def test_draws_are_uniform_and_exact(spark):
    n = 3 * (1 << 58)  # a quarter of all draws is rejected
    rows = [r.d for r in spark.range(300).select(generate.draw_below(7, "d", n, F.col("id")).alias("d")).collect()]
    assert all(0 <= d < n for d in rows) and len(set(rows)) == 300
    assert abs(sum(d < n // 2 for d in rows) - 150) < 45


def test_nested_deletions(spark):
    raw = spark.createDataFrame([("a", k, k * 400, "e") for k in range(100)], "source string, seq long, t long, event_type string")
    rows = degrade.levels(raw, [degrade.Completeness(n, 10) for n in (10, 8, 3)], 7, 1)
    sizes = {r.level: r["count"] for r in rows.groupBy("level").count().collect()}
    assert sizes == {100: 100, 80: 80, 30: 30}
    assert degrade.outside_of(rows.where("level = 30"), rows.where("level = 80")).isEmpty() and degrade.outside_of(rows.where("level = 80"), rows.where("level = 30")).count() == 50
    with pytest.raises(ValueError):
        degrade.backdate(raw, "a", "e", 100, 5)
    assert degrade.backdate(raw, "a", "e", -2, -9).where("seq = 98").collect()[0].t == 98 * 400 - 9


def test_a_whole_run(spark, sf):
    from gapwright.plans import audit

    folder = shared_dir(spark)
    told = audit.run_cell(spark, sf, folder, degrade.Completeness(1, 2))
    assert told["sealed"] + told["deleted"] == 1000 and told["verdict"] in ("ROBUST", "OPTIMISTIC_ONLY", "UNSAFE")
    assert spark.read.parquet(f"{folder}/licences").count() == told["licences"] and spark.read.parquet(f"{folder}/certificate").count() == 1
