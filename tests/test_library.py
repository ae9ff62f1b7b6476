"""What no query reaches: configuration, profiles on disk, obligations as queries, and the streaming twins."""

import pytest
from pyspark.sql import functions as F

from gapwright.plans import certificate, cuts, fixpoint
from gapwright.sources import config
from gapwright.streaming import windows


def test_goal_and_gates():
    assert config.goal({"goal": [{"goal_predicate": "bought", "goal_args": ["u"]}], "horizon_k": 4}) == config.Goal("bought", ("u",), 4)
    with pytest.raises(config.ConfigError):
        config.goal({"goal": []})
    run = {"seed": 1, "run_id": "a", "scenario": "s", "quantile": "95/100", "completeness": (1, 1), "excluded": ()}
    assert config.binding_gates(run, run | {"seed": 2, "run_id": "b"}) == []
    assert config.binding_gates(run, run) == ["same_seed", "same_run"]
    assert config.binding_gates(run | {"completeness": (1, 2)}, run | {"seed": 2, "run_id": "b", "scenario": "x", "quantile": "9/10", "excluded": (1,)}) == ["scenario", "quantile", "degraded", "excluded"]


def test_profiles_on_disk(spark, tmp_path):
    rows = [("b", "day", 200, 1 << 40, 1, 1 << 50, 3 << 39), ("a", None, 3, 5, 1, 9, None)]
    df = spark.createDataFrame(rows, "source string, regime string, n_gaps long, order_statistic long, min_gap long, max_gap long, threshold long")
    path = str(tmp_path / "profile.jsonl")
    made = config.write_profile(path, df)
    assert made == config.write_profile(path, df.orderBy("source")) and sorted(map(tuple, config.read_profile(spark, path).collect()), key=str) == sorted(rows, key=str)
    whole = open(path, "rb").read()
    for bad in (whole.replace(b'"200"', b'"201"'), whole.replace(b'":"', b'": "', 1), b"x", whole.replace(b"profile:", b"profile:0")):
        open(path, "wb").write(bad)
        with pytest.raises(config.ConfigError):
            config.read_profile(spark, path)


def test_obligations_as_queries(spark):
    instances = spark.createDataFrame([("i1", "h", ["a", "b"], [4], ["l1"]), ("i2", "g", ["h"], [], []), ("i3", "z", ["q"], [], ["l2"])], "instance_id string, head string, body array<string>, blockers array<long>, license_ids array<string>")
    inside = lambda *ids: spark.createDataFrame([(x,) for x in ids], "fact_id string")
    heads = lambda facts, mask: sorted(r.head for r in certificate.closure_violations(instances, inside(*facts), mask).collect())
    assert heads(("a", "b"), 0) == ["h"] and heads(("a", "b"), 4) == [] and heads(("a", "b", "h"), 0) == ["g"] and heads(("a", "b", "h", "g"), 0) == []
    licences = spark.createDataFrame([("l1",)], "license_id string")
    assert [r.license_id for r in certificate.licence_violations(instances, licences).collect()] == ["l2"]
    assert sorted(r.instance_id for r in certificate.voided(instances, licences).collect()) == ["i2", "i3"]
    assert cuts.delta({"a": 1}, {"a": 2, "b": 1}) == ["a", "b"]


def test_program_views(spark):
    roles = spark.createDataFrame([(1, "to", "y"), (1, "by", "x")], "event_id long, role string, entity_id string")
    events = fixpoint.axiom_args(roles, spark.createDataFrame([(1, "move", 5), (2, "rest", 6)], "event_id long, predicate string, tick long"))
    facts = fixpoint.seed(events)
    assert sorted((r.predicate, r.args) for r in facts.collect()) == [("move", ["x", "y"]), ("rest", [])]
    assert fixpoint.goal_facts(facts, "move", ["y"]).count() == 1 and fixpoint.goal_facts(facts, "move", ["y", "q"]).count() == 0
    program = fixpoint.Program(facts, spark.createDataFrame([("i", "r", "h", "p", ["x"], 1, ["f1", "f2"], [], "LICENSED", [], ["l"], True, 1, 2)], fixpoint.INSTANCES), 1)
    assert sorted(r.fact_id for r in program.adjacency().collect()) == ["f1", "f2"]
    assert program.counts().collect()[0].asDict() == {"observed_instances": 0, "silent_instances": 1, "ghosts": 1, "observed_events": 0}
    assert [(r.part, r.id) for r in program.document().collect()][-1] == ("instance", "i")


def test_sessions_and_bursts(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    hourly = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").count()
    want = {(r.w.start, r.event_type, r["count"]) for r in hourly.where("count >= 8").collect()}
    got = {(r.t0, r.event_type, r.n) for r in windows.collect_stream(spark, windows.bursts(stream(), "1 day", 8), "test_bursts", "append").collect()}
    last = max(w for w, _, _ in want)
    assert got <= want and {x for x in want if x[0] < last} <= got
    runs = events.where("user_id IS NOT NULL").groupBy(F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "user_id").count()
    want = {(r.w.start, r.user_id, r["count"]) for r in runs.collect()}
    got = {(r.t0, r.user_id, r.n) for r in windows.collect_stream(spark, windows.sessions(stream().where("user_id IS NOT NULL"), "6 hours"), "test_sessions").collect()}
    assert got <= want and len(got) > 0.9 * len(want)
