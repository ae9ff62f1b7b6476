"""Steps that larger tables showed to be wrong or too large, on tables small enough for a test."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gapwright.operators import temporal
from gapwright.plans import audit, fixpoint, masks, queries  # noqa: F401  (audit adds its queries)
from gapwright.plans.queries import ORACLE_SQL, QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_disorder_has_no_frame_up_to_the_end(spark):
    """Such a frame is gone over anew for every row; running frames in falling order say the same."""
    rng = random.Random(5)
    times = [i * 10 - (rng.choice([0, 0, 0, 35])) for i in range(60)]
    got = temporal.disorder(spark.createDataFrame([("a", i, t) for i, t in enumerate(times)], "source string, seq long, t long"), width=7)
    assert "unboundedfollowing" not in plan_of(got)
    knot, want = 0, []
    for i in range(len(times)):
        want.append(knot)
        knot += all(max(times[: i + 1]) <= t for t in times[i + 1 :])
    assert [r.knot for r in got.orderBy("seq").collect()] == want


def events_at(folder, rows) -> str:
    """A folder with a table of events (source, user, second of the first day)."""
    import duckdb

    con = duckdb.connect()
    values = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL {s} SECOND, {u}, '{source}', 1.0, '{{\"k\": 1}}')" for i, (source, u, s) in enumerate(rows))
    con.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM (VALUES {values}) v(event_id, ts, user_id, event_type, value, props)) TO '{folder}/events.parquet'")
    return str(folder)


def against_sql(spark, folder, name) -> list:
    """Rows of a query and of its SQL over one folder: equal, and given back."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = sorted(map(repr, map(tuple, QUERIES[name](spark, folder).select(*want.columns).collect())))
    assert got == sorted(map(repr, want.fetchall())), name
    return got


def test_rules_without_instances_are_counted(spark, tmp_path):
    folder = events_at(tmp_path, [("signup", 1, 10), ("view", 1, 20), ("purchase", 1, 30), ("click", 1, 40)])
    for name in ("instance_counts", "instance_counts_observed"):
        assert against_sql(spark, folder, name)[3:] == ["('r4', 0)", "('r5', 0)"]


def test_purchases_before_the_first_signup(spark, tmp_path):
    """Their hour begins before the timeline: no part of it is LIVE."""
    folder = events_at(tmp_path, [("purchase", 7, 2)] + [("signup", 1, 30 + i) for i in range(120)] + [("purchase", 2, 90)])
    rows = against_sql(spark, folder, "obligation_ghosts")
    assert [r.endswith("True)") for r in rows] == [True, False]


def small_table(folder) -> str:
    """Users with observed steps, with steps that dark windows may hide, with both at the start of a window, and neither."""
    rng, rows = random.Random(11), []
    for u in range(1, 9):
        at = 0
        while at < 80_000:
            at += rng.choice([40, 300, 900, 4000])
            rows.append((rng.choice(["error", "error", "purchase", "view", "signup"] if u % 2 else ["error", "purchase"]), u, at))
    return events_at(folder, rows)


def test_masks_against_instances(spark, tmp_path):
    """Facts and blocker sets without instances are those of the programs with them, silent steps included."""
    folder = small_table(tmp_path)
    for one, two in zip(queries.all_absences(spark, folder), queries.masked_all(spark, folder)):
        held = queries.derived(one).withColumn("fact_id", fixpoint.fact_id(F.col("predicate"), F.array("entity"), F.col("tick"))).join(queries.held_corridors(one), "fact_id")
        want = sorted((r.predicate, r.entity, r.tick, r.masks) for r in held.collect())
        assert sorted((r.predicate, r.args[0], r.tick, r.masks) for r in two.derived(masks=True).collect()) == want


def test_cited_licences_and_containment(spark, tmp_path):
    folder = small_table(tmp_path)
    for name in ("premium_licences", "containment"):
        against_sql(spark, folder, name)


def test_silent_steps_are_not_multiplied(spark, tmp_path):
    """A cut query writes no row for a window and a user that no purchase meets."""
    folder = small_table(tmp_path)
    low, high = queries.masked_all(spark, folder)
    assert high.silent["escalated"][0].windows.count() > 1 and high.facts["escalated"].count() == low.facts["escalated"].count()
    assert high.facts["bought"].count() <= spark.read.parquet(f"{folder}/events.parquet").where("event_type = 'purchase'").count() * 2


def test_corridors_text_is_constant(spark, tmp_path):
    """Only purchases have several blocker sets; the text of the others is no work of every row."""
    plan = plan_of(QUERIES["corridors"](spark, small_table(tmp_path)))
    assert plan.count("array_join") == 1


def test_silent_steps_are_dealt_out(spark, tmp_path, monkeypatch):
    """The product of windows and entities is cut into tasks by its rows, and its rows repeat each other in a file."""
    monkeypatch.setattr(masks, "TASK_ROWS", 50_000, raising=False)
    pools = spark.createDataFrame([("user", f"u{i}") for i in range(300)] + [("item", f"i{i}") for i in range(3)], "kind string, entity_id string").coalesce(1)
    rng = random.Random(2)
    windows = spark.createDataFrame([(i * 600 + rng.randrange(300), i * 600 + 400) for i in range(1100)], "lo long, hi long").coalesce(1)
    made = masks.product(masks.Silent(windows, ("user",), 64), pools)
    made.write.parquet(f"{tmp_path}/made")
    tasks = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 330_000 and max(tasks) <= 100_000
    assert sum(f.stat().st_size for f in (tmp_path / "made").glob("*.parquet")) < 330_000 / 2
    want = pools.where("kind = 'user'").crossJoin(windows).select(F.array("entity_id").alias("args"), F.col("lo").alias("tick"), F.lit(64).cast("long").alias("mask"))
    assert made.exceptAll(want).isEmpty() and want.exceptAll(made).isEmpty()
    two = masks.product(masks.Silent(windows.limit(5), ("user", "item"), 0), pools)
    assert two.distinct().count() == two.count() == 300 * 3 * 5


def dark_table(folder) -> str:
    """300 users, and an error log with some 90 windows of silence."""
    rng, at, rows = random.Random(3), 0, []
    for _ in range(3000):
        at += 600 if rng.random() < 0.03 else rng.randrange(5, 12)
        rows.append(("error", rng.randrange(300), at))
    return events_at(folder, rows + [("view", u, 50 + u) for u in range(300)])


@pytest.mark.parametrize("name", ["fixpoint_pmax_users", "fixpoint_pmax", "fixpoint_pmax_observed"])
def test_lists_of_facts_are_dealt_out(spark, tmp_path, monkeypatch, name):
    """Hidden steps of all users are as many tasks as they need, and equal to the SQL's."""
    monkeypatch.setattr(masks, "TASK_ROWS", 4000, raising=False)
    folder = dark_table(tmp_path)
    assert len(against_sql(spark, folder, name)) > 20_000
    tasks = QUERIES[name](spark, folder).groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most")).collect()
    assert tasks[0].most <= 10_000


def test_masks_refuse(spark):
    rules = queries.table_of_rules()
    with pytest.raises(ValueError):
        masks.refuse([replace(rules[0], kind="other")], frozenset(queries.AXIOMS))
    with pytest.raises(ValueError):
        masks.refuse(rules, frozenset(queries.AXIOMS | {"bought"}))
    with pytest.raises(ValueError):
        masks.refuse(rules, frozenset(queries.AXIOMS - {"error"}))


def test_wire_lines_read_events_once(spark, sf):
    """Spoilt, repeated and colliding lines are made in one pass over the numbered events (with its table of edges)."""
    from gapwright.plans.queries import wire_lines

    plan = wire_lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.split("== Initial Plan ==")[-1].count("FileScan parquet") <= 2


def test_ascii_is_text_if_printable():
    import unicodedata

    from gapwright.functions import canon

    for c in map(chr, range(0x250)):
        assert canon.is_text(f"a{c}") == (unicodedata.is_normalized("NFC", f"a{c}") and unicodedata.category(c) != "Cc")
    with pytest.raises(canon.CanonError, match="not_json"):
        canon.loads("\ufeff{}")
