"""Registered queries over the events as states, as paths, as late arrivals and under skewed clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import automaton, envelopes, late, paths
from ..operators.series import with_neighbours
from ..session import written
from ..sources.events import telemetry
from .queries import DAY0, E, HOUR, query

# --- continuity of a user's access --------------------------------------------------------------------------------

#: The states of a credential's life and what moves them.
LIFE = automaton.Machine(
    ["NONE", "ISSUED", "ACTIVE", "DORMANT", "DIVERGED", "EXPIRED", "TERMINATED"],
    {
        ("NONE", "issue"): "ISSUED", ("EXPIRED", "issue"): "ISSUED", ("TERMINATED", "issue"): "ISSUED",
        ("ISSUED", "use"): "ACTIVE", ("DORMANT", "use"): "ACTIVE",
        ("ACTIVE", "idle"): "DORMANT", ("ACTIVE", "mismatch"): "DIVERGED",
        ("ACTIVE", "revoke"): "TERMINATED", ("DORMANT", "revoke"): "TERMINATED", ("DIVERGED", "revoke"): "TERMINATED",
        ("ISSUED", "expiry"): "EXPIRED", ("ACTIVE", "expiry"): "TERMINATED", ("DORMANT", "expiry"): "TERMINATED", ("DIVERGED", "expiry"): "TERMINATED",
    },
)
IDLE, EXPIRY = 12 * HOUR, 48 * HOUR
SYMBOL = "CASE WHEN source = 'signup' THEN 'issue' WHEN source IN ('view', 'click', 'purchase') THEN 'use' WHEN k % 10 = 0 THEN 'revoke' WHEN k % 10 < 4 THEN 'mismatch' END"
PAUSE = f"CASE WHEN {{gap}} > {EXPIRY} THEN 'expiry' WHEN {{gap}} > {IDLE} THEN 'idle' END"
MOVE_ROWS = ", ".join(f"('{s}', '{x}', '{to}')" for (s, x), to in sorted(LIFE.moves.items()))
CONTINUITY = f"""WITH RECURSIVE moves AS (SELECT * FROM (VALUES {MOVE_ROWS}) m(s, x, nxt)),
 e AS (SELECT event_id, user_id, row_number() OVER w AS n, {SYMBOL} AS x, {PAUSE.format(gap='t - lag(t) OVER w')} AS p FROM ({E}) WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 r AS (SELECT e.event_id, e.user_id, e.n, 'NONE' AS before, coalesce((SELECT nxt FROM moves WHERE s = 'NONE' AND moves.x = e.x), 'NONE') AS after FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.n, r.after, coalesce(b.nxt, a.nxt, r.after) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1 LEFT JOIN moves a ON a.s = r.after AND a.x = e.p LEFT JOIN moves b ON b.s = coalesce(a.nxt, r.after) AND b.x = e.x)"""


def continuity_of(spark, sf, width: int = automaton.WIDTH) -> DataFrame:
    """Every event of a user with the state before and after it: a long pause acts before the event itself."""
    e = telemetry(spark, sf).where("user_id IS NOT NULL").select("event_id", "user_id", "t", "source", "k")
    e = with_neighbours(e, ["user_id"], ["t", "event_id"], ["t"])
    f = automaton.then(LIFE.function(F.expr(PAUSE.format(gap="t - prev_t"))), LIFE.function(F.expr(SYMBOL)))
    return automaton.run(e, LIFE, ["user_id"], ["t", "event_id"], f, "NONE", width)


@query("continuity", f"{CONTINUITY} SELECT event_id, user_id, before AS state_before, after AS state_after FROM r")
def continuity(spark, sf):
    return continuity_of(spark, sf).select("event_id", "user_id", "state_before", "state_after")


@query("continuity_moves", f"{CONTINUITY} SELECT before AS state_before, after AS state_after, count(*) AS n, count(DISTINCT user_id) AS n_users FROM r WHERE before <> after GROUP BY ALL")
def continuity_moves(spark, sf):
    """Changes of state over all users."""
    moved = continuity_of(spark, sf).where("state_before <> state_after")
    return moved.groupBy("state_before", "state_after").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


# --- paths through users and items --------------------------------------------------------------------------------

UNTIL, STEPS, BEST = DAY0 + 7 * 24 * HOUR, 4, 3
OUT = "source IN ('signup', 'view', 'click')"
EDGES = f"SELECT CASE WHEN {OUT} THEN 'u' || user_id ELSE 'k' || k END AS src, CASE WHEN {OUT} THEN 'k' || k ELSE 'u' || user_id END AS dst, t FROM ({E}) WHERE user_id IS NOT NULL AND t <= {UNTIL}"
SEEDS = f"SELECT 'u' || user_id AS seed, 'u' || user_id AS node, min(t) AS t FROM ({E}) WHERE source = 'signup' AND t < {DAY0 + 2 * HOUR} GROUP BY user_id"


def path_sql() -> str:
    parts = [f"WITH ed AS ({EDGES}), l0 AS (SELECT seed, node, 0 AS steps, t AS arrival FROM ({SEEDS}))"]
    for n in range(1, STEPS + 1):
        known = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(n))
        parts.append(f"g{n} AS (SELECT seed, dst AS node, {n} AS steps, min(t) AS arrival FROM l{n - 1} JOIN ed ON src = node AND t > arrival GROUP BY seed, dst)")
        parts.append(f"l{n} AS (SELECT * FROM g{n} g WHERE NOT EXISTS (SELECT 1 FROM ({known}) p WHERE p.seed = g.seed AND p.node = g.node AND p.arrival <= g.arrival))")
    return ", ".join(parts) + ", front AS (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(STEPS + 1)) + ")"


def graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Edges from users to items that they look at, and from items to users who buy or fail there; seeds: accounts opened in
    the first two hours, from then on."""
    e = telemetry(spark, sf).where(F.col("user_id").isNotNull() & (F.col("t") <= UNTIL))
    user, item, out = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("k"), F.col("k").cast("string")), F.expr(OUT)
    edges = e.select(F.when(out, user).otherwise(item).alias("src"), F.when(out, item).otherwise(user).alias("dst"), "t")
    opened = e.where((F.col("source") == "signup") & (F.col("t") < DAY0 + 2 * HOUR))
    return edges, opened.groupBy(user.alias("seed")).agg(F.min("t").alias("t")).select("seed", F.col("seed").alias("node"), "t")


def is_item(node: Column) -> Column:
    """Whether a node is an item: those are few, so paths are told by the items on them."""
    return node.startswith("k")


@query("time_paths", f"{path_sql()} SELECT seed, node, steps, arrival FROM front")
def time_paths(spark, sf):
    """What the seeds reach within a week in four steps of rising times: the fewest steps, and more where they are sooner."""
    return paths.fronts(*graph(spark, sf), STEPS, is_item)


@query("blast_radius", f"{path_sql()} SELECT seed, steps, kind, count(*) AS n FROM (SELECT seed, node, CASE WHEN left(node, 1) = 'u' THEN 'user' ELSE 'item' END AS kind, min(steps) AS steps FROM front GROUP BY seed, node) WHERE steps > 0 GROUP BY ALL")
def blast_radius(spark, sf):
    counts = paths.fronts(*graph(spark, sf), STEPS, is_item, counted=True)
    return counts.withColumn("kind", F.when(F.col("kind") == "hub", "item").otherwise("user"))


@query("best_paths", f"""WITH ed AS (SELECT src, dst, min(t) AS t, count(*) AS c FROM ({EDGES}) GROUP BY src, dst), sd AS ({SEEDS}),
 p1 AS (SELECT seed, dst AS node, ed.t, c AS evidence, [node, dst] AS path, 1 AS steps FROM sd JOIN ed ON src = node AND ed.t > sd.t),
 p2 AS (SELECT seed, dst AS node, ed.t, evidence + c AS evidence, list_append(path, dst) AS path, 2 AS steps FROM p1 JOIN ed ON src = node AND ed.t > p1.t),
 p3 AS (SELECT seed, dst AS node, ed.t, evidence + c AS evidence, list_append(path, dst) AS path, 3 AS steps FROM p2 JOIN ed ON src = node AND ed.t > p2.t),
 o AS (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY steps, evidence DESC, path) AS place FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3))
 SELECT seed, node, CAST(place AS INTEGER) AS place, steps, evidence, array_to_string(path, '>') AS path FROM o WHERE place <= {BEST}""")
def best_paths(spark, sf):
    """The three best paths of at most three steps from each seed to each node, over first meetings of user and item."""
    edges, seeds = graph(spark, sf)
    pairs = written(edges.groupBy("src", "dst").agg(F.min("t").alias("t"), F.count("*").alias("evidence")))
    return paths.best_by_hubs(pairs, seeds, BEST, is_item).withColumn("path", F.array_join("path", ">"))


# --- late arrivals ------------------------------------------------------------------------------------------------

LATENESS, PANE = 2 * HOUR, 6 * HOUR
DELAY = f"CASE WHEN event_id % 13 = 5 THEN {3 * HOUR} WHEN event_id % 97 = 7 THEN {30 * HOUR} ELSE 0 END"
ARRIVED = f"SELECT *, (t + {DELAY}) // {HOUR} AS epoch FROM ({E})"
MARKS = f"SELECT epoch, max(m) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {LATENESS} AS watermark FROM (SELECT epoch, max(t) AS m FROM ({ARRIVED}) GROUP BY epoch)"
GENERATIONS = f"""WITH a AS ({ARRIVED}), m AS ({MARKS}), w AS (SELECT DISTINCT source, t // {PANE} * {PANE} AS t0 FROM a),
 c AS (SELECT w.*, (SELECT min(epoch) FROM m WHERE watermark >= t0 + {PANE}) AS closed FROM w),
 j AS (SELECT c.source, c.t0, c.closed, a.epoch FROM c JOIN a ON a.source = c.source AND a.t // {PANE} * {PANE} = c.t0),
 f AS (SELECT source, t0, closed AS epoch, 0 AS late, count_if(closed IS NULL OR epoch < closed) AS n FROM j GROUP BY source, t0, closed
  UNION ALL SELECT source, t0, epoch, 1, count(*) FROM j WHERE epoch >= closed GROUP BY source, t0, epoch)
 SELECT source, t0, CAST(row_number() OVER w - 1 AS INTEGER) AS generation, epoch, CAST(sum(n) OVER (PARTITION BY source, t0 ORDER BY late, epoch ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM f WINDOW w AS (PARTITION BY source, t0 ORDER BY late, epoch)"""


def arrived(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Events with the hour in which they arrive, some of them late, and the watermarks of the hours."""
    e = telemetry(spark, sf).withColumn("epoch", F.expr(f"(t + {DELAY}) div {HOUR}"))
    return e, written(late.watermarks(e, LATENESS))


@query("late_records", f"SELECT event_id, a.epoch, watermark, CASE WHEN t < watermark - {LATENESS} THEN 'QUARANTINED' ELSE 'REOPENED' END AS standing FROM ({ARRIVED}) a JOIN ({MARKS}) m ON m.epoch = a.epoch WHERE t < watermark")
def late_records(spark, sf):
    """Records behind the watermark, with the bound that they broke."""
    e, marks = arrived(spark, sf)
    return late.judged(e, marks, LATENESS).where(F.col("standing") != late.ON_TIME).select("event_id", "epoch", "watermark", "standing")


@query("late_generations", GENERATIONS)
def late_generations(spark, sf):
    """Counts of six hours when their windows close, and after every hour that corrects them."""
    e, marks = arrived(spark, sf)
    return late.generations(e, marks, ["source"], PANE)


@query("late_corrected", f"SELECT source, t // {PANE} * {PANE} AS t0, count(*) AS n FROM ({E}) GROUP BY ALL")
def late_corrected(spark, sf):
    """The last generation of each window: what a count over all records gives."""
    e, marks = arrived(spark, sf)
    return late.generations(e, marks, ["source"], PANE).groupBy("source", "t0").agg(F.max_by("n", "generation").alias("n"))


# --- skewed clocks ------------------------------------------------------------------------------------------------

MINUTE = HOUR // 60
SKEWS = {"signup": (-5 * MINUTE, 10 * MINUTE), "purchase": (-30 * MINUTE, 0), "view": (0, 20 * MINUTE), "error": (-HOUR, HOUR)}
LO = "t + CASE source " + " ".join(f"WHEN '{s}' THEN {lo}" for s, (lo, _) in SKEWS.items()) + " ELSE 0 END"
HI = "t + CASE source " + " ".join(f"WHEN '{s}' THEN {hi}" for s, (_, hi) in SKEWS.items()) + " ELSE 0 END"
SPANNED = f"SELECT *, {LO} AS lo, {HI} AS hi FROM ({E}) WHERE user_id IS NOT NULL"


def spanned(spark, sf) -> DataFrame:
    return envelopes.enveloped(telemetry(spark, sf).where("user_id IS NOT NULL").select("event_id", "source", "user_id", "t"), SKEWS)


@query("envelope_sequence", f"SELECT l.event_id AS l_event_id, r.event_id AS r_event_id, r.lo > l.hi AND r.hi <= l.lo + {24 * HOUR} AS certain FROM ({SPANNED}) l JOIN ({SPANNED}) r ON l.user_id = r.user_id AND l.source = 'signup' AND r.source = 'purchase' AND r.hi > l.lo AND r.lo <= l.hi + {24 * HOUR}")
def envelope_sequence(spark, sf):
    """Signup, then purchase within a day, under skewed clocks: surely, or perhaps."""
    e = spanned(spark, sf)
    return envelopes.sequence(e.where("source = 'signup'"), e.where("source = 'purchase'"), ["user_id"], 24 * HOUR, envelopes.most(SKEWS)).select("l_event_id", "r_event_id", "certain")


SURE = f"SELECT p.event_id, max(v.hi < p.lo AND v.lo >= p.hi - {24 * HOUR}) AS sure FROM ({SPANNED}) p JOIN ({SPANNED}) v ON v.user_id = p.user_id AND v.source = 'view' AND v.lo < p.hi AND v.hi >= p.lo - {24 * HOUR} WHERE p.source = 'purchase' GROUP BY p.event_id"


@query("envelope_absence", f"SELECT p.event_id, CASE WHEN sure IS NULL THEN 'CERTAIN' WHEN sure THEN 'NEVER' ELSE 'POSSIBLE' END AS absent FROM ({SPANNED}) p LEFT JOIN ({SURE}) s USING (event_id) WHERE source = 'purchase'")
def envelope_absence(spark, sf):
    """Purchases without a view in the day before, under skewed clocks."""
    e = spanned(spark, sf)
    return envelopes.absence(e.where("source = 'purchase'"), e.where("source = 'view'"), ["user_id"], 24 * HOUR, envelopes.most(SKEWS)).select("event_id", "absent")


@query("envelope_distinct", f"""SELECT event_id, count_if(sure) AS n_certain, count(*) AS n_possible FROM (SELECT l.event_id, r.source, max(r.event_id = l.event_id OR (r.hi <= l.lo AND r.lo >= l.hi - {6 * HOUR})) AS sure
 FROM ({SPANNED}) l JOIN ({SPANNED}) r ON l.user_id = r.user_id AND (r.event_id = l.event_id OR (r.lo <= l.hi AND r.hi >= l.lo - {6 * HOUR})) GROUP BY l.event_id, r.source) GROUP BY event_id""")
def envelope_distinct(spark, sf):
    """Kinds of events in the six hours up to each event of a user: surely, and at most."""
    return envelopes.distinct(spanned(spark, sf), ["user_id"], "source", 6 * HOUR, envelopes.most(SKEWS)).select("event_id", "n_certain", "n_possible")
