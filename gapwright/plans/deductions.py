"""Registered queries over the events that decide what belongs together and what can't be: entities by evidence, order
constraints and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, ordering
from ..session import table, written
from ..sources.events import sequenced, telemetry
from .queries import E, HOUR, ORACLE_SQL, S, query

# --- entities by evidence -----------------------------------------------------------------------------------------

HELD = 3 * HOUR
#: Accounts of this segment are shared, so they are links and no anchors.
SHARED = "HOUSEHOLD"
FOREVER = 2**62
BINDINGS = f"""SELECT event_id AS obs, 'ACCOUNT' AS kind, CAST(user_id AS VARCHAR) AS norm, CASE WHEN c_mktsegment IS NULL OR c_mktsegment = '{SHARED}' THEN 'LINK' ELSE 'ANCHOR' END AS class, {-FOREVER} AS t_lo, {FOREVER} AS t_hi, false AS provisional
  FROM ({E}) LEFT JOIN customer ON c_custkey = user_id WHERE source IN ('signup', 'purchase') AND user_id IS NOT NULL
 UNION ALL SELECT event_id, 'DEVICE', CAST(k AS VARCHAR), 'LINK', t, t + {HELD}, source = 'error' FROM ({E}) WHERE k IS NOT NULL
 UNION ALL SELECT event_id, 'ADDRESS', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 'LINK', t, t + {HELD}, false FROM ({E}) WHERE value IS NOT NULL"""


def layer_sql(n: int, roots: str, links: str) -> str:
    """Tables m{n} (obs, root, joined) and f{n} (obs, root after refusals, doubt) of a layer."""
    return f"""l{n} AS (SELECT DISTINCT x.root AS a, y.root AS b FROM ({links}) JOIN {roots} x ON x.obs = a JOIN {roots} y ON y.obs = b WHERE x.root <> y.root),
 c{n} AS (SELECT node, min(root) AS joined FROM (SELECT * FROM r{n}) GROUP BY node),
 m{n} AS (SELECT obs, root, coalesce(joined, root) AS joined FROM {roots} LEFT JOIN c{n} ON node = root),
 x{n} AS (SELECT joined FROM m{n} JOIN b USING (obs) WHERE kind = 'ACCOUNT' GROUP BY joined HAVING min(norm) <> max(norm)),
 f{n} AS (SELECT obs, CASE WHEN joined IN (SELECT joined FROM x{n}) THEN root ELSE joined END AS root, joined IN (SELECT joined FROM x{n}) AND count(DISTINCT root) OVER (PARTITION BY joined) > 1 AS doubt FROM m{n})"""


def closure_sql(n: int) -> str:
    return f"r{n}(node, root) AS (SELECT a, a FROM l{n} UNION SELECT b, b FROM l{n} UNION SELECT l.b, r.root FROM r{n} r JOIN (SELECT a, b FROM l{n} UNION SELECT b, a FROM l{n}) l ON l.a = r.node AND r.root < l.b)"


SAME = "greatest(x.t_lo, y.t_lo) < least(x.t_hi, y.t_hi)"
ANCHORED = f"SELECT x.obs AS a, y.obs AS b FROM b x JOIN b y USING (kind, norm) WHERE x.class = 'ANCHOR' AND y.class = 'ANCHOR' AND {SAME}"
AGREED = f"SELECT x.obs AS a, y.obs AS b FROM p x JOIN p y USING (kind, norm, kind2, norm2) WHERE {SAME}"
FIRM = " AND NOT x.provisional AND NOT y.provisional"
ENTITIES = f"""WITH RECURSIVE b AS ({BINDINGS}), p AS (SELECT x.obs, x.kind, x.norm, y.kind AS kind2, y.norm AS norm2, greatest(x.t_lo, y.t_lo) AS t_lo, least(x.t_hi, y.t_hi) AS t_hi, x.provisional OR y.provisional AS provisional
  FROM b x JOIN b y ON x.obs = y.obs AND x.kind < y.kind WHERE x.class = 'LINK' AND y.class = 'LINK'),
 f0 AS (SELECT DISTINCT obs, obs AS root FROM b), {', '.join(part for n, roots, links in ((1, 'f0', ANCHORED + FIRM), (2, 'f1', AGREED + FIRM), (3, 'f2', f'{ANCHORED} UNION ALL {AGREED}')) for part in (layer_sql(n, roots, links).replace(f' c{n} AS', f' {closure_sql(n)}, c{n} AS', 1),))},
 doubts AS (SELECT obs FROM f1 WHERE doubt UNION SELECT obs FROM f2 WHERE doubt UNION SELECT obs FROM f2 JOIN c3 ON node = root),
 named AS (SELECT obs FROM b WHERE class = 'ANCHOR' AND NOT provisional UNION SELECT a FROM ({AGREED + FIRM}) WHERE a <> b)
 SELECT obs, root AS entity, CASE WHEN bool_or(obs IN (SELECT obs FROM doubts)) OVER w THEN 'AMBIGUOUS' WHEN bool_or(obs IN (SELECT obs FROM named)) OVER w THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status FROM f2 WINDOW w AS (PARTITION BY root)"""


def bindings(spark, sf) -> DataFrame:
    """What every event names: its account (an anchor, unless a household shares it), its device and its address for three
    hours. What the error log says of devices is provisional."""
    e, columns = telemetry(spark, sf), ["obs", "kind", "norm", "class", "t_lo", "t_hi", "provisional"]
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    firm = F.col("c_mktsegment") != SHARED
    parts = [
        (e.where("source IN ('signup', 'purchase') AND user_id IS NOT NULL").join(known, "user_id", "left"), "ACCOUNT", F.col("user_id"), F.when(firm, evidence.ANCHOR).otherwise(evidence.LINK), None, F.lit(False)),
        (e.where("k IS NOT NULL"), "DEVICE", F.col("k"), F.lit(evidence.LINK), "t", F.col("source") == "error"),
        (e.where("value IS NOT NULL"), "ADDRESS", F.floor("value"), F.lit(evidence.LINK), "t", F.lit(False)),
    ]
    out = None
    for rows, kind, norm, grade, at, provisional in parts:
        span = (F.col(at), F.col(at) + HELD) if at else (F.lit(None).cast("long"), F.lit(None).cast("long"))
        part = rows.select(F.col("event_id").alias("obs"), F.lit(kind).alias("kind"), norm.cast("string").alias("norm"), grade.alias("class"), span[0].alias("t_lo"), span[1].alias("t_hi"), provisional.alias("provisional")).toDF(*columns)
        out = part if out is None else out.unionByName(part)
    return out


@query("evidence_entities", ENTITIES)
def evidence_entities(spark, sf):
    """Every event's entity and standing: merges by anchors, then by device and address (or a shared account) together."""
    return evidence.resolve(bindings(spark, sf), ["ACCOUNT"])


# --- order constraints --------------------------------------------------------------------------------------------

#: Planted: one record of 53 has its clock set back by three hours, and of claims over at most an hour one in five is claimed in reverse too.
#: Clocks are known to 45 minutes, those of errors to two hours.
SET_BACK = f"SELECT event_id, source, seq, CASE WHEN event_id % 53 = 7 THEN t - {3 * HOUR} ELSE t END AS t FROM ({S})"
CLOCK = HOUR // 4 * 3
WITHIN = 24 * HOUR
LEFT_RIGHT = f"SELECT l.event_id AS l, r.event_id AS r, r.t - l.t AS gap FROM ({E}) l JOIN ({E}) r ON l.user_id = r.user_id AND l.source = 'signup' AND r.source = 'purchase' AND r.t > l.t AND r.t <= l.t + {WITHIN}"
PAIRS = f"SELECT l AS u, r AS v, {WITHIN} AS w FROM ({LEFT_RIGHT}) UNION SELECT r, l, -1 FROM ({LEFT_RIGHT}) UNION SELECT l, r, -1 FROM ({LEFT_RIGHT}) WHERE l % 5 = 3 AND gap <= {HOUR}"
#: Fixed value: layers of the SQL below, more than the rounds that any scale factor needs.
LAYERS = 6


def conflicts_sql() -> str:
    judge = "CASE WHEN better THEN CASE WHEN list_contains(nw.p, node) THEN 'CYCLE' WHEN nw.d < lo THEN 'PINNED' ELSE 'FITS' END ELSE state END AS state, CASE WHEN better THEN {{d: nw.d, n: nw.n + 1, p: list_append(nw.p, node)}} ELSE lab END AS lab"
    judge = judge.replace("{{", "{").replace("}}", "}")
    low = f"SELECT node, source, seq, lo, {judge} FROM (SELECT *, coalesce(state = 'FITS' AND nw.d < lab.d, false) AS better FROM (%s))"
    over = "min(CASE WHEN state = 'FITS' THEN lab END) OVER (PARTITION BY source ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nw"
    parts = [
        f"ev AS (SELECT event_id AS node, source, seq, t - h AS lo, t + h AS hi FROM (SELECT *, CASE WHEN source = 'error' THEN {2 * HOUR} ELSE {CLOCK} END AS h FROM ({SET_BACK})))",
        f"pr AS (SELECT u, v, min(w) AS w FROM ({PAIRS}) GROUP BY u, v)",
        "st AS (SELECT node, source, seq, lo, 'FITS' AS state, {d: hi, n: 1, p: [node]} AS lab FROM ev)",
        f"fi AS ({low % f'SELECT *, {over} FROM st'})",
        "h0 AS (SELECT * FROM fi WHERE node IN (SELECT u FROM pr UNION SELECT v FROM pr))",
    ]
    for i in range(LAYERS):
        offers = f"SELECT v, min({{d: lab.d + w, n: lab.n, p: lab.p}}) AS nw FROM pr JOIN h{i} ON node = u WHERE state = 'FITS' GROUP BY v"
        parts.append(f"x{i} AS ({low % f'SELECT h.*, nw FROM h{i} h LEFT JOIN ({offers}) o ON v = node'})")
        parts.append(f"h{i + 1} AS ({low % f'SELECT *, {over} FROM x{i}'})")
    rest = "SELECT * FROM (SELECT *, " + over.replace("state = 'FITS'", "knot AND state = 'FITS'") + f" FROM (SELECT *, true AS knot FROM h{LAYERS} UNION ALL SELECT *, false FROM fi WHERE node NOT IN (SELECT node FROM h0))) WHERE NOT knot"
    parts.append(f"rs AS ({low % rest})")
    return "WITH " + ", ".join(f"{p.split(' AS ', 1)[0]} AS MATERIALIZED {p.split(' AS ', 1)[1]}" for p in parts) + f" SELECT node AS event_id, state, lab.d AS bound, lo, array_to_string(lab.p, '>') AS path FROM (SELECT * FROM h{LAYERS} UNION ALL SELECT * FROM rs) WHERE state <> 'FITS'"


def set_back(spark, sf) -> DataFrame:
    """(node, source, seq, t) with the planted clocks."""
    return sequenced(telemetry(spark, sf)).select(F.col("event_id").alias("node"), "source", "seq", F.when(F.col("event_id") % 53 == 7, F.col("t") - 3 * HOUR).otherwise(F.col("t")).alias("t"))


def claimed(spark, sf) -> DataFrame:
    """(u, v, w) of all claims that a signup came before a user's purchase, within a day, and of those planted."""
    e, span = telemetry(spark, sf).where("user_id IS NOT NULL"), F.expr(f"t div {WITHIN}")
    left = e.where("source = 'signup'").select(F.col("event_id").alias("left"), "user_id", F.col("t").alias("\0t"), F.explode(F.array(span, span + 1)).alias("day"))
    right = e.where("source = 'purchase'").select(F.col("event_id").alias("right"), "user_id", "t", span.alias("day"))
    met = left.join(right, ["user_id", "day"]).withColumn("gap", F.col("t") - F.col("\0t")).where(f"gap > 0 AND gap <= {WITHIN}")
    reverse = met.where(f"left % 5 = 3 AND gap <= {HOUR}").select(F.col("left").alias("u"), F.col("right").alias("v"), F.lit(-1).cast("long").alias("w"))
    return ordering.rule_pairs(met.select("left", "right"), WITHIN).unionByName(reverse)


@query("order_conflicts", conflicts_sql())
def order_conflicts(spark, sf):
    """Records whose clocks, numbers and rules can't all be right, each with a path of constraints that shows it."""
    clock = F.when(F.col("source") == "error", 2 * HOUR).otherwise(CLOCK)
    nodes = written(set_back(spark, sf).select("node", "source", "seq", (F.col("t") - clock).alias("lo"), (F.col("t") + clock).alias("hi")))
    found = ordering.conflicts(nodes, claimed(spark, sf))
    return found.select(F.col("node").alias("event_id"), "state", "bound", "lo", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


RECORDED = f"SELECT event_id AS node, t FROM ({SET_BACK})"


@query("order_broken", f"SELECT u, v, w, y.t - x.t - w AS excess FROM ({PAIRS}) JOIN ({RECORDED}) x ON x.node = u JOIN ({RECORDED}) y ON y.node = v WHERE y.t - x.t > w")
def order_broken(spark, sf):
    """Claims that the recorded times break, and by how much."""
    return ordering.violated(claimed(spark, sf), set_back(spark, sf))


# Whatever end of each open pair is taken, in all ways: the smallest covers of a component are among those, however they fall.
COVER = f"""WITH RECURSIVE ed AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM ({ORACLE_SQL['order_broken']}) WHERE u <> v),
 sides AS (SELECT a AS x, b AS y FROM ed UNION ALL SELECT b, a FROM ed),
 near AS (SELECT DISTINCT x AS node, x AS other FROM sides UNION SELECT node, y FROM near JOIN sides ON x = other),
 comp AS (SELECT node, min(other) AS c FROM near GROUP BY node),
 num AS (SELECT c, a, b, row_number() OVER (PARTITION BY c ORDER BY a, b) AS n, count(*) OVER (PARTITION BY c) AS m FROM ed JOIN comp ON node = a),
 pick AS (SELECT DISTINCT c, 0 AS n, m, CAST([] AS BIGINT[]) AS held FROM num
  UNION SELECT p.c, q.n, p.m, CASE WHEN list_contains(held, a) OR list_contains(held, b) THEN held ELSE list_sort(list_append(held, x)) END FROM pick p JOIN num q ON q.c = p.c AND q.n = p.n + 1 JOIN sides ON (x = a AND y = b) OR (x = b AND y = a)),
 best AS (SELECT held, row_number() OVER (PARTITION BY c ORDER BY len(held), held) AS place FROM pick WHERE n = m)
 SELECT unnest(held) AS event_id, true AS exact FROM best WHERE place = 1"""


@query("order_cover", COVER)
def order_cover(spark, sf):
    """The fewest records that have to be wrong for the broken claims to hold, the first such set of each component."""
    return ordering.cover(order_broken(spark, sf)).select(F.col("node").alias("event_id"), "exact")
