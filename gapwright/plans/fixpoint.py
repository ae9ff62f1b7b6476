"""Programs: facts and rule instances by semi-naive evaluation, once over what was observed (P_min), and once with the
steps that blind sources may have hidden (P_max).

A round joins the facts of the last round with all facts, once for each slot, keeps instances with new ids, and writes
them: lineage stays one round long. Rounds are as many as the longest derivation.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import fast
from ..operators import liveness
from ..operators.temporal import overlap_join
from ..session import written
from .rules import SLOTS, Pattern, Rule, compile_guard

FACTS = "fact_id string, predicate string, args array<string>, tick long, lo long, hi long, licensed boolean, events array<string>"
INSTANCES = "instance_id string, rule_id string, head string, predicate string, args array<string>, tick long, body array<string>, blockers array<long>, observed string, evidence array<string>, license_ids array<string>, ghost boolean, lo long, hi long"
MAX_ROUNDS = 1000


@dataclass
class Program:
    facts: DataFrame
    instances: DataFrame
    rounds: int
    capped: bool = False
    #: What was capped: rounds, facts, instances or bindings.
    caps: tuple[str, ...] = ()

    def axioms(self) -> DataFrame:
        """Facts that no instance with a body supports."""
        return self.facts.join(self.instances.where(F.size("body") > 0).select(F.col("head").alias("fact_id")).distinct(), "fact_id", "left_anti")

    def adjacency(self) -> DataFrame:
        return self.instances.select("instance_id", "head", F.explode("body").alias("fact_id"))

    def counts(self) -> DataFrame:
        n = self.instances
        return n.agg(F.count_if(F.col("observed") == "OBSERVED").alias("observed_instances"), F.count_if(F.col("observed") == "LICENSED").alias("silent_instances"), F.count_if("ghost").alias("ghosts")).crossJoin(F.broadcast(n.select(F.explode("evidence").alias("e")).agg(F.countDistinct("e").alias("observed_events"))))

    def document(self) -> DataFrame:
        """(part, id, json): the program as JSON rows, facts and instances in order of their ids within the part."""
        rows = lambda df, part, key: df.select(F.lit(part).alias("part"), F.col(key).alias("id"), F.to_json(F.struct(*sorted(df.columns))).alias("json"))
        return rows(self.facts, "fact", "fact_id").unionByName(rows(self.instances, "instance", "instance_id")).sort("part", "id")


def fact_id(predicate, args, tick):
    return fast("fact", predicate, F.array_join(args, "\x1f"), tick)


def seed(events: DataFrame) -> DataFrame:
    """Facts of events (event_id, predicate, args, tick): one for each distinct (predicate, args, tick), with its events."""
    made = events.groupBy("predicate", "args", "tick").agg(F.array_sort(F.collect_set(F.col("event_id").cast("string"))).alias("events"))
    return made.select(fact_id(F.col("predicate"), F.col("args"), F.col("tick")).alias("fact_id"), "predicate", "args", "tick", F.col("tick").alias("lo"), F.col("tick").alias("hi"), F.lit(False).alias("licensed"), "events")


def axiom_args(roles: DataFrame, events: DataFrame) -> DataFrame:
    """Events with args: the entities of (event_id, role, entity_id), by the role's name."""
    sorted_roles = roles.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("role", "entity_id"))), lambda x: x["entity_id"]).alias("args"))
    return events.join(sorted_roles, "event_id", "left").withColumn("args", F.coalesce("args", F.array().cast("array<string>")))


def slot_frame(facts: DataFrame, p: Pattern, slot: str) -> DataFrame:
    """Facts that a pattern matches: its variables as v_name, the rest with the slot's prefix."""
    got = facts.where((F.col("predicate") == p.predicate) & (F.size("args") == len(p.variables)))
    first = {}
    for i, v in enumerate(p.variables):
        if v in first:
            got = got.where(F.get("args", F.lit(i)) == F.get("args", F.lit(first[v])))
        first.setdefault(v, i)
    free = F.col("licensed")
    return got.select(*[F.get("args", F.lit(i)).alias(f"v_{v}") for v, i in first.items()], F.col("fact_id").alias(f"{slot}_id"), F.col("tick").alias(f"{slot}_t"), F.when(free, F.col("lo")).otherwise(F.col("tick")).alias(f"{slot}_lo"), F.when(free, F.col("hi")).otherwise(F.col("tick")).alias(f"{slot}_hi"), free.alias(f"{slot}_free"), F.col("events").alias(f"{slot}_ev"))


def bucketed(column, within: int):
    width = F.lit(max(within, 1)).cast("long")
    return ((column - F.pmod(column, width)) / width).cast("long")


def near(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, within: int) -> DataFrame:
    """Pairs with equal keys and left_t < right_t <= left_t + within, by buckets of time, so that a hot entity is cut."""
    lo = left.withColumn("\0b", F.explode(F.array(bucketed(F.col(left_t), within), bucketed(F.col(left_t), within) + 1)))
    met = lo.join(right.withColumn("\0b", bucketed(F.col(right_t), within)), [*keys, "\0b"]).drop("\0b")
    return met.where((F.col(left_t) < F.col(right_t)) & (F.col(right_t) <= F.col(left_t) + within))


def body_rows(rule: Rule, facts: DataFrame, delta: DataFrame, pivot: int, free: bool = True) -> DataFrame:
    """Rows of facts that the patterns match together. Facts with a tick that a sequence relates meet by bucket of time;
    those with a span, of which there are some only where ``free``, meet all of their entity."""
    rows, bound = None, set()
    t = rule.temporal
    pair = {t["left"], t["right"]} if t and t["op"] == "seq" else set()
    for i, p in enumerate(rule.body):
        slot = SLOTS[i]
        frame = slot_frame(delta if i == pivot else facts, p, slot)
        shared = [f"v_{v}" for v in dict.fromkeys(p.variables) if v in bound]
        other = next((s for s in pair - {slot} if s in SLOTS[:i]), None) if slot in pair else None
        if rows is None:
            rows = frame
        elif other is None or not shared:
            rows = rows.join(frame, shared) if shared else rows.crossJoin(frame)
        else:
            fixed = lambda s: ~F.col(f"{s}_free")
            a, b = rows.where(fixed(other)), frame.where(fixed(slot))
            forward = slot == t["right"]
            one, two, first, second = (a, b, other, slot) if forward else (b, a, slot, other)
            met = near(one, two, shared, f"{first}_t", f"{second}_t", t["within"])
            if free:
                spans = rows.where(F.col(f"{other}_free")).join(frame, shared).unionByName(a.join(frame.where(F.col(f"{slot}_free")), shared))
                met = met.unionByName(spans.select(*met.columns))
            rows = met
        bound |= set(p.variables)
    return rows


def temporal_rows(rule: Rule, rows: DataFrame, facts: DataFrame, absence: Callable | None) -> DataFrame:
    """Rows that satisfy the temporal operator, with ``more``: events that it consumed besides."""
    t, none = rule.temporal, F.array().cast("array<string>")
    if t is None:
        return rows.withColumn("more", none)
    if t["op"] == "seq":
        # Some placement of both within their spans has 0 < right - left <= within; an unknown span rules nothing out.
        lo, hi = t["left"], t["right"]
        first = F.greatest(F.col(f"{hi}_lo") - F.col(f"{lo}_hi"), F.lit(1))
        last = F.least(F.col(f"{hi}_hi") - F.col(f"{lo}_lo"), F.lit(t["within"]))
        unknown = F.col(f"{hi}_lo").isNull() | F.col(f"{lo}_lo").isNull()
        return rows.where(unknown | (first <= last)).withColumn("more", none)
    ids = [f"{s}_id" for s in SLOTS[: len(rule.body)]]
    if t["op"] == "distinct":
        s = t["of"]
        p = rule.body[SLOTS.index(s)]
        frame = slot_frame(facts, p, "x")
        agree = [f"v_{v}" for v in dict.fromkeys(p.variables) if v != t["field"]]
        asked = rows.select(*ids, *agree, F.col(f"{s}_t").alias("anchor"))
        asked = asked.withColumn("b", F.explode(F.array(bucketed(F.col("anchor"), t["within"]), bucketed(F.col("anchor"), t["within"]) - 1)))
        frame = frame.withColumnRenamed(f"v_{t['field']}", "found").withColumn("b", bucketed(F.col("x_t"), t["within"]))
        close = asked.join(frame, [*agree, "b"]).where((F.col("x_t") >= F.col("anchor") - t["within"]) & (F.col("x_t") <= F.col("anchor")))
        enough = close.groupBy(*ids).agg(F.countDistinct("found").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("x_ev")))).alias("more")).where(F.col("n") >= t["n"]).drop("n")
        return rows.join(enough, ids)
    anchor = F.col(f"{t['before']}_t")
    p = t["of"]
    frame = slot_frame(facts, p, "x")
    shared = [v for v in dict.fromkeys(p.variables) if f"v_{v}" in rows.columns]
    # A row asks in the buckets of its window, a fact stands in the bucket of its tick; what is hit goes by its ids.
    frame = frame.select(*[F.col(f"v_{v}").alias(f"x_{v}") for v in shared], "x_t", bucketed(F.col("x_t"), t["within"]).alias("x_b"))
    asked = rows.select(*ids, *[F.col(f"v_{v}") for v in shared], anchor.alias("anchor"))
    asked = asked.withColumn("b", F.explode(F.array(bucketed(F.col("anchor"), t["within"]), bucketed(F.col("anchor"), t["within"]) - 1)))
    hit = (F.col("b") == F.col("x_b")) & (F.col("x_t") >= F.col("anchor") - t["within"]) & (F.col("x_t") < F.col("anchor"))
    for v in shared:
        hit = hit & (F.col(f"v_{v}") == F.col(f"x_{v}"))
    hit_ids = asked.join(frame, hit, "left_semi").select(*ids).distinct()
    kept = rows.join(hit_ids, ids, "left_anti").withColumn("more", none)
    if absence is None:
        return kept
    windows = kept.select(*ids, (anchor - t["within"]).alias("w0"), anchor.alias("w1")).withColumn("window_id", F.concat_ws("|", *ids))
    status = absence(windows.select("window_id", "w0", "w1").distinct(), rule.sources)
    seen = windows.join(status.where("status = 'OBSERVED'").select("window_id"), "window_id").select(*ids)
    return kept.join(seen, ids)


def derive(rule: Rule, facts: DataFrame, delta: DataFrame, pivot: int, absence: Callable | None, free: bool = True) -> DataFrame:
    """Instances of a detect rule with the pivot slot's fact from delta."""
    n = len(rule.body)
    rows = body_rows(rule, facts, delta, pivot, free)
    spanned = F.lit(False)
    for s in SLOTS[:n]:
        spanned = spanned | F.col(f"{s}_free")
    ref = lambda slot, name: F.col(f"{slot}_t") if name == "t" else F.col(f"v_{name}")
    rows = temporal_rows(rule, rows.where(spanned | compile_guard(rule.when, ref)), facts, absence)
    evidence = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(f"{s}_ev", F.array().cast("array<string>")) for s in rule.evidence], "more")))
    when = {p.time: s for s, p in zip(SLOTS, rule.body)}[rule.head.time]
    args = F.array(*[F.col(f"v_{v}") for v in rule.head.variables]) if rule.head.variables else F.array().cast("array<string>")
    body = F.array(*[F.col(f"{s}_id") for s in SLOTS[:n]])
    made = rows.select(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.head.predicate).alias("predicate"), args.alias("args"), F.col(f"{when}_t").alias("tick"), body.alias("body"), evidence.alias("evidence")).where(F.size("evidence") > 0)
    head = fact_id(F.col("predicate"), F.col("args"), F.col("tick"))
    made = made.withColumn("head", head)
    return finished(made, rule, "OBSERVED", F.array().cast("array<string>"), F.lit(False), F.col("tick"), F.col("tick"))


def finished(made: DataFrame, rule: Rule, observed: str, license_ids, ghost, lo, hi, blocked: bool = True) -> DataFrame:
    masks = F.array(*[F.lit(b if b < 1 << 63 else b - (1 << 64)).cast("long") for b in rule.blockers]) if rule.blockers and blocked else F.array().cast("array<long>")
    out = made.withColumns({"blockers": masks, "observed": F.lit(observed), "license_ids": license_ids, "ghost": ghost, "lo": lo.cast("long"), "hi": hi.cast("long")})
    out = out.withColumn("instance_id", fast("instance", F.col("rule_id"), F.col("head"), F.array_join("body", "\x1f"), F.array_join("evidence", "\x1f"), F.array_join("license_ids", "\x1f")))
    return out.select(*[c.split(" ")[0] for c in INSTANCES.split(", ")])


def merged_facts(facts: DataFrame, instances: DataFrame, fresh: bool = False) -> DataFrame:
    """Facts and heads of instances. A fact is licensed while no observed instance and no event supports it; its span is
    the hull over its licensed instances. ``fresh`` adds a column: the fact isn't in ``facts``."""
    silent = F.col("observed") == "LICENSED"
    heads = instances.select(F.col("head").alias("fact_id"), "predicate", "args", "tick", F.when(silent, F.col("lo")).alias("lo"), F.when(silent, F.col("hi")).alias("hi"), silent.alias("licensed"), F.array().cast("array<string>").alias("events"), F.lit(True).alias("fresh"))
    every = facts.select("fact_id", "predicate", "args", "tick", F.when(F.col("licensed"), F.col("lo")).alias("lo"), F.when(F.col("licensed"), F.col("hi")).alias("hi"), "licensed", "events", F.lit(False).alias("fresh")).unionByName(heads)
    # Events stand with one row of a fact at most, so the longest array is the fact's own.
    return every.groupBy("fact_id").agg(F.first("predicate").alias("predicate"), F.first("args").alias("args"), F.first("tick").alias("tick"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.every("licensed").alias("licensed"), F.max_by("events", F.size("events")).alias("events"), *([F.every("fresh").alias("fresh")] if fresh else []))


def refuse_kinds(rules: list[Rule]) -> None:
    odd = sorted({r.kind for r in rules} - {"detect", "obligation"})
    if odd:
        raise ValueError(f"nothing evaluates rules of kind {', '.join(odd)}")


@dataclass(frozen=True)
class Caps:
    """Limits of a run; None is none. A run that meets one stops there, and says so: it is never cut off in silence."""

    rounds: int = MAX_ROUNDS
    facts: int | None = None
    instances: int | None = None
    bindings: int | None = None


def strata(rules: list[Rule]) -> list[list[Rule]] | None:
    """Rules in layers: whatever a rule reads, matched or missed, is made by layers before its own. None where a predicate
    hangs on itself."""
    reads = {r.rule_id: {p.predicate for p in r.body} | ({r.temporal["of"].predicate} if r.temporal and r.temporal["op"] == "absence" else set()) for r in rules}
    left, layers = list(rules), []
    while left:
        open_ = {r.head.predicate for r in left}
        ready = [r for r in left if not reads[r.rule_id] & open_]
        if not ready:
            return None
        layers.append(ready)
        left = [r for r in left if r not in ready]
    return layers


def saturate(facts: DataFrame, rules: list[Rule], instances: DataFrame | None = None, absence: Callable | None = None, max_rounds: int = MAX_ROUNDS, caps: Caps | None = None, extra: DataFrame | None = None) -> Program:
    """Close ``facts`` (and ``instances``) under the detect rules; the heads of obligations are for ``envelope``.
    ``absence(windows, sources)`` gives each window's status; without it a missing record is taken as an absence.
    ``extra``: instances beside a program that is closed already, so that only what they add is followed up.

    Rules in layers are evaluated once each, a round for a layer; a table whose predicates hang on themselves goes round
    until a round adds nothing. A round writes what it adds, facts and instances, and known facts are read again. They are
    written again only in a round in which an instance supports a fact that was licensed, since its span or its licence
    may end there."""
    refuse_kinds(rules)
    spark = facts.sparkSession
    caps = caps or Caps(max_rounds)
    met: list[str] = []
    detect = [r for r in rules if r.kind == "detect"]
    layers = strata(detect)
    if extra is not None:
        grown = written(merged_facts(facts, extra, fresh=True))
        parts, fresh = [grown.drop("fresh")], [grown.where("fresh").drop("fresh")]
        present = {r.predicate for r in fresh[0].select("predicate").distinct().collect()}  # a few dozen names at most
        found = [instances.unionByName(extra)]
    else:
        parts, fresh, present = [written(facts if instances is None else merged_facts(facts, instances))], [], None
        found = [spark.createDataFrame([], INSTANCES) if instances is None else instances]
    free = extra is not None or instances is not None or not parts[0].where("licensed").isEmpty()
    rounds, made, layer = 0, found[0].count() if caps.instances is not None else 0, 0
    while layers is None or layer < len(layers):
        known, new, heads = functools.reduce(DataFrame.unionByName, parts), None, set()
        # Where all facts are new to a rule, one pivot finds everything.
        delta = known if present is None else functools.reduce(DataFrame.unionByName, fresh)
        for rule in detect if layers is None else layers[layer]:
            for pivot in [0] if present is None else [k for k, p in enumerate(rule.body) if p.predicate in present]:
                got = derive(rule, known, delta, pivot, absence, free)
                new = got if new is None else new.unionByName(got)
                heads.add(rule.head.predicate)
        layer += 1
        if new is not None:
            new = new.dropDuplicates(["instance_id"])
            if present is None and instances is not None:
                new = new.join(instances.select("instance_id"), "instance_id", "left_anti")
            # Elsewhere an instance has a new fact in its body, or a rule's only turn makes it: nothing comes twice.
            new = written(new)
        n = 0 if new is None else new.count()
        if not n:
            if layers is None:
                break
            continue
        rounds, made = rounds + 1, made + n
        found.append(new)
        changed = free and not new.select(F.col("head").alias("fact_id")).join(known.where("licensed").select("fact_id"), "fact_id", "left_semi").isEmpty()
        if changed:
            grown = written(merged_facts(known, new, fresh=True))
            parts, latest = [grown.drop("fresh")], grown.where("fresh").drop("fresh")
            if fresh and layers is not None:
                # What was new before may have lost its licence since.
                fresh = [written(parts[0].join(functools.reduce(DataFrame.unionByName, fresh).select("fact_id"), "fact_id", "left_semi"))]
        else:
            none = spark.createDataFrame([], FACTS)
            latest = written(merged_facts(none, new).join(known.select("fact_id"), "fact_id", "left_anti"))
            parts = [*parts, latest]
        if layers is None:
            fresh, present = [latest], heads
        elif present is not None:
            fresh, present = [*fresh, latest], present | heads
        met = [name for name, most, have in (("rounds", caps.rounds, rounds), ("instances", caps.instances, made), ("facts", caps.facts, None if caps.facts is None else functools.reduce(DataFrame.unionByName, parts).count())) if most is not None and have >= most]
        if met:
            break
    return Program(functools.reduce(DataFrame.unionByName, parts), functools.reduce(DataFrame.unionByName, found), rounds, bool(met), tuple(met))


def over_bindings(rule: Rule, pools: DataFrame, most: int | None) -> bool:
    """Whether the product of a rule's pools has over ``most`` bindings a window."""
    if most is None or not rule.silent_kinds:
        return False
    sizes = {r.kind: r.n for r in pools.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    return math.prod(sizes.get(kind, 0) for kind in rule.silent_kinds.values()) > most


def licensed_windows(rule: Rule, line: DataFrame, tick_width: int = 1, key: str = "source") -> DataFrame:
    """(tick, last, license_ids): the windows in which every producing source of a rule is not LIVE, and the runs that say so."""
    # Both are small and read three times: for their mean spans and for the join.
    windows = written(liveness.joint_windows(line, list(rule.sources), key).select(F.expr(f"t0 div {tick_width}").alias("tick"), F.greatest(F.expr(f"t0 div {tick_width}"), F.expr(f"(t1 - 1) div {tick_width}")).alias("last"), "t0", "t1"))
    met = written(liveness.blind_runs(line, key, merge_reasons=False).where(F.col(key).isin(*rule.sources)).select(key, F.col("t0").alias("r0"), F.col("t1").alias("r1"), "verdict", "reason"))
    return overlap_join(met, windows, ("r0", "r1"), ("t0", "t1")).groupBy("tick", "last").agg(F.array_sort(F.collect_set(fast("licence", F.col("verdict"), F.col("reason"), F.col(key), F.col("r0"), F.col("r1")))).alias("license_ids"))


def silent_instances(rule: Rule, line: DataFrame, pools: DataFrame, tick_width: int = 1, key: str = "source", most: int | None = None) -> DataFrame:
    """Licensed instances of a rule, and of its premises as ghosts: one for each window in which every producing source
    is not LIVE and each binding of its variables. pools: (kind, entity_id), declared entities."""
    lic = licensed_windows(rule, line, tick_width, key)
    names, bound = sorted(rule.silent_kinds or {}), None
    for v in names:
        # Declared entities of one kind: a dimension, met by every window because the hidden step may be anyone's.
        pool = pools.where(F.col("kind") == rule.silent_kinds[v]).select(F.col("entity_id").alias(f"v_{v}"))
        if most is not None:
            pool = pool.orderBy(f"v_{v}").limit(most)  # the first ``most`` bindings have no other entity
        bound = pool if bound is None else bound.join(pool, F.lit(True))
    if bound is not None and most is not None:
        bound = bound.orderBy(*[f"v_{v}" for v in names]).limit(most)
    rows = lic if bound is None else lic.join(F.broadcast(bound), F.lit(True))
    none = F.array().cast("array<string>")
    col = lambda p: F.array(*[F.col(f"v_{v}") for v in p.variables]) if p.variables else none
    bodies = F.array(*[fact_id(F.lit(p.predicate), col(p), F.col("tick")) for p in rule.body])
    head = rows.select(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.head.predicate).alias("predicate"), col(rule.head).alias("args"), "tick", bodies.alias("body"), none.alias("evidence"), "license_ids", "last")
    head = head.withColumn("head", fact_id(F.col("predicate"), F.col("args"), F.col("tick")))
    out = finished(head, rule, "LICENSED", F.col("license_ids"), F.lit(False), F.col("tick"), F.col("last"))
    for p in rule.body:
        premise = rows.select(F.lit(rule.rule_id).alias("rule_id"), F.lit(p.predicate).alias("predicate"), col(p).alias("args"), "tick", none.alias("body"), none.alias("evidence"), "license_ids", "last")
        premise = premise.withColumn("head", fact_id(F.col("predicate"), F.col("args"), F.col("tick")))
        out = out.unionByName(finished(premise, rule, "LICENSED", F.col("license_ids"), F.lit(True), F.col("tick"), F.col("last"), blocked=False))
    return out


def obligation_ghosts(rule: Rule, facts: DataFrame, line: DataFrame, key: str = "source") -> DataFrame:
    """Ghosts of an obligation's missing heads: for each fact that its first pattern matches, and whose head isn't a fact
    at its very tick, if every producing source is not LIVE throughout [max(0, tick - within), tick). Their span is
    unknown. A missing head that is not licensed gives no ghost. Of triggers with one head, the first by id has it."""
    none = F.array().cast("array<string>")
    rows = slot_frame(facts, rule.body[0], "a")
    args = F.array(*[F.col(f"v_{v}") for v in rule.head.variables]) if rule.head.variables else none
    made = rows.select(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.head.predicate).alias("predicate"), args.alias("args"), F.col("a_t").alias("tick"), "a_id")
    made = made.withColumn("head", fact_id(F.col("predicate"), F.col("args"), F.col("tick"))).groupBy("rule_id", "predicate", "args", "tick", "head").agg(F.min("a_id").alias("a_id"))
    missing = written(made.join(facts.select(F.col("fact_id").alias("head")), "head", "left_anti").withColumns({"w0": F.greatest(F.lit(0), F.col("tick") - rule.temporal["within"]), "w1": F.col("tick")}))
    asked = missing.select(F.col("head").alias("window_id"), F.explode(F.array(*[F.lit(s) for s in rule.sources])).alias(key), "w0", "w1")
    granted = liveness.coverage(asked, line, len(rule.sources), key=key).where("licensable").select(F.col("window_id").alias("head"))
    runs = liveness.blind_runs(line, key, merge_reasons=False).where(F.col(key).isin(*rule.sources)).select(key, F.col("t0").alias("r0"), F.col("t1").alias("r1"), "verdict", "reason")
    met = overlap_join(missing.join(granted, "head"), runs, ("w0", "w1"), ("r0", "r1"))
    lic = met.groupBy("head").agg(F.array_sort(F.collect_set(fast("licence", F.col("verdict"), F.col("reason"), F.col(key), F.col("r0"), F.col("r1")))).alias("license_ids"))
    ghosts = missing.join(lic, "head").withColumns({"body": F.array("a_id"), "evidence": none})
    return finished(ghosts, rule, "LICENSED", F.col("license_ids"), F.lit(True), F.lit(None), F.lit(None))


def envelope(p_min: Program, rules: list[Rule], line: DataFrame, pools: DataFrame, absence: Callable | None = None, key: str = "source", caps: Caps | None = None) -> Program:
    """P_max: P_min's facts and instances, the licensed silent instances, closed again, then the ghosts of missing
    obligation heads, closed once more. P_min is within it by construction."""
    refuse_kinds(rules)
    extra, met, most = None, set(p_min.caps), caps.bindings if caps else None
    for rule in rules:
        if rule.silent_kinds and rule.kind == "detect":
            if over_bindings(rule, pools, most):
                met.add("bindings")
            got = silent_instances(rule, line, pools, key=key, most=most)
            # A premise that is a fact already needs no ghost.
            ghosts = got.where("ghost").join(p_min.facts.select(F.col("fact_id").alias("head")), "head", "left_anti")
            got = got.where("not ghost").unionByName(ghosts.select(*got.columns))
            extra = got if extra is None else extra.unionByName(got)
    out = p_min
    if extra is not None:
        out = saturate(p_min.facts, rules, p_min.instances, absence, caps=caps, extra=written(extra.dropDuplicates(["instance_id"])))
        met |= set(out.caps)
    owed = [r for r in rules if r.kind == "obligation"]
    facts, more = out.facts, None
    for rule in owed:
        # A ghost of one obligation is a fact to the next.
        ghosts = written(obligation_ghosts(rule, facts, line, key))
        facts, more = written(merged_facts(facts, ghosts)), ghosts if more is None else more.unionByName(ghosts)
    if owed:
        out = saturate(out.facts, rules, out.instances, absence, caps=caps, extra=more)
        met |= set(out.caps)
    spreading = [r.rule_id for r in rules if r.relation == "PROPAGATES"]
    if spreading:
        ghosts = out.facts.where("licensed").join(out.instances.where("ghost").select(F.col("head").alias("fact_id")).distinct(), "fact_id", "left_semi")
        if not ghost_only(out.instances, ghosts, spreading).isEmpty():
            raise ValueError("an instance of a propagating rule has ghosts only in its body")
    return Program(out.facts, out.instances, out.rounds, bool(met), tuple(sorted(met)))


def missing_from(inner: Program, outer: Program) -> DataFrame:
    """Facts and instances of ``inner`` that ``outer`` lacks: empty for P_min and P_max."""
    facts = inner.facts.select(F.col("fact_id").alias("id")).join(outer.facts.select(F.col("fact_id").alias("id")), "id", "left_anti")
    return facts.union(inner.instances.select("instance_id").join(outer.instances.select("instance_id"), "instance_id", "left_anti"))


def absence_by(line: DataFrame, key: str = "source") -> Callable:
    """The absence oracle of a timeline in ticks."""

    def status(windows: DataFrame, sources: tuple[str, ...]) -> DataFrame:
        asked = windows.withColumn(key, F.explode(F.array(*[F.lit(s) for s in sources])))
        return liveness.coverage(asked, line, len(sources), key=key).select("window_id", "status")

    return status


def ghost_only(instances: DataFrame, facts_ghost: DataFrame, propagates: list[str]) -> DataFrame:
    """Instances of propagating rules whose whole body is ghosts: must be empty."""
    edges = instances.where(F.col("rule_id").isin(*propagates) & (F.size("body") > 0)).select("instance_id", F.explode("body").alias("fact_id"))
    marked = edges.join(facts_ghost.select("fact_id", F.lit(True).alias("g")), "fact_id", "left")
    return marked.groupBy("instance_id").agg(F.every(F.coalesce("g", F.lit(False))).alias("all_ghost")).where("all_ghost").select("instance_id")


def goal_facts(facts: DataFrame, predicate: str, wanted: list[str]) -> DataFrame:
    """Facts of a predicate whose args hold every wanted entity, in order of their ids."""
    return facts.where((F.col("predicate") == predicate) & (F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]).cast("array<string>"), F.col("args"))) == 0)).orderBy("fact_id")


def empty(spark: SparkSession) -> Program:
    return Program(spark.createDataFrame([], FACTS), spark.createDataFrame([], INSTANCES), 0)
