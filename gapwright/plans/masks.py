"""Programs without instances: facts with the blocker sets of their derivations, and nothing else.

What cuts, goals and lists of facts ask for hangs on facts and on the masks of ``antichain`` alone. So a rule joins its
body as in ``fixpoint``, and a row goes at once into its head and the union of the body's masks, told apart before the
shuffle: no ids, no evidence, no table of instances. Rules come in layers, each predicate is whole before it is read.

Silent steps stay a product of windows and entities. A rule that reads one asks, for each row of its other slot, whether a
window is in reach: the last one that begins in time has the latest end, since joint windows are apart. Only where
that window's step of that entity was observed too, and so has no span, the others are looked at.

Tables that this can't hold are refused: predicates that hang on themselves, events that are also derived, rules over
distinct values or obligations, silent premises that are derived, and silent steps that hand a head its time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import liveness
from ..operators.series import as_of, with_neighbours
from ..operators.temporal import overlap_join
from ..session import written
from .antichain import minimal
from .fixpoint import bucketed, near, strata
from .rules import SLOTS, Pattern, Rule, compile_guard

HOUR_TICKS = 3600
#: A product of silent steps: windows of a block, rows of a task, tasks at most.
BLOCK, TASK_ROWS, PRODUCT_TASKS = 512, 2_000_000, 2000


@dataclass(frozen=True)
class Silent:
    """Steps of a predicate that the windows may have hidden, for every binding of the kinds of its arguments."""

    windows: DataFrame
    kinds: tuple[str, ...]
    mask: int


@dataclass
class Masked:
    """Facts by predicate, as (args, tick, mask): observed ones, each with all of its masks, and silent ones as products."""

    rules: list[Rule]
    axioms: frozenset[str]
    facts: dict[str, DataFrame]
    #: The masks that a predicate's facts can have.
    possible: dict[str, set[int]]
    silent: dict[str, list[Silent]] = field(default_factory=dict)
    pools: DataFrame | None = None

    def masks_of(self, predicate: str) -> set[int]:
        """Masks that some fact of a predicate has."""
        return {r.mask for r in self.facts[predicate].select("mask").distinct().collect()}

    def clauses(self, goal: str) -> tuple[int, ...]:
        """The antichain of all facts of a predicate that silent steps don't make themselves."""
        if goal in self.silent:
            raise ValueError(f"{goal} may be silent itself")
        found = {m & ((1 << 64) - 1) for m in self.masks_of(goal)}
        return tuple(sorted(m for m in found if not any(o != m and o & m == o for o in found)))

    def derived(self, masks: bool = False) -> DataFrame:
        """(predicate, args, tick), with ``masks``, their antichain, of all facts that rules or silent steps make."""
        out = None
        for predicate in sorted({r.head.predicate for r in self.rules}):
            seen = self.facts[predicate]
            steps = self.silent.get(predicate, [])
            if len(steps) == 1 and self.possible[predicate] == {steps[0].mask}:
                # What a product holds isn't told apart row by row: the few observed facts in it go instead.
                seen = seen.join(inside(seen, steps[0], self.pools), ["args", "tick"], "left_anti").unionByName(product(steps[0], self.pools))
            elif steps:
                seen = functools.reduce(DataFrame.unionByName, [seen, *[product(s, self.pools) for s in steps]]).distinct()
            if len(self.possible[predicate]) == 1:
                # A constant, so what is made of it is worked out once and not in every row.
                rows = seen.select("args", "tick", F.array(*[F.lit(m).cast("long") for m in self.possible[predicate]]).alias("masks"))
            elif masks:
                rows = seen.groupBy("args", "tick").agg(minimal(F.collect_set("mask")).alias("masks"))
            else:
                rows = seen.select("args", "tick").distinct()
            rows = rows.select(F.lit(predicate).alias("predicate"), "args", "tick", *(["masks"] if masks else []))
            out = rows if out is None else out.unionByName(rows)
        return out


def seed(events: DataFrame) -> DataFrame:
    """Distinct facts (predicate, args, tick) of events."""
    return written(events.select("predicate", "args", "tick").distinct())


def own_mask(rule: Rule) -> int:
    out = functools.reduce(lambda a, b: a | b, rule.blockers, 0)
    return out if out < 1 << 63 else out - (1 << 64)


def frame_of(facts: DataFrame, p: Pattern, slot: str) -> DataFrame:
    """Facts that a pattern matches: its variables as v_name, time and mask with the slot's prefix."""
    got, first = facts.where(F.size("args") == len(p.variables)), {}
    for i, v in enumerate(p.variables):
        if v in first:
            got = got.where(F.get("args", F.lit(i)) == F.get("args", F.lit(first[v])))
        first.setdefault(v, i)
    return got.select(*[F.get("args", F.lit(i)).alias(f"v_{v}") for v, i in first.items()], F.col("tick").alias(f"{slot}_t"), F.col("mask").alias(f"{slot}_m"))


def body_of(rule: Rule, facts: dict[str, DataFrame]) -> DataFrame:
    """Rows that the patterns match together and the rule's sequence allows."""
    rows, bound, t = None, set(), rule.temporal
    pair = {t["left"], t["right"]} if t and t["op"] == "seq" else set()
    for i, p in enumerate(rule.body):
        slot = SLOTS[i]
        frame = frame_of(facts[p.predicate], p, slot)
        shared = [f"v_{v}" for v in dict.fromkeys(p.variables) if v in bound]
        other = next((s for s in pair - {slot} if s in SLOTS[:i]), None) if slot in pair else None
        if rows is None:
            rows = frame
        elif other is None:
            rows = rows.join(frame, shared)
        else:
            one, two, first, second = (rows, frame, other, slot) if slot == t["right"] else (frame, rows, slot, other)
            rows = near(one, two, shared, f"{first}_t", f"{second}_t", t["within"])
        bound |= set(p.variables)
    return rows


def without(rule: Rule, rows: DataFrame, facts: dict[str, DataFrame], absence: Callable | None) -> DataFrame:
    """Rows of an absence rule that nothing meets in the window before them; and, by ``absence``, only observed windows."""
    t = rule.temporal
    anchor, of = f"{t['before']}_t", t["of"]
    shared = [f"v_{v}" for v in dict.fromkeys(of.variables) if f"v_{v}" in rows.columns]
    asked = rows.select(*shared, F.col(anchor).alias("at")).distinct()
    asked = asked.withColumn("b", F.explode(F.array(bucketed(F.col("at"), t["within"]), bucketed(F.col("at"), t["within"]) - 1)))
    met = frame_of(facts[of.predicate], of, "x").withColumn("b", bucketed(F.col("x_t"), t["within"]))
    hit = asked.join(met, [*shared, "b"]).where((F.col("x_t") >= F.col("at") - t["within"]) & (F.col("x_t") < F.col("at"))).select(*shared, F.col("at").alias(anchor)).distinct()
    kept = rows.join(hit, [*shared, anchor], "left_anti")
    if absence is None:
        return kept
    # Whether a window was observed hangs on its time alone.
    windows = kept.select(F.col(anchor).alias("window_id"), (F.col(anchor) - t["within"]).alias("w0"), F.col(anchor).alias("w1")).distinct()
    seen = absence(windows, rule.sources).where("status = 'OBSERVED'").select(F.col("window_id").alias(anchor))
    return kept.join(seen, anchor, "left_semi")


def heads(rule: Rule, rows: DataFrame, masks: list[str]) -> DataFrame:
    """The heads of a rule's rows, with the union of the rule's blockers and the masks."""
    when = {p.time: s for s, p in zip(SLOTS, rule.body)}[rule.head.time]
    args = F.array(*[F.col(f"v_{v}") for v in rule.head.variables]) if rule.head.variables else F.array().cast("array<string>")
    mask = functools.reduce(lambda a, b: a.bitwiseOR(b), [F.col(m) for m in masks], F.lit(own_mask(rule)).cast("long"))
    return rows.select(args.alias("args"), F.col(f"{when}_t").alias("tick"), mask.alias("mask")).distinct()


def fired(rule: Rule, facts: dict[str, DataFrame], absence: Callable | None) -> DataFrame:
    """Heads of a rule over observed facts."""
    ref = lambda slot, name: F.col(f"{slot}_t") if name == "t" else F.col(f"v_{name}")
    rows = body_of(rule, facts).where(compile_guard(rule.when, ref))
    if rule.temporal and rule.temporal["op"] == "absence":
        rows = without(rule, rows, facts, absence)
    return heads(rule, rows, [f"{s}_m" for s in SLOTS[: len(rule.body)]])


def refuse(rules: list[Rule], axioms: frozenset[str]) -> list[list[Rule]]:
    layers = strata(rules)
    if layers is None:
        raise ValueError("a predicate hangs on itself")
    for r in rules:
        if r.kind != "detect" or r.temporal and r.temporal["op"] not in ("seq", "absence"):
            raise ValueError(f"{r.rule_id}: neither a sequence nor an absence")
        if r.head.predicate in axioms:
            raise ValueError(f"{r.head.predicate} is both derived and an event")
        if r.silent_kinds and any(p.predicate not in axioms for p in r.body):
            raise ValueError(f"{r.rule_id}: a silent premise is derived")
    return layers


def observed(events: DataFrame, rules: list[Rule], axioms: set[str], absence: Callable | None = None) -> Masked:
    """P_min of the facts of events (predicate, args, tick)."""
    named = frozenset(axioms)
    layers, facts = refuse(rules, named), {a: events.where(F.col("predicate") == a).select("args", "tick", F.lit(0).cast("long").alias("mask")) for a in axioms}
    possible: dict[str, set[int]] = {a: {0} for a in axioms}
    left = {r.rule_id for r in rules}
    parts: dict[str, list[DataFrame]] = {}
    for layer in layers:
        for rule in layer:
            left.discard(rule.rule_id)
            head = rule.head.predicate
            mine = {own_mask(rule)}
            for p in rule.body:
                mine = {a | b for a in mine for b in possible[p.predicate]}
            # An instance needs evidence, and only events are evidence.
            if any(rule.body[SLOTS.index(s)].predicate in axioms for s in rule.evidence):
                parts.setdefault(head, []).append(fired(rule, facts, absence))
                possible[head] = possible.get(head, set()) | mine
            if not any(r.head.predicate == head for r in rules if r.rule_id in left):
                made = parts.get(head)
                rows = functools.reduce(DataFrame.unionByName, made) if made else events.where("false").select("args", "tick", F.lit(0).cast("long").alias("mask"))
                facts[head] = written(rows.distinct() if made and len(made) > 1 else rows)
                possible.setdefault(head, set())
    return Masked(rules, named, facts, possible)


def windows_of(rule: Rule, line: DataFrame, key: str = "source") -> DataFrame:
    """(lo, hi) of the windows in which every producing source of a rule is not LIVE."""
    return liveness.joint_windows(line, list(rule.sources), key).select(F.col("t0").alias("lo"), F.greatest(F.col("t0"), F.col("t1") - 1).alias("hi"))


def product(s: Silent, pools: DataFrame) -> DataFrame:
    """(args, tick, mask) of silent steps, a row for each window and binding, in as many tasks as its rows ask for.

    Bindings are dealt out together with the numbers of blocks of windows, and each pair takes its block's windows where it
    has come to. The pairs of a task stand in the order of blocks, so its rows repeat one block's times for one binding
    after the other, and a file of them is small."""
    if not s.kinds:
        return s.windows.select(F.array().cast("array<string>").alias("args"), F.col("lo").alias("tick"), F.lit(s.mask).cast("long").alias("mask"))
    bound = None
    for i, kind in enumerate(s.kinds):
        pool = pools.where(F.col("kind") == kind).select(F.col("entity_id").alias(f"e{i}")).distinct()
        bound = pool if bound is None else bound.crossJoin(pool)
    numbered = with_neighbours(s.windows.select(F.lit(1).alias("\0k"), "lo"), ["\0k"], ["lo"], [], width=24 * HOUR_TICKS, number="\0n")
    blocks = written(numbered.select(F.expr(f"`\0n` div {BLOCK}").alias("block"), "lo"))
    bound, names = written(bound), [f"e{i}" for i in range(len(s.kinds))]
    tasks = -(-bound.count() * blocks.count() // TASK_ROWS)
    pairs = bound.crossJoin(F.broadcast(blocks.select("block").distinct())).repartitionByRange(max(1, min(tasks, PRODUCT_TASKS)), "block", *names).sortWithinPartitions("block", *names)
    rows = pairs.join(F.broadcast(blocks), "block")
    return rows.select(F.array(*names).alias("args"), F.col("lo").alias("tick"), F.lit(s.mask).cast("long").alias("mask"))


def inside(facts: DataFrame, s: Silent, pools: DataFrame) -> DataFrame:
    """(args, tick) of the facts that a product holds."""
    got = facts.where(F.size("args") == len(s.kinds)).join(s.windows.select(F.col("lo").alias("tick")), "tick", "left_semi")
    for i, kind in enumerate(s.kinds):
        got = got.withColumn("\0e", F.get("args", F.lit(i))).join(pools.where(F.col("kind") == kind).select(F.col("entity_id").alias("\0e")), "\0e", "left_semi")
    return got.select("args", "tick").distinct()


def in_reach(rows: DataFrame, s: Silent, exceptions: DataFrame, names: list[str], first, last, within: int) -> DataFrame:
    """``rows`` for which a silent step without an exception (names, tick) has a moment in [first, last]."""
    asked = rows.withColumns({"\0k": F.lit(1), "\0a": first, "at": last})
    windows = s.windows.select(F.lit(1).alias("\0k"), F.col("lo").alias("at"), "hi")
    met = as_of(asked, windows, ["\0k"], "at", ["hi"], width=HOUR_TICKS).where(F.col("as_of_hi") >= F.col("\0a"))
    same = exceptions.select(*names, F.col("tick").alias("as_of_at"), F.lit(True).alias("\0x"))
    met = written(met.join(same, [*names, "as_of_at"], "left"))
    sure = met.where("`\0x` IS NULL").select(*rows.columns)
    # The last window's step was observed: it has a time and no span, so the windows before it are looked at.
    again = met.where("`\0x`").select(*rows.columns, "\0a", (F.col("at") + 1).alias("\0z"))
    others = overlap_join(again, s.windows.select("lo", (F.col("hi") + 1).alias("\0e")), ("\0a", "\0z"), ("lo", "\0e"), width=max(within, 1))
    free = others.join(exceptions.select(*names, F.col("tick").alias("lo")), [*names, "lo"], "left_anti")
    return sure.unionByName(free.select(*rows.columns))


def heard(rule: Rule, k: int, s: Silent, facts: dict[str, DataFrame], pools: DataFrame, axioms: frozenset[str]) -> DataFrame | None:
    """Heads of a rule whose slot ``k`` is a silent step."""
    slot, p, t = SLOTS[k], rule.body[k], rule.temporal
    if not any(e != slot and rule.body[SLOTS.index(e)].predicate in axioms for e in rule.evidence):
        return None
    if len(rule.body) != 2 or not t or t["op"] != "seq" or slot not in (t["left"], t["right"]):
        raise ValueError(f"{rule.rule_id}: a silent step outside a sequence of two")
    o, other = SLOTS[1 - k], rule.body[1 - k]
    if rule.head.time != other.time or not set(rule.head.variables) | set(p.variables) <= set(other.variables):
        raise ValueError(f"{rule.rule_id}: a silent step hands the head its time or a variable")
    rows = frame_of(facts[other.predicate], other, o)
    for v, kind in dict.fromkeys(zip(p.variables, s.kinds)):
        rows = rows.join(pools.where(F.col("kind") == kind).select(F.col("entity_id").alias(f"v_{v}")).distinct(), f"v_{v}", "left_semi")
    begins = s.windows.select(F.col("lo").alias("tick"))
    seen = facts[p.predicate].join(begins, "tick", "left_semi")
    exceptions = frame_of(seen, p, "x").select(*[f"v_{v}" for v in dict.fromkeys(p.variables)], F.col("x_t").alias("tick")).distinct()
    at, w = F.col(f"{o}_t"), t["within"]
    first, last = (at - w, at - 1) if slot == t["left"] else (at + 1, at + w)
    met = in_reach(rows, s, exceptions, [f"v_{v}" for v in dict.fromkeys(p.variables)], first, last, w)
    return heads(rule, met.withColumn(f"{slot}_m", F.lit(s.mask).cast("long")), [f"{o}_m", f"{slot}_m"])


def envelope(low: Masked, line: DataFrame, pools: DataFrame, absence: Callable | None = None, key: str = "source") -> Masked:
    """P_max over ``low``: what the silent steps of every binding add to it."""
    silent: dict[str, list[Silent]] = {}
    for rule in low.rules:
        if rule.silent_kinds:
            windows = written(windows_of(rule, line, key))
            kinds = lambda p: tuple(rule.silent_kinds[v] for v in p.variables)
            silent.setdefault(rule.head.predicate, []).append(Silent(windows, kinds(rule.head), own_mask(rule)))
            for p in rule.body:
                silent.setdefault(p.predicate, []).append(Silent(windows, kinds(p), 0))
    facts, possible, grown = dict(low.facts), {p: set(m) for p, m in low.possible.items()}, set()
    for predicate, steps in silent.items():
        for s in steps:
            # A step that was observed as well has the silent one's mask too.
            if possible[predicate] - {s.mask}:
                both = inside(facts[predicate], s, pools).withColumn("mask", F.lit(s.mask).cast("long"))
                facts[predicate] = written(facts[predicate].unionByName(both).distinct())
                grown.add(predicate)
            possible[predicate].add(s.mask)
    left = {r.rule_id for r in low.rules}
    added: dict[str, list[DataFrame]] = {}
    for layer in strata(low.rules):
        for rule in layer:
            left.discard(rule.rule_id)
            head, of = rule.head.predicate, [p.predicate for p in rule.body]
            if grown & set(of):
                if rule.temporal and rule.temporal["op"] == "absence":
                    raise ValueError(f"{rule.rule_id}: an absence over what silent steps make")
                added.setdefault(head, []).append(fired(rule, facts, absence))
                mine = {own_mask(rule)}
                for name in of:
                    mine = {a | b for a in mine for b in possible[name]}
                possible[head] |= mine
            for k, name in enumerate(of):
                for s in silent.get(name, []):
                    got = heard(rule, k, s, facts, pools, low.axioms)
                    if got is not None:
                        added.setdefault(head, []).append(got)
                        possible[head] |= {own_mask(rule) | s.mask | m for m in possible[of[1 - k]]}
            if head in added and not any(r.head.predicate == head for r in low.rules if r.rule_id in left):
                facts[head] = written(functools.reduce(DataFrame.unionByName, [facts[head], *added[head]]).distinct())
                grown.add(head)
    return Masked(low.rules, low.axioms, facts, possible, silent, pools)
