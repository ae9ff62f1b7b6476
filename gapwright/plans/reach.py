"""Reachability in an AND/OR program under cuts: an instance fires when its whole body is reached and no blocker of it
is within the cut. All cuts are evaluated together, by a column ``cut_id``."""

from __future__ import annotations

import functools
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .rules import Controls


def lattice(spark: SparkSession, controls: Controls) -> DataFrame:
    """(cut_id, mask, n_controls, levels) of every admissible cut: the product of the controls' levels."""
    names = sorted(controls.levels)
    cuts = spark.range(1).select(F.lit(0).cast("long").alias("mask"), F.lit(0).alias("n_controls"), F.array().cast("array<int>").alias("levels"))
    for c in names:
        masks = F.array(*[F.lit(controls.cut_mask({c: n})).cast("long") for n in range(len(controls.levels[c]))])
        cuts = cuts.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(len(controls.levels[c]) - 1))))
        cuts = cuts.select((F.col("mask").bitwiseOR(F.element_at(masks, F.col("l") + 1))).alias("mask"), (F.col("n_controls") + (F.col("l") > 0).cast("int")).alias("n_controls"), F.concat("levels", F.array("l")).alias("levels"))
    return cuts.withColumn("cut_id", F.array_join("levels", ""))


def blocked(blockers, mask):
    """A term is one mask; it is satisfied if all its bits are in the cut."""
    return F.exists(blockers, lambda b: b.bitwiseAND(mask) == b)


def classes(instances: DataFrame, cuts: DataFrame) -> DataFrame:
    """``cuts`` with ``like``, the first cut that blocks the very same instances. Instances have few distinct lists of
    blockers, one for each rule at most, so a lattice falls into few classes, and only one cut of each is evaluated."""
    kinds = instances.select("blockers").distinct()
    shut = cuts.join(F.broadcast(kinds), blocked(F.col("blockers"), F.col("mask")), "left").groupBy("cut_id").agg(F.array_sort(F.collect_set(F.xxhash64("blockers"))).alias("shut"))
    alike = cuts.join(shut, "cut_id")
    return written(alike.join(alike.groupBy("shut").agg(F.min("cut_id").alias("like")), "shut").drop("shut"))


def reached(facts: DataFrame, instances: DataFrame, cuts: DataFrame, grouped: bool = False) -> DataFrame:
    """(cut_id, fact_id, round): the least fixpoint for each cut. facts: (fact_id) given, those of events. ``grouped``:
    cuts come with their classes, and only the first of each has rows."""
    held = cuts if grouped else classes(instances, cuts)
    first = held.where("cut_id = like")
    open_ = instances.join(F.broadcast(first.select("cut_id", "mask")), F.lit(True)).where(~blocked(F.col("blockers"), F.col("mask")))
    open_ = open_.select("cut_id", "instance_id", "head", F.array_distinct("body").alias("body"))
    edges = written(open_.select("cut_id", "instance_id", "head", F.size("body").alias("need"), F.explode_outer("body").alias("fact_id")))
    # Facts that no instance uses can't make another fact: they only count as reached.
    start = facts.select("fact_id").join(F.broadcast(first.select("cut_id")), F.lit(True))
    free = edges.where("need = 0").select(F.col("head").alias("fact_id"), "cut_id")
    new = written(start.unionByName(free).distinct().withColumn("round", F.lit(0)))
    rounds = [new]
    met = edges.where("need > 0")
    while True:
        # What a round adds is a table of its own; nothing that is known is written again.
        known = functools.reduce(DataFrame.unionByName, rounds).select("cut_id", "fact_id")
        touched = met.join(new.select("cut_id", "fact_id"), ["cut_id", "fact_id"]).select("cut_id", "instance_id").distinct()
        fired = met.join(touched, ["cut_id", "instance_id"]).join(known, ["cut_id", "fact_id"]).groupBy("cut_id", "instance_id", "head", "need").agg(F.count("*").alias("have")).where("have = need")
        new = fired.select("cut_id", F.col("head").alias("fact_id")).distinct().join(known, ["cut_id", "fact_id"], "left_anti")
        new = written(new.withColumn("round", F.lit(len(rounds))))
        if new.isEmpty():
            break
        rounds.append(new)
    known = functools.reduce(DataFrame.unionByName, rounds)
    return known if grouped else known.withColumnRenamed("cut_id", "like").join(F.broadcast(held.select("cut_id", "like")), "like").select("cut_id", "fact_id", "round")


def severed(known: DataFrame, cuts: DataFrame, goals: DataFrame) -> DataFrame:
    """Cuts with ``severed``: no goal fact is reached under them."""
    hit = known.join(goals.select("fact_id"), "fact_id").select("cut_id").distinct().withColumn("hit", F.lit(True))
    return cuts.join(hit, "cut_id", "left").withColumn("severed", F.col("hit").isNull()).drop("hit")


def severed_by(facts: DataFrame, instances: DataFrame, cuts: DataFrame, goals: DataFrame) -> DataFrame:
    """``cuts`` with ``severed``, by the classes of cuts."""
    held = classes(instances, cuts)
    known = reached(facts, instances, held, grouped=True)
    first = severed(known, held.where("cut_id = like").select("cut_id"), goals).select(F.col("cut_id").alias("like"), "severed")
    return held.join(F.broadcast(first), "like").drop("like")


@dataclass(frozen=True)
class Instance:
    """An instance on the driver, for the corridor search over a collected program."""

    instance_id: str
    head: str
    body: tuple[str, ...]
    blockers: tuple[int, ...]
    observed: str = "OBSERVED"
    license_ids: tuple[str, ...] = ()

    def blocked(self, mask: int) -> bool:
        return any(b & mask == b for b in self.blockers)


def collected(instances: DataFrame, most: int = 500_000) -> list[Instance]:
    """A program's instances, by id; over ``most`` the search is refused and not truncated."""
    rows = instances.select("instance_id", "head", "body", "blockers", "observed", "license_ids").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the program has over {most} instances")
    return sorted((Instance(r.instance_id, r.head, tuple(r.body), tuple(b & ((1 << 64) - 1) for b in r.blockers), r.observed, tuple(r.license_ids)) for r in rows), key=lambda i: i.instance_id)


def closure(axioms: set[str], instances: list[Instance], mask: int) -> dict[str, int]:
    """Reached facts with their place in a first-in, first-out derivation; axioms come first, in order."""
    users: dict[str, list[Instance]] = {}
    missing = {}
    place: dict[str, int] = {}
    ready: deque[str] = deque()

    def reach(fact: str) -> None:
        if fact not in place:
            place[fact] = len(place)
            ready.append(fact)

    for i in instances:
        if not i.blocked(mask):
            missing[i.instance_id] = len(set(i.body))
            for f in set(i.body):
                users.setdefault(f, []).append(i)
    for f in sorted(axioms):
        reach(f)
    for i in instances:
        if missing.get(i.instance_id) == 0:
            reach(i.head)
    while ready:
        for i in users.get(ready.popleft(), ()):
            missing[i.instance_id] -= 1
            if not missing[i.instance_id]:
                reach(i.head)
    return place


def witness(axioms: set[str], instances: list[Instance], mask: int, goal: str) -> list[tuple[str, Instance | None]]:
    """A derivation of ``goal`` as a flat tree in pre-order: a fact takes the open instance with the least id whose body
    was wholly reached before it; an axiom has none."""
    place = closure(axioms, instances, mask)
    if goal not in place:
        raise ValueError(f"{goal} isn't reached")
    supports: dict[str, list[Instance]] = {}
    for i in instances:
        supports.setdefault(i.head, []).append(i)
    out, todo, seen = [], [goal], set()
    while todo:
        fact = todo.pop()
        if fact in seen:
            continue
        seen.add(fact)
        options = [i for i in supports.get(fact, ()) if not i.blocked(mask) and all(place.get(b, len(place)) < place[fact] for b in i.body)]
        chosen = None if fact in axioms or not options else min(options, key=lambda i: i.instance_id)
        out.append((fact, chosen))
        todo += sorted(chosen.body, reverse=True) if chosen else []
    return out
