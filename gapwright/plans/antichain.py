"""What blocks a fact, for all cuts at once: a fixpoint over antichains of blocker sets.

Every fact gets the minimal sets of cut literals that meet all the blockers of some derivation of it: an event has the
empty set, an instance adds its own blockers to one set of each fact in its body, and of a fact's sets those that
include another one go. A cut severs a fact if it meets every one of its sets, so what holds under each cut of a
lattice, the clauses of the minimum cuts and the witnesses' corridors are read off one small table, and no instance is
met by cuts or brought to the driver.

Sets are masks of 64 literals. A fact has no more of them than there are unions of the rules' blockers that don't
include each other, whatever the number of its derivations. Rounds add rows: nothing known is written again.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .cuts import Budget, Infeasible, Psi, canonical_cut
from .rules import Controls


def minimal(masks: Column) -> Column:
    """The masks of an array that include no other one, in order."""
    held = F.array_sort(F.array_distinct(masks))
    return F.filter(held, lambda m: ~F.exists(held, lambda o: (o != m) & (o.bitwiseAND(m) == o)))


def joined(own: Column, bodies: Column) -> Column:
    """Minimal unions of ``own`` and one mask of each antichain in ``bodies``."""
    step = lambda acc, sets: minimal(F.flatten(F.transform(acc, lambda a: F.transform(sets, lambda b: a.bitwiseOR(b)))))
    return F.aggregate(bodies, F.array(own), step)


def checked(instances: DataFrame, goals: DataFrame | None = None, facts: DataFrame | None = None) -> None:
    """Refuses a program that an index can't hold: a blocker of several literals or none, an instance id that comes twice,
    a body that isn't in the facts, a goal that isn't one of them."""
    bits = F.transform("blockers", lambda b: F.bit_count(b))
    r = instances.agg(F.count_if(F.exists(bits, lambda n: n != 1)).alias("terms"), F.count_if(F.col("instance_id").isNull() | F.col("head").isNull() | F.col("body").isNull()).alias("holes")).collect()[0]
    if r.terms:
        raise ValueError(f"{r.terms} instances have a blocker that isn't one literal")
    if r.holes:
        raise ValueError(f"{r.holes} instances lack an id, a head or a body")
    if not instances.groupBy("instance_id").count().where("count > 1").isEmpty():
        raise ValueError("an instance id comes twice")
    if facts is not None:
        used = instances.select(F.explode("body").alias("fact_id")).distinct()
        if not used.join(facts.select("fact_id"), "fact_id", "left_anti").isEmpty():
            raise ValueError("a body holds what isn't a fact")
        if goals is not None and not goals.select("fact_id").join(facts.select("fact_id"), "fact_id", "left_anti").isEmpty():
            raise ValueError("a goal isn't a fact")


def corridors(facts: DataFrame, instances: DataFrame) -> DataFrame:
    """(fact_id, masks): the antichain of every fact that can be derived. ``facts``: the given ones, those of events."""
    own = F.aggregate("blockers", F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))
    used = written(instances.select("instance_id", "head", own.alias("own"), F.array_distinct("body").alias("body")))
    edges = written(used.where(F.size("body") > 0).select("instance_id", "head", "own", F.size("body").alias("need"), F.explode("body").alias("fact_id")))
    start = facts.select("fact_id", F.lit(0).cast("long").alias("mask"))
    new = written(start.unionByName(used.where(F.size("body") == 0).select(F.col("head").alias("fact_id"), F.col("own").alias("mask"))).distinct())
    rounds = [new]
    while True:
        every = functools.reduce(DataFrame.unionByName, rounds)
        touched = edges.join(new.select("fact_id").distinct(), "fact_id", "left_semi").select("instance_id").distinct()
        met = edges.join(touched, "instance_id", "left_semi")
        bodies = met.select("fact_id").distinct().join(every, "fact_id").groupBy("fact_id").agg(minimal(F.collect_set("mask")).alias("masks"))
        whole = met.join(bodies, "fact_id").groupBy("instance_id", "head", "own", "need").agg(F.collect_list("masks").alias("bodies")).where(F.size("bodies") == F.col("need"))
        made = whole.select(F.col("head").alias("fact_id"), F.explode(joined(F.col("own"), F.col("bodies"))).alias("mask")).distinct()
        # a set that includes one that the head has already says nothing new
        held = every.withColumnRenamed("mask", "held")
        includes = made.join(held, "fact_id").where(F.col("held").bitwiseAND(F.col("mask")) == F.col("held")).select("fact_id", "mask").distinct()
        new = written(made.join(includes, ["fact_id", "mask"], "left_anti"))
        if new.isEmpty():
            break
        rounds.append(new)
    every = functools.reduce(DataFrame.unionByName, rounds)
    return every.groupBy("fact_id").agg(minimal(F.collect_set("mask")).alias("masks"))


def clauses_of(held: DataFrame, goals: DataFrame) -> tuple[int, ...]:
    """The antichain of the goals together: a cut severs all of them if it meets each of these sets."""
    asked = held.join(goals.select("fact_id").distinct(), "fact_id", "left_semi")
    rows = asked.select(F.explode("masks").alias("mask")).distinct().agg(minimal(F.collect_list("mask")).alias("masks")).collect()
    return tuple(sorted(m & ((1 << 64) - 1) for m in rows[0].masks))


def psi_of(clauses: tuple[int, ...], controls: Controls) -> Psi:
    """The cut that all clauses ask for. An empty clause can't be met: the goal needs no step that a control blocks."""
    if 0 in clauses:
        return Psi(clauses, None, True, True)
    try:
        return Psi(clauses, canonical_cut(clauses, controls), True)
    except Infeasible:
        return Psi(clauses, None, True, True)
    except Budget:
        return Psi(clauses, None, False)


def meets_all(clauses: tuple[int, ...], mask: Column) -> Column:
    """Whether a cut's mask meets every clause."""
    out = F.lit(True)
    for c in clauses:
        out = out & (mask.bitwiseAND(F.lit(c if c < 1 << 63 else c - (1 << 64)).cast("long")) != 0)
    return out


def severs(clauses: tuple[int, ...], mask: int) -> bool:
    return all(c & mask for c in clauses)


def reached(held: DataFrame, cuts: DataFrame) -> DataFrame:
    """(cut_id, fact_id): the facts that hold under each cut. Facts fall into few antichains, which meet the cuts."""
    kinds = held.select("masks").distinct()
    open_ = kinds.join(F.broadcast(cuts.select("cut_id", "mask")), F.exists("masks", lambda m: m.bitwiseAND(F.col("mask")) == 0))
    return held.join(open_, "masks").select("cut_id", "fact_id")
