"""A state machine along each series, as a scan of composed transition functions.

What an event does is a function from states to states, here an array with a place for every state. Functions compose,
so a series is cut into blocks: a block's composition needs no state before it, the state before each block comes from
the compositions of the blocks before (again cut into blocks, if they are many), and then every block runs by itself.
A series with a third of all events is therefore many tasks, and none holds more than ``width`` events of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .series import DAY_US, with_neighbours

WIDTH = 512


class Machine:
    """States by name, and (state, symbol) -> state; a symbol without an entry leaves a state as it is."""

    def __init__(self, states: list[str], moves: dict[tuple[str, str], str]):
        odd = {s for (s, _), to in moves.items() for s in (s, to)} - set(states)
        if odd or len(set(states)) != len(states):
            raise ValueError(f"unknown or repeated states: {sorted(odd)}")
        self.states, self.moves = states, moves
        self.symbols = sorted({x for _, x in moves})

    def function(self, symbol: Column) -> Column:
        """The symbol's function as an array of places; that of an unknown or null symbol changes nothing."""
        same = F.array(*[F.lit(i) for i in range(len(self.states))])
        out = None
        for x in self.symbols:
            to = F.array(*[F.lit(self.states.index(self.moves.get((s, x), s))) for s in self.states])
            out = F.when(symbol == x, to) if out is None else out.when(symbol == x, to)
        return same if out is None else out.otherwise(same)

    def name(self, place: Column) -> Column:
        return F.get(F.array(*[F.lit(s) for s in self.states]), place)


def then(first: Column, second: Column) -> Column:
    """``second`` after ``first``."""
    return F.transform(first, lambda s: F.get(second, s))


def states_before(rows: DataFrame, key: list[str], start: int, width: int = WIDTH) -> DataFrame:
    """(key, place, state): the state before each row. rows: (key, place, f), places dense from 0 in a series."""
    most = rows.agg(F.max("place").alias("m")).collect()[0].m
    cut = rows.withColumn("\0block", F.expr(f"place div {width}L"))
    if most is None or most < width:
        begun = cut.select(*key, "\0block").distinct().withColumn("\0state", F.lit(start))
    else:
        size = len(rows.select("f").first().f)
        ordered = F.array_sort(F.collect_list(F.struct("place", "f")))
        whole = F.aggregate(ordered, F.array(*[F.lit(i) for i in range(size)]), lambda acc, x: then(acc, x["f"]))
        blocks = written(cut.groupBy(*key, "\0block").agg(whole.alias("f")).select(*key, F.col("\0block").alias("place"), "f"))
        begun = states_before(blocks, key, start, width).select(*key, F.col("place").alias("\0block"), F.col("state").alias("\0state"))
    held = cut.groupBy(*key, "\0block").agg(F.array_sort(F.collect_list(F.struct("place", "f"))).alias("\0rows")).join(begun, [*key, "\0block"])
    first = F.struct(F.col("\0state").alias("at"), F.array().cast("array<struct<place:bigint,state:int>>").alias("out"))
    step = lambda acc, x: F.struct(F.get(x["f"], acc["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(x["place"].cast("long").alias("place"), acc["at"].alias("state")))).alias("out"))
    run = held.select(*key, F.explode(F.aggregate("\0rows", first, step, lambda acc: acc["out"])).alias("\0x"))
    return run.select(*key, F.col("\0x.place").alias("place"), F.col("\0x.state").alias("state"))


def run(events: DataFrame, machine: Machine, key: list[str], order: list[str], f: Column, start: str, width: int = WIDTH, span: int = DAY_US) -> DataFrame:
    """``events`` with ``state_before`` and ``state_after``. ``f``: what an event does, from ``machine.function``; ``order``: a
    whole number that buckets of ``span`` are cut from, then tie-breakers."""
    placed = written(with_neighbours(events.withColumn("\0f", f), key, order, [], span, number="place"))
    before = states_before(placed.select(*key, "place", F.col("\0f").alias("f")), key, machine.states.index(start), width)
    met = placed.join(before, [*key, "place"])
    return met.select(*events.columns, machine.name(F.col("state")).alias("state_before"), machine.name(F.get("\0f", F.col("state"))).alias("state_after"))
