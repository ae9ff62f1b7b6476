"""Whether times exist that fit what is known: difference constraints over clocks, numbers and rules, and fewest repairs.

Nodes are records with a span [lo, hi] that their clock allows (a pin), and their source's numbers put them in order: an
earlier one isn't later in time. Rules add pairs: t[v] - t[u] <= w. Bellman-Ford's upper bounds start at hi and fall; a
source's order is relaxed in one scan, whatever its length, so the rounds grow as the changes between pairs and sources
on a path, not as records. A bound under lo, or a path that meets itself, is a conflict, and the path is its witness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, ship, written
from .components import components
from .series import with_bucket

FITS, PINNED, CYCLE = "FITS", "PINNED", "CYCLE"


def rule_pairs(instances: DataFrame, within: int) -> DataFrame:
    """(u, v, w) of rules ``left, then right within``: t[right] - t[left] <= within, and left is earlier by 1 at least."""
    late = instances.select(F.col("left").alias("u"), F.col("right").alias("v"), F.lit(within).cast("long").alias("w"))
    return late.unionByName(instances.select(F.col("right").alias("u"), F.col("left").alias("v"), F.lit(-1).cast("long").alias("w"))).distinct()


def violated(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """(u, v, w, excess) of the pairs that the recorded times (node, t) break; a pair with an unknown end is left out."""
    u, v = times.select(F.col("node").alias("u"), F.col("t").alias("\0u")), times.select(F.col("node").alias("v"), F.col("t").alias("\0v"))
    met = pairs.join(u, "u").join(v, "v").withColumn("excess", F.col("\0v") - F.col("\0u") - F.col("w"))
    return met.where("excess > 0").select("u", "v", "w", "excess")


def label(bound, path) -> F.Column:
    """A bound with its path; of equal bounds the shorter path counts, then the smaller one."""
    return F.struct(bound.alias("d"), F.size(path).alias("n"), path.alias("p"))


def lowered(met: DataFrame) -> DataFrame:
    """Nodes after an offer ``new`` (a label or null): a lower bound is taken, with the path to it, and judged."""
    better = (F.col("state") == FITS) & F.col("new").isNotNull() & (F.col("new.d") < F.col("label.d"))
    again = F.array_contains(F.col("new.p"), F.col("node"))
    state = F.when(again, CYCLE).when(F.col("new.d") < F.col("lo"), PINNED).otherwise(FITS)
    grown = label(F.col("new.d"), F.concat(F.col("new.p"), F.array("node")))
    return met.select("node", "source", "seq", "lo", F.when(better, state).otherwise(F.col("state")).alias("state"), F.when(better, grown).otherwise(F.col("label")).alias("label"), F.when(better, F.lit(1)).otherwise(F.lit(0)).alias("moved"))


def scanned(nodes: DataFrame, sources: DataFrame, width: int) -> DataFrame:
    """``nodes`` with the lowest label of the fitting ``sources`` that come after each in its source. Series are cut into
    buckets of numbers; what comes from later buckets is one row a bucket."""
    ours = sources.where(F.col("state") == FITS).select("source", "seq", F.lit(None).cast("long").alias("\0lo"), F.col("label").alias("\0l"), F.lit(None).cast(nodes.select(F.struct(*nodes.columns)).schema[0].dataType).alias("\0node"))
    asked = nodes.select("source", "seq", F.col("lo").alias("\0lo"), F.lit(None).cast(sources.schema["label"].dataType).alias("\0l"), F.struct(*nodes.columns).alias("\0node"))
    rows = with_bucket(ours.unionByName(asked), "seq", width, "\0b")
    cut, before = ["source", "\0b"], lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    mins = rows.groupBy(*cut).agg(F.min("\0l").alias("\0m"))
    mins = mins.select(*cut, F.min("\0m").over(before(Window.partitionBy("source").orderBy(F.desc("\0b")))).alias("\0far"))
    # A node's own label ties with no later one: it isn't lower than itself.
    own = F.min("\0l").over(before(Window.partitionBy(*cut).orderBy(F.desc("seq"), F.col("\0node").isNotNull())))
    met = rows.withColumn("\0own", own).where(F.col("\0node").isNotNull()).join(mins, cut)
    return met.select("`\0node`.*", F.least("\0own", "\0far").alias("new"))


def conflicts(nodes: DataFrame, pairs: DataFrame, width: int = 100_000, rounds: int = 1_000) -> DataFrame:
    """(node, state, bound, lo, path) of all nodes whose constraints can't be met: none if and only if times exist that fit.

    nodes: (node, source, seq, lo, hi), unique by node and by (source, seq); pairs: (u, v, w) for t[v] - t[u] <= w. state:
    PINNED (the bound at the end of the path is under lo) or CYCLE (the path comes back to the node with a lower bound).
    path: from the node whose hi it starts with. A node in conflict keeps its first witness and passes nothing on, so the
    rest is judged without it. Loops of a node with w < 0 are cycles; pairs with a null or an unknown end say nothing."""
    scratch = Scratch(nodes.sparkSession)
    ends = scratch.put("pairs", pairs.where("u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL").groupBy("u", "v").agg(F.min("w").alias("w")))
    start = nodes.select("node", "source", "seq", "lo", F.when(F.col("hi") < F.col("lo"), PINNED).otherwise(FITS).alias("state"), label(F.col("hi"), F.array("node")).alias("label"))
    first = scratch.put("first", lowered(scanned(start, start, width)).drop("moved"))
    knots = ends.select(F.col("u").alias("node")).unionByName(ends.select(F.col("v").alias("node"))).distinct()
    held = scratch.put("held", first.join(knots, "node", "left_semi"))
    for _ in range(rounds):
        sent = ends.join(held.where(F.col("state") == FITS).select(F.col("node").alias("u"), F.col("label").alias("\0l")), "u")
        offers = sent.groupBy(F.col("v").alias("node")).agg(F.min(label(F.col("\0l.d") + F.col("w"), F.col("\0l.p"))).alias("new"))
        relaxed = scratch.put("relaxed", lowered(held.join(offers, "node", "left")))
        if not relaxed.where("moved = 1").limit(1).count():
            break
        relaxed = relaxed.drop("moved")
        held = scratch.put("held", lowered(scanned(relaxed, relaxed, width)).drop("moved"))
    else:
        raise RuntimeError(f"bounds still fall after {rounds} rounds")
    # The rest lies between knots: one more scan gives its bounds.
    rest = lowered(scanned(first.join(knots, "node", "left_anti"), held, width)).drop("moved")
    every = held.unionByName(rest).where(F.col("state") != FITS)
    out = written(every.select("node", "state", F.col("label.d").alias("bound"), "lo", F.col("label.p").alias("path")))
    scratch.close()
    return out


# --- fewest records to repair -------------------------------------------------------------------------------------


def cover(pairs: DataFrame, cap: int = 64) -> DataFrame:
    """(node, exact): a smallest set of nodes that meets all ``pairs`` (u, v).

    A cover of the whole is one of each component. A component of at most ``cap`` nodes goes to a search, which gives the first
    of its smallest covers in order of nodes. A larger one first loses its leaves, whose neighbours go into the cover (as
    small a cover as any, but not the first in order), and falls apart; what is still larger than ``cap`` is covered
    greedily, the node with most open pairs first (exact: false). All nodes that beat their neighbours go at once, which
    chooses what one after another would."""
    from ..functions.repair import vertex_cover

    ship(pairs.sparkSession)
    scratch = Scratch(pairs.sparkSession)
    edges = scratch.put("edges", pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    kind, done = edges.schema["u"].dataType.simpleString(), []

    def search(frame):
        import pandas as pd

        chosen, exact = vertex_cover(list(zip(frame["u"].tolist(), frame["v"].tolist())), cap)
        return pd.DataFrame({"node": chosen, "exact": exact})

    def split(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of small components with their component, and those of large ones."""
        named = components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
        sized = named.groupBy("component").agg((F.count("*") <= cap).alias("\0small"))
        met = written(edges.join(named.withColumnRenamed("node", "u"), "u").join(sized, "component"))
        return met.where("`\0small`").select("component", "u", "v"), scratch.put("edges", met.where("NOT `\0small`").select("u", "v"))

    small, large = split(edges)
    done.append(written(small.groupBy("component").applyInPandas(search, f"node {kind}, exact boolean")))
    shed = False
    while not large.isEmpty():
        leaves = ends(large).groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("other")).where("n = 1")
        # Of two leaves that are a pair the smaller one goes in.
        taken = leaves.join(leaves.select(F.col("node").alias("other"), F.lit(True).alias("\0pair")), "other", "left")
        taken = written(taken.select(F.when(F.col("\0pair"), F.least("node", "other")).otherwise(F.col("other")).alias("node")).distinct())
        if taken.isEmpty():
            break
        shed = True
        done.append(taken.withColumn("exact", F.lit(True)))
        large = scratch.put("edges", without(large, taken))
    if shed and not large.isEmpty():
        small, large = split(large)
        done.append(written(small.groupBy("component").applyInPandas(search, f"node {kind}, exact boolean")))
    while not large.isEmpty():
        degree = written(ends(large).groupBy("node").agg(F.count("*").alias("n")))
        rank = degree.select("node", F.struct(-F.col("n"), F.col("node")).alias("\0r"))
        beside = ends(large).join(rank.select(F.col("node").alias("other"), F.col("\0r").alias("\0o")), "other").groupBy("node").agg(F.min("\0o").alias("\0o"))
        taken = written(beside.join(rank, "node").where("`\0r` < `\0o`").select("node"))
        done.append(taken.withColumn("exact", F.lit(False)))
        large = scratch.put("edges", without(large, taken))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    scratch.close()
    return out


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("u")), "u", "left_anti").join(nodes.select(F.col("node").alias("v")), "v", "left_anti")
