"""Paths along edges with times: what is reached, how soon and in how few steps, and the best few paths.

A path's times rise strictly. Labels go out from all seeds at once, a round for each step, and a label that an earlier
one beats (no more steps and no later arrival) goes, so a seed and a node keep their Pareto front: fewer steps or an
earlier arrival. Rounds are bounded by the steps that are asked for.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, written


def arrivals(edges: DataFrame, seeds: DataFrame, steps: int, until: int | None = None) -> DataFrame:
    """(seed, node, steps, arrival): the Pareto front of every seed and node. edges: (src, dst, t); seeds: (seed, node, t), a
    seed is at its node from t on."""
    if steps < 0:
        raise ValueError("steps below zero")
    ends = edges.select("src", "dst", "t") if until is None else edges.where(F.col("t") <= until).select("src", "dst", "t")
    new = written(seeds.groupBy("seed", "node").agg(F.min("t").alias("arrival")).select("seed", "node", F.lit(0).alias("steps"), "arrival"))
    rounds = [new]
    for n in range(1, steps + 1):
        gone = new.select("seed", F.col("node").alias("src"), "arrival").join(ends, "src").where(F.col("t") > F.col("arrival"))
        found = gone.groupBy("seed", F.col("dst").alias("node")).agg(F.min("t").alias("arrival"))
        known = functools.reduce(DataFrame.unionByName, rounds).groupBy("seed", "node").agg(F.min("arrival").alias("known"))
        new = written(found.join(known, ["seed", "node"], "left").where(F.col("known").isNull() | (F.col("arrival") < F.col("known"))).select("seed", "node", F.lit(n).alias("steps"), "arrival"))
        if new.isEmpty():
            break
        rounds.append(new)
    return functools.reduce(DataFrame.unionByName, rounds)


def blast_radius(front: DataFrame, kinds: DataFrame) -> DataFrame:
    """(seed, steps, kind, n): how many nodes of each kind a seed reaches in that many steps and no fewer, its own not."""
    fewest = front.groupBy("seed", "node").agg(F.min("steps").alias("steps")).where("steps > 0")
    return fewest.join(kinds, "node").groupBy("seed", "steps", "kind").agg(F.count("*").alias("n"))


def best_paths(edges: DataFrame, seeds: DataFrame, k: int, steps: int, least: int = 1) -> DataFrame:
    """(seed, node, place, steps, evidence, path): the first ``k`` paths from every seed to every node, by steps, then by
    evidence (the most first), then by the path. edges: (src, dst, t, evidence), one a pair of nodes; those with less
    evidence than ``least`` are left out. A node may come twice on a path, an edge can't.

    Of the paths to one last edge with as many steps, all but the first ``k`` go at once: whatever follows an edge
    follows each of them, and keeps their order."""
    held = edges.where(F.col("evidence") >= least).select("src", "dst", F.col("t").alias("\0t"), F.col("evidence").alias("\0e"))
    new = seeds.select("seed", "node", "t", F.lit(0).cast("long").alias("evidence"), F.array("node").alias("path"))
    rounds = []
    for n in range(1, steps + 1):
        met = new.withColumnRenamed("node", "src").join(held, "src").where(F.col("\0t") > F.col("t"))
        grown = met.select("seed", F.col("dst").alias("node"), F.col("\0t").alias("t"), (F.col("evidence") + F.col("\0e")).alias("evidence"), F.concat("path", F.array("dst")).alias("path"), "src")
        along = Window.partitionBy("seed", "src", "node").orderBy(F.desc("evidence"), "path")
        new = written(grown.withColumn("\0n", F.row_number().over(along)).where(F.col("\0n") <= k).drop("\0n", "src").withColumn("steps", F.lit(n)))
        if new.isEmpty():
            break
        rounds.append(new)
        new = new.drop("steps")
    if not rounds:
        rounds = [new.withColumn("steps", F.lit(0)).where(F.lit(False))]
    every = functools.reduce(DataFrame.unionByName, rounds)
    order = Window.partitionBy("seed", "node").orderBy("steps", F.desc("evidence"), "path")
    return every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("seed", "node", "place", "steps", "evidence", "path")


# --- two sides, of which one is small -------------------------------------------------------------------------------

#: At most so many hubs, and so many links of hubs that go to every task; seeds of a block (of some); no arrival.
HUBS, LINKS, BLOCK, NEVER = 4096, 1_000_000, 512, (1 << 63) - 1


class Hubs:
    """Edges between spokes and few hubs: every second node of a path is a hub.

    What a seed reaches through a hub hangs on its arrival there alone. So labels are kept on hubs, two steps from hub to hub
    by way of any spoke are made once for all seeds, and spokes meet the seeds' vectors of arrivals at hubs in cells of a
    block of seeds and a part of the spokes: not a row of (seed, spoke) is joined or shuffled. Every seed begins at one spoke."""

    def __init__(self, edges: DataFrame, hub: Callable[[Column], Column], extra: tuple[str, ...] = ()):
        self.edges = written(edges.select("src", "dst", "t", *extra).distinct())
        names = self.edges.select(F.when(hub(F.col("src")), F.col("src")).otherwise(F.col("dst")).alias("hub")).distinct()
        self.count = (names := written(names)).count()
        self.few = self.count <= HUBS
        self.names = names.select("hub", (F.row_number().over(Window.orderBy("hub")) - 1).alias("place")) if self.few else names
        self.out = self.edges.where(hub(F.col("dst"))).select(F.col("src").alias("spoke"), F.col("dst").alias("hub"), "t", *extra)
        self.back = self.edges.where(hub(F.col("src"))).select(F.col("dst").alias("spoke"), F.col("src").alias("hub"), "t", *extra)
        self.parts = max(8, 4 * edges.sparkSession.sparkContext.defaultParallelism)

    def first(self, seeds: DataFrame, *extra: str) -> DataFrame:
        """(seed, start, hub, t): the first step of every seed to each of its hubs."""
        begun = seeds.select("seed", F.col("node").alias("start"), F.col("t").alias("\0t"))
        return begun.join(self.out, F.col("start") == F.col("spoke")).where("t > `\0t`").select("seed", "start", "hub", "t", *extra)

    def pairs(self, *extra: Column) -> DataFrame:
        """(hub, spoke, d, to, t): from a hub by a spoke to a hub, leaving at d and arriving at t."""
        onward = self.out.select("spoke", F.col("hub").alias("to"), *[F.col(c).alias(f"\0{c}") for c in self.out.columns if c not in ("spoke", "hub")])
        return self.back.join(onward, "spoke").where("`\0t` > t").select("hub", "spoke", F.col("t").alias("d"), "to", F.col("\0t").alias("t"), *extra)

    def product(self, seeds: DataFrame, cells: DataFrame, values: list[str], entry: tuple[str, ...], schema: str, meet: Callable) -> DataFrame:
        """What ``meet`` makes of each block of seeds and each part of the spokes; cells: (seed, hub, values).

        It is given the seeds (seed, start), for each of ``values`` a matrix of hubs and seeds (NEVER: none), and the spokes
        with the edges that come in at each, in order of time: (t, the hub's place, ``entry``)."""
        ship(self.edges.sparkSession)
        blocks, parts, n = -(-max(seeds.count(), 1) // BLOCK), self.parts, self.count
        every = seeds.select("seed", F.col("node").alias("start")).crossJoin(F.broadcast(self.names))
        rows = every.join(cells, ["seed", "hub"], "left").groupBy("seed", "start").agg(F.array_sort(F.collect_list(F.struct("place", *[F.coalesce(v, F.lit(NEVER)).alias(v) for v in values]))).alias("\0v"))
        vectors = rows.select("seed", "start", *[F.col(f"`\0v`.{v}") for v in values], F.pmod(F.xxhash64("seed"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        ins = self.back.join(F.broadcast(self.names), "hub").groupBy("spoke").agg(F.array_sort(F.collect_list(F.struct("t", "place", *entry))).alias("ins"))
        ins = ins.select("spoke", "ins", F.pmod(F.xxhash64("spoke"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

        def run(left, right):
            import numpy as np

            shape = (left.num_rows, n)
            matrices = [np.ascontiguousarray(left[v].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(shape).T) for v in values]
            return meet(left, matrices, right["spoke"], right["ins"].to_pylist())

        return vectors.groupBy("block", "part").cogroup(ins.groupBy("block", "part")).applyInArrow(run, schema)


def soonest(matrices: list, starts: list, spokes: list, ins: list):
    """For each matrix of arrivals at hubs, when each seed gets to each spoke (spokes, seeds); a start isn't got to."""
    import numpy as np

    own: dict = {}
    for at, start in enumerate(starts):
        own.setdefault(start, []).append(at)
    found = [np.full((len(spokes), len(starts)), NEVER, np.int64) for _ in matrices]
    for u, (spoke, edges) in enumerate(zip(spokes, ins)):
        for edge in reversed(edges):
            for m, out in zip(matrices, found):
                out[u][m[edge["place"]] < edge["t"]] = edge["t"]
        for out in found:
            out[u, own.get(spoke, [])] = NEVER
    return found


def fronts(edges: DataFrame, seeds: DataFrame, steps: int, hub: Callable[[Column], Column], counted: bool = False) -> DataFrame:
    """What ``arrivals`` gives, for edges between spokes and hubs. ``counted``: (seed, steps, kind, n) as in ``blast_radius``
    instead, kinds are hub and spoke. Where hubs aren't few, ``arrivals`` itself goes to work."""
    if steps < 0:
        raise ValueError("steps below zero")
    held = Hubs(edges, hub)
    start = written(seeds.groupBy("seed", "node").agg(F.min("t").alias("t")))
    if not held.few or steps == 0:
        front = arrivals(edges, start, steps)
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        return blast_radius(front, nodes.withColumn("kind", F.when(hub(F.col("node")), "hub").otherwise("spoke"))) if counted else front
    own = start.select("seed", "node", F.lit(0).alias("steps"), F.col("t").alias("arrival"))
    new = written(held.first(start).groupBy("seed", "hub").agg(F.min("t").alias("arrival")).select("seed", "hub", F.lit(1).alias("steps"), "arrival"))
    rounds, links = [new], None
    for n in range(3, steps + 1, 2):
        if links is None:
            # A link goes if a later one arrives no later.
            later = Window.partitionBy("hub", "to").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
            links = held.pairs().groupBy("hub", "to", "d").agg(F.min("t").alias("t")).withColumn("\0next", F.min("t").over(later))
            links = written(links.where("`\0next` IS NULL OR t < `\0next`").drop("\0next"))
        asked = new.crossJoin(F.broadcast(held.names.select(F.col("hub").alias("to")))).select("hub", "to", F.col("arrival").alias("d"), F.lit(None).cast(links.schema["t"].dataType).alias("t"), "seed")
        both = asked.unionByName(links.withColumn("seed", F.lit(None).cast(new.schema["seed"].dataType)))
        # Of equal times the label comes before the link: a step takes time.
        along = Window.partitionBy("hub", "to").orderBy(F.desc("d"), F.col("seed").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("t", F.min("t").over(along)).where("seed IS NOT NULL AND t IS NOT NULL").groupBy("seed", F.col("to").alias("hub")).agg(F.min("t").alias("arrival"))
        known = functools.reduce(DataFrame.unionByName, rounds).groupBy("seed", "hub").agg(F.min("arrival").alias("known"))
        new = written(found.join(known, ["seed", "hub"], "left").where("known IS NULL OR arrival < known").select("seed", "hub", F.lit(n).alias("steps"), "arrival"))
        rounds.append(new)
    labels = functools.reduce(DataFrame.unionByName, rounds)
    if counted:
        fewest = labels.groupBy("seed", "hub").agg(F.min("steps").alias("steps"))
        out = fewest.groupBy("seed", "steps", F.lit("hub").alias("kind")).agg(F.count("*").alias("n"))
    else:
        out = own.unionByName(labels.withColumnRenamed("hub", "node"))
    odd = list(range(1, steps, 2))
    if not odd:
        return out
    names = out.columns
    cells = labels.groupBy("seed", "hub").agg(*[F.min(F.when(F.col("steps") <= n, F.col("arrival"))).alias(f"v{n}") for n in odd])

    def meet(left, matrices, spokes, ins):
        import numpy as np
        import pyarrow as pa

        found, seen, parts = soonest(matrices, left["start"].to_pylist(), spokes.to_pylist(), ins), NEVER, []
        for n, at in zip(odd, found):
            new = (at < NEVER) & (seen == NEVER) if counted else at < seen
            if counted:
                many = new.sum(axis=0)
                who = np.flatnonzero(many)
                columns = [left["seed"].take(pa.array(who)), pa.array(np.full(len(who), n + 1, np.int32)), pa.array(["spoke"] * len(who), pa.string()), pa.array(many[who].astype(np.int64))]
            else:
                node, who = np.nonzero(new)
                columns = [left["seed"].take(pa.array(who)), spokes.take(pa.array(node)), pa.array(np.full(len(who), n + 1, np.int32)), pa.array(at[node, who])]
            parts.append(pa.table(columns, names=names))
            seen = np.minimum(seen, at)
        return pa.concat_tables(parts)

    kinds = {f.name: f.dataType.simpleString() for f in start.schema.fields}
    schema = f"seed {kinds['seed']}, steps int, kind string, n long" if counted else f"seed {kinds['seed']}, node {kinds['node']}, steps int, arrival long"
    met = held.product(start, cells, [f"v{n}" for n in odd], (), schema, meet)
    return out.unionByName(met.groupBy("seed", "steps", "kind").agg(F.sum("n").alias("n")) if counted else met)


def best_by_hubs(edges: DataFrame, seeds: DataFrame, k: int, hub: Callable[[Column], Column]) -> DataFrame:
    """What ``best_paths`` gives for three steps, for edges between spokes and hubs.

    Of the links from hub to hub one goes if ``k`` better ones leave no sooner: whoever can take it can take those. Kept are
    the first ``k`` layers of links that no other link outdoes, which hold all that fewer than ``k`` outdo."""
    held = Hubs(edges, hub, ("evidence",))
    if not held.few:
        return best_paths(edges, seeds, k, 3)
    start = written(seeds.select("seed", "node", "t"))
    one = written(held.first(start, "evidence"))
    rank = F.struct((-F.col("evidence")).alias("e"), "spoke")
    before = Window.partitionBy("hub", "to").orderBy(F.desc("d"), F.desc("evidence"), "spoke").rowsBetween(Window.unboundedPreceding, -1)
    links = held.pairs((F.col("evidence") + F.col("\0evidence")).alias("evidence")).withColumn("\0kept", F.lit(False))
    for _ in range(k):
        links = links.withColumn("\0best", F.min(F.when(~F.col("\0kept"), rank)).over(before))
        links = links.withColumn("\0kept", F.col("\0kept") | F.coalesce(rank < F.col("\0best"), F.lit(True)))
    links = written(links.where("`\0kept`").select("hub", "to", "d", F.col("evidence").alias("\0e"), F.col("spoke").alias("via")))
    links = F.broadcast(links) if links.count() <= LINKS else links
    three = one.repartition(held.parts, "seed").join(links, "hub").where("d > t").select("seed", F.col("to").alias("node"), F.lit(3).alias("steps"), (F.col("evidence") + F.col("\0e")).alias("evidence"), "start", "hub", "via")
    direct = one.select("seed", F.col("hub").alias("node"), F.lit(1).alias("steps"), "evidence", "start", "hub", F.lit(None).cast(three.schema["via"].dataType).alias("via"))
    order = Window.partitionBy("seed", "node").orderBy(F.desc("evidence"), "hub", "via")
    three = three.withColumn("\0n", F.row_number().over(order)).where(F.col("\0n") <= k).drop("\0n")
    order = Window.partitionBy("seed", "node").orderBy("steps", F.desc("evidence"), "hub", "via")
    ends = direct.unionByName(three).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    ends = ends.select("seed", "node", "place", "steps", "evidence", F.when(F.col("steps") == 1, F.array("start", "node")).otherwise(F.array("start", "hub", "via", "node")).alias("path"))
    cells = one.select("seed", "hub", "t", "evidence")

    def meet(left, matrices, spokes, ins):
        import numpy as np
        import pyarrow as pa

        (times, counts), parts = matrices, []
        for u, edges in enumerate(ins):
            edges = sorted(edges, key=lambda e: e["place"])
            at = np.array([e["place"] for e in edges])
            able = times[at] < np.array([e["t"] for e in edges])[:, None]
            total = np.where(able, counts[at] + np.array([e["evidence"] for e in edges])[:, None], 0)
            order = np.argsort(-total, axis=0, kind="stable")[:k]
            n, who = np.nonzero(np.take_along_axis(able, order, 0))
            parts.append((who, np.full(len(who), u), at[order[n, who]], n + 1, total[order[n, who], who]))
        who, u, hubs, place, total = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
        return pa.table([left["seed"].take(pa.array(who)), left["start"].take(pa.array(who)), spokes.take(pa.array(u)), pa.array(hubs.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total.astype(np.int64))], names=["seed", "start", "spoke", "hub_place", "place", "evidence"])

    kinds = {f.name: f.dataType.simpleString() for f in start.schema.fields}
    schema = f"seed {kinds['seed']}, start {kinds['node']}, spoke {kinds['node']}, hub_place int, place int, evidence long"
    two = held.product(start, cells, ["t", "evidence"], ("evidence",), schema, meet)
    two = two.join(F.broadcast(held.names.select("hub", F.col("place").alias("hub_place"))), "hub_place")
    return ends.unionByName(two.select("seed", F.col("spoke").alias("node"), "place", F.lit(2).alias("steps"), "evidence", F.array("start", "hub", "spoke").alias("path")))
