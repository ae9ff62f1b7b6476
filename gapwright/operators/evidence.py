"""Entity resolution by classes of evidence: what may merge, what may not, and what stays ambiguous.

A binding says that an observation names an identifier, of a kind, for a span of time. ANCHOR identifiers merge on their
own; LINK identifiers only where two of different kinds agree at one time; HINT ones never. Bindings of one identifier
merge only where their spans overlap, so a reused identifier begins anew. A span with a provisional end (its source was
dark) never merges anything.

Merges go in layers: anchors first, then pairs of links over what the anchors made. A merge that would bring together two
values of an exclusive kind is refused, with all of the layer's other merges in that component, since any of them may be
the wrong one: its parts stay apart and are AMBIGUOUS, as are those that only provisional evidence would join. Nothing
hangs on an order of rows. No pairs are made: bindings of an identifier are cut into islands of overlapping spans, and
each is linked with the first of its island; two links that agree are one identifier, held where both spans are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .series import DAY_US, with_bucket

ANCHOR, LINK, HINT = "ANCHOR", "LINK", "HINT"
RESOLVED, AMBIGUOUS, UNRESOLVED = "RESOLVED", "AMBIGUOUS", "UNRESOLVED"


def overlapping(bindings: DataFrame, key: list[str], width: int = DAY_US) -> DataFrame:
    """Links (a, b) from every observation to the first of its island: bindings (obs, t_lo, t_hi) of one ``key`` whose
    half-open spans overlap, in chains. A hot key is cut by time, and the furthest end so far is carried over the cuts."""
    rows = with_bucket(bindings.where("t_lo < t_hi").select(*key, "obs", "t_lo", "t_hi"), "t_lo", width, "\0b")
    cut, before = [*key, "\0b"], lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within, along = Window.partitionBy(*cut).orderBy("t_lo", "obs", "t_hi"), Window.partitionBy(*key).orderBy("\0b")
    ends = rows.groupBy(*cut).agg(F.max("t_hi").alias("\0e")).select(*cut, F.max("\0e").over(before(along)).alias("\0far"))
    reach = F.greatest(F.max("t_hi").over(before(within)), F.col("\0far"))
    opened = rows.join(ends, cut).withColumn("\0opens", F.coalesce(F.col("t_lo") >= reach, F.lit(True)))
    # An island is named by the observation that opens it: the last one that opened, in the bucket or before it.
    opener = F.when(F.col("\0opens"), F.struct("t_lo", "obs"))
    lasts = opened.groupBy(*cut).agg(F.max(opener).alias("\0o")).select(*cut, F.last("\0o", True).over(before(along)).alias("\0held"))
    own = F.last(opener, True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("\0own", own).join(lasts, cut).select(F.col("obs").alias("a"), F.coalesce("\0own", "\0held")["obs"].alias("b"))


def agreeing(bindings: DataFrame) -> DataFrame:
    """Two LINK bindings of different kinds of one observation as one binding (kind, norm, kind2, norm2, obs, t_lo, t_hi,
    provisional), held while both are."""
    links = bindings.where(F.col("class") == LINK)
    other = links.select("obs", F.col("kind").alias("kind2"), F.col("norm").alias("norm2"), F.col("t_lo").alias("\0lo"), F.col("t_hi").alias("\0hi"), F.col("provisional").alias("\0p"))
    met = links.join(other, "obs").where("kind < kind2")
    return met.select("kind", "norm", "kind2", "norm2", "obs", F.greatest("t_lo", "\0lo").alias("t_lo"), F.least("t_hi", "\0hi").alias("t_hi"), (F.col("provisional") | F.col("\0p")).alias("provisional")).where("t_lo < t_hi")


def merged(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """(root, joined): roots of (obs, root) and the component that ``links`` of observations put them in."""
    root = rooted.select(F.col("obs").alias("a"), F.col("root").alias("\0a")), rooted.select(F.col("obs").alias("b"), F.col("root").alias("\0b"))
    met = links.join(root[0], "a").join(root[1], "b").where("`\0a` <> `\0b`").select(F.col("\0a").alias("a"), F.col("\0b").alias("b"))
    return components(met).select(F.col("node").alias("root"), F.col("component").alias("joined"))


def conflicting(rooted: DataFrame, bindings: DataFrame, exclusive: list[str], key: str) -> DataFrame:
    """``key`` of the groups with two values of an exclusive kind."""
    named = bindings.where(F.col("kind").isin(exclusive)).select("obs", "kind", "norm").join(rooted, "obs")
    return named.groupBy(key, "kind").agg((F.min("norm") != F.max("norm")).alias("\0two")).where("`\0two`").select(key).distinct()


def resolve(bindings: DataFrame, exclusive: list[str]) -> DataFrame:
    """(obs, entity, status) of all observations of ``bindings`` (obs, kind, norm, class, t_lo, t_hi, provisional).

    entity: the smallest observation that it was merged with. RESOLVED: an anchor, or two links that agree with another
    observation's, and no ambiguity; AMBIGUOUS: a refused or a merely provisional merge touches its entity; UNRESOLVED: nothing
    names it firmly. A row with a null obs, kind or norm says nothing; a null provisional is false, a null span unbounded."""
    held = bindings.where("obs IS NOT NULL AND kind IS NOT NULL AND norm IS NOT NULL").withColumns(
        {"t_lo": F.coalesce("t_lo", F.lit(-(2**62))), "t_hi": F.coalesce("t_hi", F.lit(2**62)), "provisional": F.coalesce("provisional", F.lit(False))}
    )
    held = written(held.select("obs", "kind", "norm", "class", "t_lo", "t_hi", "provisional"))
    every = held.select("obs").distinct()
    anchors, pairs = held.where(F.col("class") == ANCHOR), written(agreeing(held))
    key, key2 = ["kind", "norm"], ["kind", "norm", "kind2", "norm2"]

    # The layer of anchors: observations are their own roots.
    alone = every.select("obs", F.col("obs").alias("root"))
    firm = overlapping(anchors.where("NOT provisional"), key)
    first = alone.join(merged(alone, firm), "root", "left").select("obs", "root", F.coalesce("joined", "root").alias("joined"))
    rooted, doubt1 = settled(written(first), held, exclusive)

    # The layer of links that agree, over the roots of the first.
    agreed = overlapping(pairs.where("NOT provisional"), key2)
    second = rooted.join(merged(rooted, agreed), "root", "left").select("obs", "root", F.coalesce("joined", "root").alias("joined"))
    final, doubt2 = settled(written(second), held, exclusive)

    # What only provisional evidence would join.
    perhaps = overlapping(anchors, key).unionByName(overlapping(pairs, key2)) if held.where("provisional").limit(1).count() else firm.where("false")
    loose = merged(final, perhaps)
    doubt = doubt1.join(final, "obs").select("root").unionByName(doubt2.join(final, "obs").select("root")).unionByName(loose.select("root")).distinct()
    named = anchors.where("NOT provisional").select("obs").unionByName(shared(agreed)).join(final, "obs").select("root").distinct()
    met = final.join(doubt.withColumn("\0d", F.lit(True)), "root", "left").join(named.withColumn("\0n", F.lit(True)), "root", "left")
    status = F.when(F.col("\0d"), AMBIGUOUS).when(F.col("\0n"), RESOLVED).otherwise(UNRESOLVED)
    return met.select("obs", F.col("root").alias("entity"), status.alias("status"))


def shared(links: DataFrame) -> DataFrame:
    """Observations of links with another one."""
    apart = links.where("a <> b")
    return apart.select(F.col("a").alias("obs")).unionByName(apart.select(F.col("b").alias("obs")))


def settled(joined: DataFrame, bindings: DataFrame, exclusive: list[str]) -> tuple[DataFrame, DataFrame]:
    """(obs, root) after a layer of merges (obs, root, joined), and the observations whose merges were refused."""
    refused = conflicting(joined, bindings, exclusive, "joined").withColumn("\0r", F.lit(True))
    judged = written(joined.join(refused, "joined", "left").withColumn("\0r", F.coalesce("\0r", F.lit(False))))
    # Refused parts keep their roots; of a component of one part nothing was merged.
    many = judged.where("`\0r`").groupBy("joined").agg(F.min("root").alias("\0x"), F.max("root").alias("\0y")).where("`\0x` <> `\0y`").select("joined")
    doubt = judged.join(many, "joined", "left_semi").select("obs")
    return judged.select("obs", F.when(F.col("\0r"), F.col("root")).otherwise(F.col("joined")).alias("root")), doubt
