"""Arrival profiles and timelines: when a source was LIVE, BLIND or SUPPRESSED, and what blindness licenses.

All instants are whole numbers (microseconds or nanoseconds, as the caller has them), all thresholds exact ratios.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arithmetic import scaled_threshold
from ..session import written
from .series import as_of, islands, prefix_sum, with_bucket, with_neighbours

#: Verdicts, reasons and modes, as results show them.
LIVE, BLIND, SUPPRESSED = "LIVE", "BLIND", "SUPPRESSED"
NONE, SEQUENCED, CHAINED = "NONE", "SEQUENCED", "CHAINED"
LIVE_REASON = "L_CALIBRATED_OK"


@dataclass(frozen=True)
class LivenessConfig:
    """quantile p/q of gaps, slack num/den, least samples, least records in a window."""

    p: int = 95
    q: int = 100
    slack_num: int = 3
    slack_den: int = 2
    k_tail: int = 5
    n_floor: int = 30
    m_min: int = 2

    @property
    def n_min(self) -> int:
        return max(self.n_floor, -(-self.k_tail * self.q // (self.q - self.p)))


def gaps(events: DataFrame, order: list[str], key: str = "source", t: str = "t", width: int = 86_400_000_000) -> DataFrame:
    """(key, order..., t, prev_t, gap): differences of time of neighbours; negative where time runs back."""
    near = with_neighbours(events, [key], order, [t], width)
    return near.where(F.col(f"prev_{t}").isNotNull()).withColumn("gap", F.col(t) - F.col(f"prev_{t}"))


def rank_statistic(values: DataFrame, keys: list[str], value: str, p: int, q: int) -> DataFrame:
    """(keys, n, exact order statistic at rank ceil(n * p / q) within 1..n, least, greatest), without collecting a group.

    Counts of distinct values are summed along the order of values; the statistic is the first whose running count
    reaches the rank. Values of a hot key are pre-aggregated, then summed in buckets of the value."""
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("c"))
    total = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    total = total.withColumn("rank", F.greatest(F.least(F.expr(f"(n * {p} + {q - 1}) div {q}"), F.col("n")), F.lit(1)))
    spread = counts.join(total, keys)
    cut = spread.withColumn("bucket", F.when(F.col("greatest") == F.col("least"), F.lit(0)).otherwise(F.floor((F.col(value) - F.col("least")).cast("double") * 64 / (F.col("greatest") - F.col("least")).cast("double"))))
    sums = cut.groupBy(*keys, "bucket").agg(F.sum("c").alias("b"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base"))
    run = F.sum("c").over(Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    reached = cut.withColumn("run", run).join(sums, [*keys, "bucket"]).where(F.col("base") + F.col("run") >= F.col("rank"))
    return reached.groupBy(*keys).agg(F.first("n").alias("n_gaps"), F.min(value).alias("order_statistic"), F.first("least").alias("min_gap"), F.first("greatest").alias("max_gap"))


def gap_profile(events: DataFrame, order: list[str], config: LivenessConfig = LivenessConfig(), keys: list[str] | None = None, key: str = "source", t: str = "t") -> DataFrame:
    """One row for each key (and regime, where ``keys`` has one): n_gaps, order statistic, extremes and threshold.
    The threshold is null where there are fewer than n_min gaps."""
    found = rank_statistic(gaps(events, order, key, t), keys or [key], "gap", config.p, config.q)
    return with_threshold(found, config).drop("overflow")


def with_threshold(profile: DataFrame, config: LivenessConfig) -> DataFrame:
    """Adds ``threshold``, the order statistic times the slack, rounded up, where there are n_min gaps, and ``overflow``: it
    doesn't fit 64 bits. The product is exact; a threshold that doesn't fit is null and never wraps."""
    limit, _ = scaled_threshold("order_statistic", config.slack_num, config.slack_den)
    enough = F.coalesce(F.col("n_gaps") >= config.n_min, F.lit(False))
    return profile.withColumns({"overflow": enough & limit.isNull(), "threshold": F.when(enough, limit)})


def gap_digest(events: DataFrame, order: list[str], width: int, key: str = "source", t: str = "t") -> DataFrame:
    """(key, digest) of the whole vector of gaps: SHA-256 over the digests of its stretches of ``width``, each over its
    distinct gaps and their counts in ascending order, so no task holds the vector of a source."""
    counts = gaps(events, order, key, t).groupBy(key, "gap").agg(F.count("*").alias("c"))
    cut = with_bucket(counts, "gap", width, "part")
    text = lambda x: F.concat(x["gap"].cast("string"), F.lit(":"), x["c"].cast("string"))
    listed = lambda rows, of: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), of), ",")
    parts = cut.groupBy(key, "part").agg(F.sha2(listed(F.struct("gap", "c"), text), 256).alias("d"))
    return parts.groupBy(key).agg(F.sha2(listed(F.struct("part", "d"), lambda x: x["d"]), 256).alias("digest"))


def ladder(threshold: Column, left: Column, right: Column, in_span: Column, widest: Column, mode: Column, missing: Column, chain_ok: Column, regime_known: Column, m_min: int, no_profile: Column | None = None, overflow: Column | None = None) -> Column:
    """(verdict, reason) of a window: the first rung that holds. Only the last one makes LIVE."""
    no_profile, overflow = (F.lit(False) if c is None else c for c in (no_profile, overflow))
    rungs = [
        (no_profile, BLIND, "B_FORCED_NO_PROFILE_MODE"), (~regime_known, BLIND, "B_REGIME_UNKNOWN"), (threshold.isNull(), BLIND, "B_PROFILE_INSUFFICIENT"),
        (overflow, BLIND, "B_THRESHOLD_OVERFLOW"), (~chain_ok, BLIND, "B_CHAIN_UNVERIFIED"),
        (missing & (mode == CHAINED), SUPPRESSED, "S_CHAIN_SEQ_GAP"), (missing & (mode == SEQUENCED), SUPPRESSED, "S_SEQ_GAP_UNAUTHENTICATED"),
        (left.isNull() | right.isNull(), BLIND, "B_UNBRACKETED"), (in_span < m_min, BLIND, "B_WINDOW_UNDERSAMPLED"), (widest > threshold, BLIND, "B_GAP_EXCEEDS_THRESHOLD"),
    ]
    pick = lambda v, r: F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("reason"))
    out = None
    for holds, verdict, reason in rungs:
        holds = F.coalesce(holds, F.lit(False))
        out = F.when(holds, pick(verdict, reason)) if out is None else out.when(holds, pick(verdict, reason))
    return out.otherwise(pick(LIVE, LIVE_REASON))


def timeline(events: DataFrame, profile: DataFrame, t0: Column, t1: Column, config: LivenessConfig = LivenessConfig(), key: str = "source", t: str = "t", mode: Column | None = None, seq: str | None = "seq") -> DataFrame:
    """Islands (key, t0, t1, verdict, reason) over [t0, t1): the grid is the events' own times and the two ends.

    Between neighbours in time the bracket is the two records themselves. Before the first and from the last record on
    a window has one bracket only. ``profile`` (a row for each key) is a dimension: its size is the number of sources."""
    mode = F.lit(SEQUENCED) if mode is None else mode
    values = [t] + ([seq] if seq else [])
    at = events.groupBy(key, t).agg(*([F.max(seq).alias(seq), F.min(seq).alias("first_seq"), F.count("*").alias("at_once")] if seq else [F.count("*").alias("at_once")]))
    near = with_neighbours(at, [key], [t], values + (["first_seq"] if seq else []), ahead=True)
    lone = F.lit(False) if not seq else F.coalesce(F.col("next_first_seq") > F.col(seq) + 1, F.lit(False))
    after = near.select(key, F.col(t).alias("t0"), F.coalesce(F.col(f"next_{t}"), t1).alias("t1"), F.col(t).alias("left"), F.col(f"next_{t}").alias("right"), lone.alias("missing"), F.lit(2).alias("in_span"))
    first = at.groupBy(key).agg(F.min(t).alias("right")).select(key, t0.alias("t0"), F.col("right").alias("t1"), F.lit(None).cast("long").alias("left"), "right", F.lit(False).alias("missing"), F.lit(0).alias("in_span"))
    grid = first.unionByName(after).where("t0 < t1").join(profile.select(key, "threshold"), key, "left")
    rung = ladder(F.col("threshold"), F.col("left"), F.col("right"), F.col("in_span"), F.col("right") - F.col("left"), mode, F.col("missing"), F.lit(True), F.lit(True), config.m_min)
    # Islands read their input several times: it is written once, a slim row for each pair of neighbours.
    judged = written(grid.withColumn("j", rung).select(key, "t0", "t1", "j.verdict", "j.reason"))
    return islands(judged, [key], "t0", "t1", ["verdict", "reason"]).select(key, "t0", "t1", "verdict", "reason", "parts")


def regime_timeline(events: DataFrame, profile: DataFrame, phases: list[tuple[str, int, int]], t0: int, t1: int, config: LivenessConfig = LivenessConfig(), key: str = "source", t: str = "t", seq: str = "seq", modes: dict[str, str] | None = None, declared: dict[str, int] | None = None, broken: tuple[str, ...] = (), unprofiled: tuple[str, ...] = ()) -> DataFrame:
    """As ``timeline``, with thresholds by regime: the grid has the bounds of the phases (regime, from, to) too, and a window
    takes the threshold of (key, regime) in ``profile`` (n_gaps, threshold, overflow), or, where there are too few gaps, the
    period declared for the key. ``broken``: keys whose chain doesn't verify; ``unprofiled``: keys that are to run without
    a profile. Phases, modes and periods are declared dimensions."""
    at = events.groupBy(key, t).agg(F.max(seq).alias(seq), F.min(seq).alias("first_seq"))
    near = with_neighbours(at, [key], [t], [t, "first_seq"], ahead=True)
    missing = F.coalesce(F.col("next_first_seq") > F.col(seq) + 1, F.lit(False))
    after = near.select(key, F.greatest(F.col(t), F.lit(t0)).alias("t0"), F.least(F.coalesce(F.col(f"next_{t}"), F.lit(t1)), F.lit(t1)).alias("t1"), F.col(t).alias("left"), F.col(f"next_{t}").alias("right"), missing.alias("missing"), F.lit(2).alias("in_span"))
    first = at.groupBy(key).agg(F.min(t).alias("right")).select(key, F.lit(t0).cast("long").alias("t0"), F.least(F.col("right"), F.lit(t1)).alias("t1"), F.lit(None).cast("long").alias("left"), "right", F.lit(False).alias("missing"), F.lit(0).alias("in_span"))
    grid = first.unionByName(after).where("t0 < t1")
    bounds = sorted({x for _, a, b in phases for x in (a, b)})
    inner = F.filter(F.array(*[F.lit(x).cast("long") for x in bounds]), lambda x: (x > F.col("t0")) & (x < F.col("t1")))
    edges = F.concat(F.array("t0"), inner, F.array("t1"))
    pieces = grid.withColumn("edges", edges).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)))
    pieces = pieces.withColumns({"t0": F.element_at("edges", F.col("k")), "t1": F.element_at("edges", F.col("k") + 1)})
    regime = F.lit(None).cast("string")
    for name, a, b in phases:
        regime = F.when((F.col("t0") >= a) & (F.col("t0") < b), F.lit(name)).otherwise(regime)
    known = F.broadcast(profile.select(key, "regime", "threshold", "overflow"))  # a row for each source and regime
    pieces = pieces.withColumn("regime", regime).join(known, [key, "regime"], "left")
    of = lambda values, default: F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(key)], default) if values else default
    threshold = F.when(F.coalesce("overflow", F.lit(False)), F.lit(None)).otherwise(F.coalesce("threshold", of(declared or {}, F.lit(None)).cast("long")))
    spilled = F.coalesce("overflow", F.lit(False))
    rung = ladder(F.when(spilled, F.lit(0)).otherwise(threshold), F.col("left"), F.col("right"), F.col("in_span"), F.col("right") - F.col("left"), of(modes or {}, F.lit(SEQUENCED)), F.col("missing"), ~F.col(key).isin(*broken) if broken else F.lit(True), F.col("regime").isNotNull(), config.m_min, F.col(key).isin(*unprofiled) if unprofiled else None, spilled)
    judged = written(pieces.withColumn("j", rung).select(key, "t0", "t1", "j.verdict", "j.reason"))
    return islands(judged, [key], "t0", "t1", ["verdict", "reason"]).select(key, "t0", "t1", "verdict", "reason", "parts")


def blind_runs(line: DataFrame, key: str = "source", merge_reasons: bool = False) -> DataFrame:
    """Non-LIVE runs, merged by verdict and reason, or across reasons."""
    dark = line.where(F.col("verdict") != LIVE).select(key, "t0", "t1", "verdict", "reason")
    return islands(dark, [key], "t0", "t1", [] if merge_reasons else ["verdict", "reason"])


def volumes(line: DataFrame, key: str = "source") -> DataFrame:
    """Time by verdict and reason."""
    return line.groupBy(key, "verdict", "reason").agg(F.sum(F.col("t1") - F.col("t0")).alias("volume"), F.count("*").alias("islands"))


def weakest_mode(sources: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The weakest integrity class, of all sources or by keys: NONE, then SEQUENCED, then CHAINED."""
    order = F.create_map(*[x for k, m in enumerate((NONE, SEQUENCED, CHAINED)) for x in (F.lit(m), F.lit(k))])
    return sources.groupBy(*(keys or [])).agg(F.min_by("integrity", order[F.col("integrity")]).alias("weakest"))


def live_share(line: DataFrame, keys: list[str]) -> DataFrame:
    """LIVE time per mille of all time, rounded down."""
    span = F.col("t1") - F.col("t0")
    sums = line.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("verdict") == LIVE, span)), F.lit(0)).alias("live"), F.sum(span).alias("total"))
    return sums.withColumn("per_mille", F.expr("(live * 1000) div total"))


def joint_windows(line: DataFrame, sources: list[str], key: str = "source", verdict: str = LIVE, negate: bool = True) -> DataFrame:
    """Maximal windows in which every one of ``sources`` is not LIVE (or is, where negate is false).

    Ends of runs are +1 and -1 in one order; a window is open while the sum is the number of sources. Runs of a source
    are merged first, so none touches the next."""
    dark = (F.col("verdict") != verdict) if negate else (F.col("verdict") == verdict)
    runs = islands(line.where(dark & F.col(key).isin(*sources)).select(key, "t0", "t1"), [key], "t0", "t1", [])
    ends = runs.select(F.explode(F.array(F.struct(F.col("t0").alias("t"), F.lit(1).alias("d")), F.struct(F.col("t1").alias("t"), F.lit(-1).alias("d")))).alias("e")).select("e.*")
    steps = ends.groupBy("t").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("all", F.lit(1))
    depth = prefix_sum(steps, "all", "t", "d", "depth")
    near = with_neighbours(depth.select("all", "t", "depth"), ["all"], ["t"], ["t"], ahead=True)
    return near.where(F.col("depth") == len(sources)).select(F.col("t").alias("t0"), F.col("next_t").alias("t1"))


def shares(windows: DataFrame, line: DataFrame, window_id: str = "window_id", key: str = "source") -> DataFrame:
    """Windows (window_id, source, w0, w1) with ``live`` and ``dark``: how much of each its source's islands cover as LIVE and
    as anything else. What no island covers is neither."""
    span = F.col("t1") - F.col("t0")
    line = line.select(key, "t0", "t1", "verdict", F.when(F.col("verdict") == LIVE, span).otherwise(F.lit(0)).alias("live"), F.when(F.col("verdict") != LIVE, span).otherwise(F.lit(0)).alias("dark"))
    # LIVE and dark time before each island; then a window's is the difference of what its two ends have before them.
    sums = prefix_sum(prefix_sum(line, key, "t0", "live", "sum_live"), key, "t0", "dark", "sum_dark")
    sums = written(sums.select(key, F.col("t0").alias("at"), "t1", "live", "dark", (F.col("sum_live") - F.col("live")).alias("live_before"), (F.col("sum_dark") - F.col("dark")).alias("dark_before")))
    windows = windows.select(window_id, key, "w0", "w1")
    ends = windows.select(window_id, key, "w0", "w1", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("w0").alias("at")), F.struct(F.lit(1).alias("sign"), F.col("w1").alias("at")))).alias("e")).select(window_id, key, "w0", "w1", "e.*")
    ends = as_of(ends, sums, [key], "at", ["t1", "live", "dark", "live_before", "dark_before"])
    inside = F.least(F.col("at"), F.col("as_of_t1")) - F.col("as_of_at")
    upto = lambda kind: F.coalesce(F.col(f"as_of_{kind}_before") + F.when(F.col(f"as_of_{kind}") > 0, inside).otherwise(F.lit(0)), F.lit(0))
    return ends.groupBy(window_id, key, "w0", "w1").agg(F.sum(F.col("sign") * upto("live")).alias("live"), F.sum(F.col("sign") * upto("dark")).alias("dark"))


def coverage(windows: DataFrame, line: DataFrame, sources: int, window_id: str = "window_id", key: str = "source") -> DataFrame:
    """For windows (window_id, source, w0, w1), a row for each source that must be asked: is it wholly LIVE, wholly not?

    A window is met by the overlaps of its source's islands; holes and empty windows count as neither. The status of a
    window over all its sources: all wholly LIVE gives OBSERVED, none wholly LIVE gives LICENSED, else UNDETERMINED."""
    per, span = shares(windows, line, window_id, key), F.col("w1") - F.col("w0")
    per = per.withColumns({"wholly_live": (span > 0) & (F.col("live") == span), "wholly_dark": (span > 0) & (F.col("dark") == span)})
    status = F.when(F.count_if("wholly_live") == sources, "OBSERVED").when(F.count_if("wholly_live") == 0, "LICENSED").otherwise("UNDETERMINED")
    return per.groupBy(window_id).agg(status.alias("status"), (F.count_if("wholly_dark") == sources).alias("licensable"))


def licences(line: DataFrame, mint, key: str = "source") -> DataFrame:
    """Permissions for unseen steps: one for each non-LIVE run. ``mint(kind, *columns)`` makes the id."""
    runs = blind_runs(line, key)
    return runs.select(mint("licence", F.col("verdict"), F.col("reason"), F.col(key), F.col("t0"), F.col("t1")).alias("license_id"), key, "t0", "t1", F.col("verdict").alias("basis"), "reason")


def phase_of(events: DataFrame, phases: DataFrame, t: str = "t") -> DataFrame:
    """Events with the regime of the phase [t0, t1) that holds their time, or null. Phases are a declared dimension."""
    p = F.broadcast(phases.select("regime", F.col("t0").alias("p0"), F.col("t1").alias("p1")))
    return events.join(p, (F.col(t) >= F.col("p0")) & (F.col(t) < F.col("p1")), "left").drop("p0", "p1")


def outside(events: DataFrame, spans: DataFrame, key: str = "source", t: str = "t") -> DataFrame:
    """Events outside the declared spans (key, t0, t1) of their source."""
    s = F.broadcast(spans.select(F.col(key).alias("s_key"), "t0", "t1"))
    return events.join(s, (F.col(key) == F.col("s_key")) & (F.col(t) >= F.col("t0")) & (F.col(t) < F.col("t1")), "left_anti")


def absence_proxy(windows: DataFrame, events: DataFrame, sources: int, window_id: str = "window_id", key: str = "source", t: str = "t") -> DataFrame:
    """(window_id, observed) without a timeline: a window (window_id, source, w0, w1) counts as observed if every source that
    it asks has an event in [w0, w1). The last event before w1 is looked at, so no window meets all events of a source."""
    asked = windows.select(window_id, key, "w0", F.col("w1").alias(t))
    met = as_of(asked, events.select(key, t).distinct(), [key], t, [], strict=True)
    return met.groupBy(window_id).agg((F.count_if(F.col(f"as_of_{t}") >= F.col("w0")) == sources).alias("observed"))


def disputed(licences: DataFrame, disputes: DataFrame, key: str = "source", t: str = "t") -> DataFrame:
    """``licences`` (key, t0, t1, ...) with ``disputed``: an event (key, t) in dispute lies in the closed span [t0, t1]."""
    asked = licences.withColumn(t, F.col("t0"))
    met = as_of(asked, disputes.select(key, t).distinct(), [key], t, [], ahead=True)
    return met.withColumn("disputed", F.coalesce(F.col(f"as_of_{t}") <= F.col("t1"), F.lit(False))).drop(t, f"as_of_{t}")


def issued(windows: DataFrame, line: DataFrame, sources: int, void: DataFrame | None = None, window_id: str = "window_id", key: str = "source") -> DataFrame:
    """(window_id, granted): a licence for a window is issued if every source is not LIVE throughout it, and refused where the
    window is on the list ``void`` (window_id)."""
    granted = coverage(windows, line, sources, window_id, key).select(window_id, F.col("licensable").alias("granted"))
    if void is None:
        return granted
    met = granted.join(void.select(window_id, F.lit(True).alias("void")).distinct(), window_id, "left")
    return met.select(window_id, (F.col("granted") & F.col("void").isNull()).alias("granted"))


def document_flags(line: DataFrame, profile: DataFrame, modes: dict[str, str], key: str = "source") -> DataFrame:
    """One row of flags of a timeline: a source without a threshold, a source that isn't chained, nothing LIVE at all, and a
    profile that has one regime for all."""
    sources = line.select(key).distinct().join(profile.groupBy(key).agg(F.max("threshold").alias("threshold")), key, "left")
    unchained = F.coalesce(F.create_map(*[F.lit(x) for kv in modes.items() for x in kv])[F.col(key)], F.lit(NONE)) != CHAINED
    flags = sources.agg(F.coalesce(F.bool_or(F.col("threshold").isNull()), F.lit(False)).alias("uncalibrated"), F.coalesce(F.bool_or(unchained), F.lit(False)).alias("unauthenticated"))
    dark = line.agg(F.coalesce(F.every(F.col("verdict") != LIVE), F.lit(True)).alias("blind_by_default"))
    regimes = profile.agg((F.count_distinct("regime") <= 1).alias("regime_collapsed")) if "regime" in profile.columns else profile.agg(F.lit(True).alias("regime_collapsed"))
    return flags.join(dark, F.lit(True)).join(regimes, F.lit(True))
