"""Scenario, control, goal and liveness files (TOML), checked member by member, as plain values and dimension frames."""

from __future__ import annotations

import hashlib
import re
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import canon
from ..operators.liveness import LivenessConfig
from ..plans.rules import Controls, RuleError, duration


class ConfigError(ValueError):
    pass


def load(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def exact_members(value: dict, need: set[str], may: set[str] = frozenset()) -> None:
    if lacking := need - set(value):
        raise ConfigError(f"lacks {sorted(lacking)}")
    if unknown := set(value) - need - may:
        raise ConfigError(f"unknown {sorted(unknown)}")


def controls(value: dict, lock: dict[tuple[str, int], int] | None = None) -> Controls:
    """Controls of a catalog; at least two levels each, level 0 the weakest."""
    levels = {}
    for c in value["control"]:
        exact_members(c, {"id", "levels"}, {"title", "dimensions", "provenance"})
        if c["id"] in levels or len(c["levels"]) < 2 or len(set(c["levels"])) < len(c["levels"]):
            raise ConfigError(f"control {c['id']}")
        levels[c["id"]] = tuple(c["levels"])
    return Controls(levels, lock or {})


def render_lock(made: Controls) -> str:
    return "".join(f"{c} {n} {b}\n" for c, n, b in made.literals())


def read_lock(text: str) -> dict[tuple[str, int], int]:
    """Lines ``control level bit``; a bit is given once."""
    out = {(c, int(n)): int(b) for c, n, b in (x.split() for x in text.splitlines() if x.strip())}
    if len(set(out.values())) < len(out):
        raise ConfigError("a bit is given twice")
    return out


@dataclass(frozen=True)
class Goal:
    predicate: str
    args: tuple[str, ...]
    horizon: int


def goal(value: dict) -> Goal:
    if len(value.get("goal", [])) != 1:
        raise ConfigError("exactly one goal")
    g = value["goal"][0]
    exact_members(g, {"goal_predicate", "goal_args"}, {"horizon_k"})
    return Goal(g["goal_predicate"], tuple(g["goal_args"]), g.get("horizon_k", value.get("horizon_k", 0)))


def liveness(value: dict) -> LivenessConfig:
    """Whole numbers and exact ratios; a decimal anywhere is refused."""
    for k, v in value.items():
        if isinstance(v, float) or isinstance(v, str) and re.search(r"\d\.\d", v) and k != "schema":
            raise ConfigError(f"{k} is a decimal")
    p, _, q = value["quantile"].partition("/")
    made = LivenessConfig(int(p), int(q), value["slack_num"], value["slack_den"], value["k_tail"], value["n_floor"], value["m_min"])
    if not 0 < made.p < made.q or made.slack_num < made.slack_den:
        raise ConfigError("quantile or slack")
    return made


@dataclass(frozen=True)
class Scenario:
    """Declared sources, phases, excluded spans, entities, noise families and steps; times in ticks from the epoch."""

    horizon: int
    sources: tuple[dict, ...]
    phases: tuple[dict, ...]
    entities: tuple[dict, ...]
    noise: tuple[dict, ...]
    steps: tuple[dict, ...]
    excluded: tuple[dict, ...] = ()
    blind: tuple[dict, ...] = ()

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {
            "sources": spark.createDataFrame([(s["source_id"], s["integrity_class"], list(s.get("emits", []))) for s in self.sources], "source string, integrity string, emits array<string>"),
            "phases": spark.createDataFrame([(p["regime"], p["t0"], p["t1"]) for p in self.phases], "regime string, t0 long, t1 long"),
            "entities": spark.createDataFrame([(e["kind"], e["name"]) for e in self.entities], "kind string, entity_id string"),
            "excluded": spark.createDataFrame([(e["source"], e["t0"], e["t1"], e["reason"]) for e in self.excluded], "source string, t0 long, t1 long, reason string"),
            "blind": spark.createDataFrame([(b["source"], b["t0"], b["t1"]) for b in self.blind], "source string, t0 long, t1 long"),
        }


def scenario(value: dict) -> Scenario:
    """Cross-member laws: unique names, phases that cover the horizon without overlap, steps of declared sources."""
    made = Scenario(value["horizon"], tuple(value["source"]), tuple(value["phase"]), tuple(value.get("entity", ())), tuple(value.get("noise", ())), tuple(value.get("step", ())), tuple(value.get("excluded", ())), tuple(value.get("blind", ())))
    names = [s["source_id"] for s in made.sources]
    if len(set(names)) < len(names):
        raise ConfigError("a source is there twice")
    at = 0
    for p in sorted(made.phases, key=lambda p: p["t0"]):
        if p["t0"] != at or p["t1"] <= p["t0"]:
            raise ConfigError("phases leave a hole or overlap")
        at = p["t1"]
    if at != made.horizon:
        raise ConfigError("phases don't end at the horizon")
    for s in (*made.steps, *made.noise):
        if s["source"] not in names:
            raise ConfigError(f"{s['source']} isn't declared")
    for s in made.noise:
        try:
            duration(s["every"])
        except RuleError as e:
            raise ConfigError(str(e)) from e
    return made


PROFILE = ("source", "regime", "n_gaps", "order_statistic", "min_gap", "max_gap", "threshold")


def profile_id(rows: list[dict]) -> str:
    return "profile:" + hashlib.sha256(b"".join(canon.line(r) for r in rows)).hexdigest()


def write_profile(path: str, profile: DataFrame) -> str:
    """A calibrated profile as canonical JSON lines, a row for each source and regime, by name, behind a line with the id
    that follows from them; the sources' number bounds it. 64-bit members travel as text. Returns the id."""
    have = [c for c in PROFILE if c in profile.columns]
    rows = [{c: r[c] if c in ("source", "regime") else str(r[c]) for c in have if r[c] is not None} for r in profile.select(*have).collect()]
    rows.sort(key=lambda r: (r["source"], r.get("regime", "")))
    made = profile_id(rows)
    with open(path, "wb") as f:
        f.writelines([canon.line({"profile_id": made}), *map(canon.line, rows)])
    return made


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """The profile of a file whose id still follows from its rows, and that is in canonical form; else it is refused."""
    with open(path, "rb") as f:
        lines = f.read().splitlines(keepends=True)
    try:
        first, *rows = [canon.loads(x.decode("utf-8")) for x in lines]
    except (canon.CanonError, UnicodeDecodeError, ValueError) as e:
        raise ConfigError("no profile") from e
    if [canon.line(x) for x in (first, *rows)] != lines or first != {"profile_id": profile_id(rows)}:
        raise ConfigError("the profile's id doesn't follow from its rows")
    number = lambda r, c: int(r[c]) if c in r else None
    return spark.createDataFrame([(r["source"], r.get("regime"), *[number(r, c) for c in PROFILE[2:]]) for r in rows], "source string, regime string, " + ", ".join(f"{c} long" for c in PROFILE[2:]))


def binding_gates(calibration: dict, analysed: dict) -> list[str]:
    """Why thresholds of one run may not be used on another: every gate that fails. A run never calibrates itself."""
    gates = {
        "same_seed": calibration["seed"] == analysed["seed"], "same_run": calibration["run_id"] == analysed["run_id"], "scenario": calibration["scenario"] != analysed["scenario"],
        "quantile": calibration["quantile"] != analysed["quantile"], "degraded": calibration["completeness"] != (1, 1), "excluded": calibration["excluded"] != analysed["excluded"],
    }
    return [k for k, bad in gates.items() if bad]
