"""Exact entity resolution: attributes of events against a table of names, with three outcomes, and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESOLVED, AMBIGUOUS, UNRESOLVED = "resolved", "ambiguous", "unresolved"


def role_values(events: DataFrame, roles: dict[str, str], row_id: str = "event_id") -> DataFrame:
    """(event_id, role, value) from columns {role: column}; a null value gives no row."""
    pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).cast("string").alias("value")) for r, c in sorted(roles.items())])
    return events.select(row_id, F.explode(pairs).alias("x")).select(row_id, "x.role", "x.value").where(F.col("value").isNotNull())


def resolve(values: DataFrame, names: DataFrame, row_id: str = "event_id") -> DataFrame:
    """(event_id, role, value, outcome, candidates): names are (role, value, entity_id), matched exactly.

    Candidates of a (role, value) are gathered once from the names, so events are joined with one row each and not
    multiplied; Catalyst broadcasts that side only if it is small."""
    known = names.groupBy("role", "value").agg(F.array_sort(F.collect_set("entity_id")).alias("candidates"))
    met = values.join(known, ["role", "value"], "left")
    n = F.size(F.coalesce("candidates", F.array().cast(known.schema["candidates"].dataType)))
    return met.select(row_id, "role", "value", F.when(n == 0, UNRESOLVED).when(n == 1, RESOLVED).otherwise(AMBIGUOUS).alias("outcome"), "candidates")


def outcome_counts(resolved: DataFrame) -> DataFrame:
    """By role: counts of the three outcomes."""
    return resolved.groupBy("role").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in (RESOLVED, AMBIGUOUS, UNRESOLVED)])


def entities(resolved: DataFrame, rule_of: str = "role", row_id: str = "event_id") -> DataFrame:
    """By entity: the least join rule, the events' count and extremes (the set itself stays in the bindings)."""
    bound = resolved.where(F.col("outcome") == RESOLVED).select(F.element_at("candidates", 1).alias("entity_id"), F.col(rule_of).alias("rule"), row_id)
    once = bound.groupBy("entity_id", row_id).agg(F.min("rule").alias("rule"))
    return once.groupBy("entity_id").agg(F.min("rule").alias("join_rule"), F.count("*").alias("n_events"), F.min(row_id).alias("first_event"), F.max(row_id).alias("last_event"))


def project_roles(bindings: DataFrame, declared: DataFrame) -> DataFrame:
    """Bindings (predicate, role, ...) whose role the predicate's pattern binds. declared: (predicate, role)."""
    return bindings.join(declared.select("predicate", "role").distinct(), ["predicate", "role"], "left_semi")


def missing_roles(bindings: DataFrame, declared: DataFrame, row_id: str = "event_id") -> DataFrame:
    """(event_id, predicate, role): declared roles that an event of the predicate has no binding for."""
    wanted = bindings.select(row_id, "predicate").distinct().join(declared.select("predicate", "role").distinct(), "predicate")
    return wanted.join(bindings.select(row_id, "predicate", "role"), [row_id, "predicate", "role"], "left_anti").select(row_id, "predicate", "role")
