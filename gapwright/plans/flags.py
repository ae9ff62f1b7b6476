"""Flags of a run, and which verdicts they allow."""

from __future__ import annotations

#: Bits, names, and whether a flag rules out the universal claim.
FLAGS = {
    "grounding_capped": (0, True),
    "corridor_cap": (1, True),
    "atoms_over_budget": (2, False),
    "er_ambiguous": (3, True),
    "quarantined_records": (4, True),
    "license_voided_by_suspected_tampering": (5, True),
    "greedy_cover": (6, False),
    "sampled_matrix": (7, False),
    "profile_missing": (8, True),
}
#: Flags that leave a cut minimal by inclusion at best.
SUBSET_ONLY = ("atoms_over_budget", "corridor_cap")


class IllegalVerdict(ValueError):
    """A verdict, flags and cut that don't go together."""


def mask(names) -> int:
    return sum(1 << FLAGS[n][0] for n in set(names))


def names(bits: int) -> list[str]:
    if bits < 0 or bits >> len(FLAGS):
        raise IllegalVerdict(f"reserved bits are set: {bits:#x}")
    return [n for n, (bit, _) in FLAGS.items() if bits >> bit & 1]


def unsound(bits: int) -> list[str]:
    return [n for n in names(bits) if FLAGS[n][1]]


def check(verdict: str, bits: int, in_min: bool, in_max: bool, minimal: str, premium_published: bool) -> None:
    """Raise where a verdict claims more than flags and residual programs allow. minimal: CARDINALITY or SUBSET."""
    against = unsound(bits)
    if in_min and not in_max:
        raise IllegalVerdict("P_min isn't within P_max")
    if verdict == "ROBUST" and (against or in_max):
        raise IllegalVerdict(f"ROBUST with {', '.join(against) or 'an open goal'}")
    if verdict == "UNSAFE" and not in_min:
        raise IllegalVerdict("UNSAFE without a goal in P_min")
    if verdict == "OPTIMISTIC_ONLY" and (in_min or against):
        raise IllegalVerdict("OPTIMISTIC_ONLY with a goal in P_min, or with an unsound run")
    if verdict == "INDETERMINATE" and (not against or in_min):
        raise IllegalVerdict("INDETERMINATE without a flag for it, or with a goal in P_min")
    if verdict not in ("ROBUST", "UNSAFE", "OPTIMISTIC_ONLY", "INDETERMINATE"):
        raise IllegalVerdict(f"no verdict: {verdict}")
    if minimal == "CARDINALITY" and set(names(bits)) & set(SUBSET_ONLY):
        raise IllegalVerdict("a capped search has no minimum cut")
    if premium_published and "corridor_cap" in names(bits):
        raise IllegalVerdict("a capped search has no premium")
