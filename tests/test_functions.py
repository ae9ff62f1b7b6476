"""Canonical JSON, ids, guards, repair and cuts, against brute force."""

import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gapwright.functions import arithmetic, canon, ids, repair
from gapwright.plans import certificate, cuts, flags, reach
from gapwright.plans.queries import CONTROLS
from gapwright.plans.rules import Node, Parser, RuleError, blockers, canonical, compile_guard, compile_rule, duration, type_of


def test_canonical_json():
    assert canon.dumps({"b": 1, "a": [True, "é"]}) == '{"a":[true,"é"],"b":1}'
    for bad in (None, 1.5, -1, 1 << 32, "é", "\n", {"a": None}):
        with pytest.raises(canon.CanonError):
            canon.dumps(bad)
    for text, reason in (('{"a":1,"a":2}', "duplicate_key"), ("1.5", "float_literal"), ("{", "not_json"), ("NaN", "float_literal")):
        with pytest.raises(canon.CanonError) as e:
            canon.loads(text)
        assert e.value.reason == reason
    assert canon.decimal("12") == 12
    for bad in ("01", "-1", "", "1.0", 5, str(1 << 63)):
        with pytest.raises(canon.CanonError):
            canon.decimal(bad)


def test_ids_and_arithmetic(spark):
    df = spark.createDataFrame([(b"x", "a", "bc"), (b"x", "ab", "c"), (None, None, "")], "p binary, u string, v string")
    rows = ids.exact(df.withColumn("f", ids.fast("k", F.col("u"), F.col("v"))), "p", "ev", "id").collect()
    assert len({r.f for r in rows}) == 3 and rows[0].id == rows[1].id == "ev:" + ids.digest("ev", b"x") and rows[2].id is None
    top, low = (1 << 63) - 1, -(1 << 63)
    got = spark.createDataFrame([(top, 1), (low, -1), (3, 4)], "a long, b long").select(arithmetic.saturating_add(F.col("a"), F.col("b")), arithmetic.saturating_subtract(F.col("a"), F.col("b")), arithmetic.floor_div("b - 8", 3), arithmetic.ceil_div("b - 8", 3)).collect()
    assert [tuple(r) for r in got] == [(top, top - 1, -3, -2), (low, low + 1, -3, -3), (7, -1, -2, -1)]
    assert spark.range(1).select(ids.mask_hex(F.lit(-1).cast("long")), ids.is_hash_id(F.lit("ev:" + "0" * 64))).collect()[0] == ("0x" + "f" * 16, True)


def evaluate(node: Node, env: dict):
    a = [evaluate(x, env) for x in node.args]
    if node.op == "ref":
        return env.get(node.value)
    if node.op in ("int", "dur", "const", "sym"):
        return node.value
    zero = [0 if x is None else x for x in a]
    clamp = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    return {
        "eq": lambda: None not in a and a[0] == a[1], "lt": lambda: None not in a and a[0] < a[1], "not": lambda: not a[0], "and": lambda: all(a), "or": lambda: any(a),
        "add": lambda: clamp(zero[0] + zero[1]), "sub": lambda: clamp(zero[0] - zero[1]), "abs": lambda: clamp(abs(zero[0])), "min": lambda: min(zero), "max": lambda: max(zero),
    }[node.op]()


def test_guards_are_two_valued(spark):
    texts = ["a.t <= b.t", "not (a.t == b.t)", "within(a.t, b.t, 5s) and not a.user == b.user", "a.t + 2s > b.t or b.t - a.t >= 3s", "abs(b.t - a.t) < 4s", "min(a.t, b.t) == a.t", "not not (a.t < b.t and true)"]
    kinds = {("a", "t"): "Tick", ("b", "t"): "Tick", ("a", "user"): "Ent", ("b", "user"): "Ent"}
    rows = [(x, y, u, v) for x in (None, 0, 3, (1 << 63) - 1) for y in (None, 1, 5) for u in (None, "p") for v in ("p", "q")]
    df = spark.createDataFrame(rows, "a_t long, b_t long, a_user string, b_user string")
    for text in texts:
        tree = Parser(text).whole()
        assert type_of(tree, kinds) == "Bool"
        for form in (tree, canonical(tree)):
            got = [r[0] for r in df.select(compile_guard(form, lambda s, n: F.col(f"{s}_{n}"))).collect()]
            assert got == [evaluate(tree, {("a", "t"): x, ("b", "t"): y, ("a", "user"): u, ("b", "user"): v}) for x, y, u, v in rows], text


@pytest.mark.parametrize("text", ["a.t +", "a.t == a.user", "ctl.x >= y", "e.t == a.t", "a.t ? b.t", "a.t < b.t)", "within(a.t, b.t)"])
def test_bad_guards(text):
    with pytest.raises(RuleError):
        type_of(Parser(text).whole(), {("a", "t"): "Tick", ("b", "t"): "Tick", ("a", "user"): "Ent"})


def test_rule_lints():
    good = {"id": "r", "kind": "detect", "head": "h(u, t)", "body": ["b(u, t)"], "producing_sources": ["s"]}
    assert compile_rule(good, CONTROLS, {"b"}).head.predicate == "h"
    for change in ({"revoke": 1}, {"persistence": "sticky"}, {"head": "h(x, t)"}, {"kind": "other"}, {"body": ["c(u, t)"]}, {"body": ["b(u, t)", "b(v, t1)"]}, {"blocked_when": "ctl.captcha >= off"}, {"blocked_when": "ctl.captcha >= on and ctl.payment_check >= card"}):
        with pytest.raises(RuleError):
            compile_rule(good | change, CONTROLS, {"b"})
    assert duration("30m") == 1800 and duration("2000ms") == 2
    with pytest.raises(RuleError):
        duration("5ms")
    assert blockers("ctl.payment_check >= address or ctl.payment_check >= card", CONTROLS) == blockers("ctl.payment_check >= card", CONTROLS)


def test_repair_against_brute_force():
    rng = random.Random("repair")
    for _ in range(80):
        values = [rng.randrange(6) for _ in range(rng.randrange(9))]
        best = max(n for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(c))
        kept = repair.longest_nondecreasing(values)
        assert len(kept) == best and [values[i] for i in kept] == sorted(values[i] for i in kept)
        edges = [tuple(rng.sample(range(6), 2)) for _ in range(rng.randrange(7))]
        cover, exact = repair.vertex_cover(edges)
        least = next(c for n in range(7) for c in itertools.combinations(range(6), n) if all(u in c or v in c for u, v in edges))
        assert exact and len(cover) == len(least) and all(u in cover or v in cover for u, v in edges)
        greedy, exact = repair.vertex_cover(edges, 0)
        assert (not exact or not edges) and all(u in greedy or v in greedy for u, v in edges)
    assert repair.feasible([("a", "b", 3), ("b", "a", -2)]) and not repair.feasible([("a", "b", 1), ("b", "a", -2)])


def all_cuts():
    names = sorted(CONTROLS.levels)
    return [dict(zip(names, levels)) for levels in itertools.product(*[range(len(CONTROLS.levels[c])) for c in names])]


def random_program(rng):
    facts = [f"f{i}" for i in range(7)]
    bits = [1 << b for _, _, b in CONTROLS.literals()]
    return {"f0", "f1"}, [reach.Instance(f"i{k:02}", rng.choice(facts[2:]), tuple(rng.sample(facts, rng.randrange(1, 3))), tuple(sorted(rng.sample(bits, rng.randrange(0, 3))))) for k in range(rng.randrange(3, 12))]


def test_cut_search_against_the_lattice():
    rng = random.Random("cuts")
    for _ in range(60):
        axioms, program = random_program(rng)
        psi = cuts.learn(axioms, program, ["f6"], CONTROLS)
        severing = [c for c in all_cuts() if "f6" not in reach.closure(axioms, program, CONTROLS.cut_mask(c))]
        size = lambda c: sum(n > 0 for n in c.values())
        if psi.unblockable:
            assert not severing
            continue
        assert psi.complete and size(psi.cut) == min(map(size, severing))
        assert "f6" not in reach.closure(axioms, program, CONTROLS.cut_mask(psi.cut))
        top = {c: len(v) - 1 for c, v in CONTROLS.levels.items()}
        small = cuts.shrink(top, lambda c: "f6" not in reach.closure(axioms, program, CONTROLS.cut_mask(c)))
        assert "f6" not in reach.closure(axioms, program, CONTROLS.cut_mask(small))
        # More controls never reach more.
        for a, b in rng.sample(list(itertools.product(all_cuts(), all_cuts())), 20):
            if all(a[k] <= b[k] for k in a):
                assert set(reach.closure(axioms, program, CONTROLS.cut_mask(b))) <= set(reach.closure(axioms, program, CONTROLS.cut_mask(a)))


def test_batched_reach_agrees(spark):
    axioms, program = random_program(random.Random("batch"))
    frame = spark.createDataFrame([(i.instance_id, i.head, list(i.body), list(i.blockers)) for i in program], "instance_id string, head string, body array<string>, blockers array<long>")
    lattice = reach.lattice(spark, CONTROLS).where("cut_id IN ('0000', '1000', '0101', '3122')")
    got = {(r.cut_id, r.fact_id) for r in reach.reached(spark.createDataFrame([(a,) for a in axioms], "fact_id string"), frame, lattice).collect()}
    want = {(r.cut_id, f) for r in lattice.collect() for f in reach.closure(axioms, program, r.mask)}
    assert got == want


def shop(side: str) -> list[reach.Instance]:
    """A refund that is seen step by step, and another that a dark source may hide."""
    bit = lambda c, n: 1 << CONTROLS.bit(c, n)
    seen = [("o1", "account", ("visit",), bit("account_age", 1)), ("o2", "order", ("account", "stock"), bit("captcha", 1)), ("o3", "refund", ("order",), bit("payment_check", 1))]
    dark = [("l1", "retry", (), 0), ("l2", "override", ("retry", "stock"), bit("retry_limit", 2)), ("l3", "refund", ("override",), 0)]
    out = [reach.Instance(k, h, b, (m,) if m else ()) for k, h, b, m in seen]
    return out + [reach.Instance(k, h, b, (m,) if m else (), "LICENSED", ("dark7",)) for k, h, b, m in dark if side == "max"]


GIVEN, SCOPE = {"stock", "visit"}, {"rules": "r", "scenario": "s"}


def test_premium_outcomes():
    low, high = (cuts.learn(GIVEN, shop(s), ["refund"], CONTROLS) for s in ("min", "max"))
    assert cuts.premium(low, high, CONTROLS).controls == ("retry_limit",)
    assert cuts.premium(low, high, CONTROLS, capped=True).withheld == "GROUNDING_CAPPED"
    empty = cuts.Psi((), {}, True)
    assert cuts.premium(empty, high, CONTROLS).degenerate
    assert [cuts.verdict(*x) for x in ((0, 0, 1, 0, 0), (1, 1, 1, 0, 0), (0, 1, 1, 0, 0), (0, 0, 1, 1, 0), (1, 1, 1, 0, 1), (0, 1, 1, 0, 1))] == ["ROBUST", "UNSAFE", "OPTIMISTIC_ONLY", "OPTIMISTIC_ONLY", "UNSAFE", "INDETERMINATE"]


def checked(body, goals=("refund",), **given):
    return certificate.verify(certificate.render(body), GIVEN, list(goals), shop("min"), shop("max"), CONTROLS, SCOPE, **given)


def altered(body, **members):
    made = body | members
    return made | {"cert_hash": certificate.digest(made)}


def test_certificate_and_mutations():
    body = certificate.build(GIVEN, shop("min"), shop("max"), ["refund"], CONTROLS, SCOPE)
    again = lambda **k: checked(altered(body, **k))
    assert checked(body) is None and body["verdict"] == "ROBUST" and body["premium"]["controls"] == ["retry_limit"]
    assert certificate.verify(certificate.render(body)[:-1], GIVEN, ["refund"], shop("min"), shop("max"), CONTROLS, SCOPE) == "O0_CANONICAL"
    assert checked(body | {"verdict": "UNSAFE"}) == "O1_HASH"
    assert again(schema="x") == "O2_SCHEMA" and again(scope={"rules": "r"}) == "O3_SCOPE" and again(program={"min": "x", "max": "y"}) == "O4_INPUTS"
    assert again(axioms=["stock"]) == "O4_INPUTS" and again(goals=["none"]) == "O4_INPUTS" and again(gates={"view": True}) == "O4B_GATES"
    assert again(atoms=[]) == "O5_ATOMS" and again(cut={"captcha": 9}) == "O6_CUT" and again(size=1) == "O6B_SIZE" and again(closure=[]) == "O7_INVARIANT"
    assert again(closure=sorted([*body["closure"], "order"])) == "O8_CLOSURE" and again(closure=sorted(GIVEN)) == "O8_CLOSURE" and again(open_goals=["refund"]) == "O9_GOALS"
    assert checked(body, licences=set()) == "O10_LICENCES" and again(counts=body["counts"] | {"ghosts": 7}) == "O11_COUNTS" and again(witnesses=[[]]) == "O12_WITNESS"
    bit = lambda c, n: f"0x{1 << CONTROLS.bit(c, n):016x}"
    assert again(psi=body["psi"] | {"max": [bit("captcha", 1)]}) == "O13_PSI" and again(psi=body["psi"] | {"max": []}) == "O13_PSI"
    assert again(premium={"published": True, "controls": [], "degenerate": False}) == "O13B_PREMIUM" and again(premium=body["premium"] | {"degenerate": True}) == "O13B_PREMIUM"
    assert again(verdict="UNSAFE") == "O14_VERDICT" and again(dispute={"licences": ["dark7"], "verdict": "ROBUST"}) == "O14B_DISPUTE"
    wide = {"account_age": 1, "captcha": 1, "retry_limit": 2}
    assert again(cut=wide, size=3, closure=sorted(certificate.derived(GIVEN, shop("max"), CONTROLS.cut_mask(wide)))) == "O15_MINIMAL"
    none = certificate.build(GIVEN, shop("min"), shop("max"), ["none"], CONTROLS, SCOPE)
    assert checked(none, ["none"]) is None and checked(none) == "O4_INPUTS"


def test_forged_certificates_are_refused():
    body = certificate.build(GIVEN, shop("min"), shop("max"), ["refund"], CONTROLS, SCOPE)
    empty = {"min": [], "max": []}
    assert checked(altered(body, axioms=["x"], closure=["x"], cut={}, size=0, psi=empty, premium={"published": True, "controls": [], "degenerate": True})) is not None
    assert checked(altered(body, open_goals=["refund"], closure=[], witnesses=[], verdict="OPTIMISTIC_ONLY")) is not None
    # With no cut the goal is open; a witness of an axiom in place of a step is none.
    inside = sorted(certificate.derived(GIVEN, shop("max"), 0))
    bare = altered(body, cut={}, size=0, closure=inside, open_goals=["refund"], witnesses=[[{"fact": "refund", "kind": "axiom", "children": []}]], psi=empty, verdict="UNSAFE")
    assert checked(bare) == "O12_WITNESS"
    tree = certificate.flat(reach.witness(GIVEN, shop("max"), 0, "refund"))
    assert checked(bare | {"witnesses": [tree + [{"fact": "visit2", "kind": "axiom", "children": []}]]}) == "O1_HASH"
    assert checked(altered(bare, witnesses=[tree + [{"fact": "stock2", "kind": "axiom", "children": []}]])) == "O12_WITNESS"


def test_false_documents_of_the_reviewer():
    """An honest document is a cut of one control, ROBUST; none of these says what the programs bear out."""
    seen = [reach.Instance("o1", "refund", ("visit",), (1 << CONTROLS.bit("captcha", 1),))]
    honest = certificate.build(GIVEN, seen, seen, ["refund"], CONTROLS, SCOPE)
    against = lambda **k: certificate.verify(certificate.render(altered(honest, **k)), GIVEN, ["refund"], seen, seen, CONTROLS, SCOPE)
    assert against() is None and honest["cut"] == {"captcha": 1} and honest["verdict"] == "ROBUST"
    inside, tree = sorted(certificate.derived(GIVEN, seen, 0)), certificate.flat(reach.witness(GIVEN, seen, 0, "refund"))
    withheld = {"published": False, "controls": [], "degenerate": False, "reason": "CORRIDOR_CAP"}
    bare = {"complete": False, "cut": {}, "size": 0, "psi": {"min": [], "max": []}, "closure": inside, "open_goals": ["refund"], "witnesses": [tree], "premium": withheld, "flags": ["corridor_cap"]}
    for verdict in ("UNSAFE", "OPTIMISTIC_ONLY", "ROBUST", "INDETERMINATE"):
        assert against(**bare, verdict=verdict, dispute={"licences": [], "verdict": verdict}) == "O13_PSI"
        assert against(complete=False, premium=withheld, flags=["corridor_cap"], verdict=verdict) == "O13_PSI"
    for odd in ({"reason": "because"}, {"reason": "CORRIDOR_CAP", "controls": ["zzz"]}, {"reason": "CORRIDOR_CAP", "degenerate": True}, {"more": 1}):
        assert against(premium=withheld | odd) == "O2_SCHEMA"
    assert against(premium=withheld) == "O13B_PREMIUM" and against(flags=["er_ambiguous"]) == "O14_FLAGS" and against(premium=honest["premium"] | {"more": 1}) == "O2_SCHEMA"


def test_malformed_documents_are_refused():
    """Every member, and every member inside one, with values of the wrong kind: refused, and never an exception."""
    body = certificate.build(GIVEN, shop("min"), shop("max"), ["refund"], CONTROLS, SCOPE)
    open_ = certificate.build(GIVEN, shop("min"), shop("max"), ["stock"], CONTROLS, SCOPE)
    odd = [True, 5, 77, "x", "", [], {}, [1, "x"], ["zz"], [[1]], [{}], {"min": ["zz"]}, {"min": [], "max": [5]}, {"k": False}]
    for made, goals in ((body, ["refund"]), (open_, ["stock"])):
        given = (GIVEN, goals, shop("min"), shop("max"), CONTROLS, SCOPE)
        assert certificate.verify(certificate.render(made), *given) is None
        for name, value in made.items():
            if name == "cert_hash":
                continue
            told = [altered(made, **{name: x}) for x in odd if x != value or type(x) is not type(value)]
            if isinstance(value, dict):
                told += [altered(made, **{name: value | {k: x}}) for k in [*value, "more"] for x in odd if k not in value or value[k] != x or type(value[k]) is not type(x)]
            if isinstance(value, list) and value:
                told += [altered(made, **{name: [x, *value[1:]]}) for x in odd if x != value[0]]
            told.append({k: v for k, v in made.items() if k != name})
            told[-1]["cert_hash"] = certificate.digest(told[-1])
            for t in told:
                assert certificate.verify(certificate.render(t), *given) is not None, (name, t.get(name))


def test_capped_searches():
    """A search that met its limit says so, withholds its premium and claims nothing universal; the checker knows the limit."""
    seen = [replace(i, observed="OBSERVED", license_ids=()) for i in shop("max")]
    made = certificate.build(GIVEN, seen, seen, ["refund"], CONTROLS, SCOPE, most=1)
    given = (GIVEN, ["refund"], seen, seen, CONTROLS, SCOPE)
    assert not made["complete"] and made["flags"] == ["corridor_cap"] and made["premium"]["reason"] == "CORRIDOR_CAP" and made["verdict"] == "UNSAFE"
    assert certificate.verify(certificate.render(made), *given, most=1) in (None, "O15_MINIMAL") and certificate.verify(certificate.render(made), *given) == "O13_PSI"
    bits = flags.mask(["er_ambiguous"])
    made = certificate.build(GIVEN, shop("min"), shop("max"), ["refund"], CONTROLS, SCOPE, run=bits)
    assert made["verdict"] == "INDETERMINATE" and made["premium"]["reason"] == "ER_AMBIGUOUS"
    assert certificate.verify(certificate.render(made), GIVEN, ["refund"], shop("min"), shop("max"), CONTROLS, SCOPE, run=bits) is None
    assert certificate.verify(certificate.render(made), GIVEN, ["refund"], shop("min"), shop("max"), CONTROLS, SCOPE) == "O13B_PREMIUM"


def test_disputes_and_gates():
    body = certificate.build(GIVEN, shop("min"), shop("max"), ["refund"], CONTROLS, SCOPE, frozenset({"dark7", "other"}), {"view": False})
    given = {"disputed": frozenset({"dark7", "other"}), "gates": {"view": False}}
    assert checked(body, **given) is None and body["dispute"]["licences"] == ["dark7"] and body["verdict"] == "OPTIMISTIC_ONLY"
    assert checked(body, gates={"view": False}) == "O14B_DISPUTE" and checked(body, disputed=given["disputed"]) == "O4B_GATES"
    assert checked(altered(body, verdict="ROBUST"), **given) == "O14_VERDICT"


def test_checker_against_random_programs():
    rng = random.Random("certificates")
    for _ in range(25):
        axioms, program = random_program(rng)
        low = program[: len(program) // 2]
        high = low + [replace(i, observed="LICENSED", license_ids=("l",)) for i in program[len(program) // 2 :]]
        made = certificate.build(axioms, low, high, ["f6"], CONTROLS, SCOPE)
        assert certificate.verify(certificate.render(made), axioms, ["f6"], low, high, CONTROLS, SCOPE) is None
