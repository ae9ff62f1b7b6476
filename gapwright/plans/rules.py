"""Rule tables: text is lexed, parsed, typed, canonicalised and linted here; guards become two-valued Spark columns."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arithmetic import MAX, MIN, saturating_add, saturating_subtract

#: Seconds in a duration's unit (ns, us and ms must come out whole), slots of a body, limits.
UNITS = {"h": 3600, "m": 60, "s": 1, "tick": 1}
SMALL_UNITS = {"ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}
SLOTS = "abcd"
MAX_TERMS = 8
RETRACTIONS = ("delete", "retract", "revoke", "expire")


class RuleError(ValueError):
    """A rule that doesn't compile; ``code`` says why."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


def duration(text: str) -> int:
    """Whole ticks (seconds) of a literal such as 30m."""
    m = re.fullmatch(r"(\d+)(ns|us|ms|s|m|h|tick)", text)
    if not m:
        raise RuleError("SYN_DURATION", text)
    n, unit = int(m[1]), m[2]
    if unit in UNITS:
        return n * UNITS[unit]
    if n % SMALL_UNITS[unit]:
        raise RuleError("SYN_DURATION_FRACTION", text)
    return n // SMALL_UNITS[unit]


@dataclass(frozen=True)
class Pattern:
    """predicate(entity variables..., time variable)"""

    predicate: str
    variables: tuple[str, ...]
    time: str

    @classmethod
    def parse(cls, text: str) -> "Pattern":
        m = re.fullmatch(r"\s*([a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)*)\(([^()]*)\)\s*", text)
        names = [x.strip() for x in m[2].split(",")] if m else []
        if not names or not all(re.fullmatch(r"[a-z][a-z0-9_]*", x) for x in names):
            raise RuleError("SYN_PATTERN", text)
        return cls(m[1], tuple(names[:-1]), names[-1])


@dataclass(frozen=True)
class Node:
    """An expression: op, children, and a value for leaves."""

    op: str
    args: tuple["Node", ...] = ()
    value: object = None

    def text(self) -> str:
        return f"{self.op}({','.join(a.text() for a in self.args)}{'' if self.value is None else repr(self.value)})"


TOKEN = re.compile(r"\s*(?:(\d+(?:ns|us|ms|s|m|h|tick)\b)|(\d+)|(#[a-z][a-z0-9_]*)|([a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)?)|(==|!=|<=|>=|[<>+\-(),]))")


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise RuleError("SYN_TOKEN", text[at:])
        out.append((("duration", "int", "symbol", "name", "op")[m.lastindex - 1], m[m.lastindex]))
        at = m.end()
    return out


class Parser:
    """or < and < not < comparison < sum < primary."""

    def __init__(self, text: str):
        self.tokens, self.at = lex(text), 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.peek():
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise RuleError("SYN_EXPECTED", f"{wanted!r}, not {self.peek()!r}")

    def whole(self) -> Node:
        if not self.tokens:
            return Node("const", value=True)
        out = self.either()
        if self.peek():
            raise RuleError("SYN_TRAILING", self.peek())
        return out

    def either(self) -> Node:
        parts = [self.both()]
        while self.take("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both(self) -> Node:
        parts = [self.negated()]
        while self.take("and"):
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        left = self.sum()
        op = self.take("==", "!=", "<=", ">=", "<", ">")
        if not op:
            return left
        right = self.sum()
        # <= and >= are negations of the strict order: with a missing operand they hold.
        return {
            "==": Node("eq", (left, right)), "!=": Node("not", (Node("eq", (left, right)),)), "<": Node("lt", (left, right)), ">": Node("lt", (right, left)),
            "<=": Node("not", (Node("lt", (right, left)),)), ">=": Node("not", (Node("lt", (left, right)),)),
        }[op]

    def sum(self) -> Node:
        out = self.primary()
        while op := self.take("+", "-"):
            out = Node("add" if op == "+" else "sub", (out, self.primary()))
        return out

    def primary(self) -> Node:
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise RuleError("SYN_END", "an operand is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "duration":
            return Node("dur", value=duration(text))
        if kind == "int":
            return Node("int", value=int(text))
        if kind == "symbol":
            return Node("sym", value=text[1:])
        if text in ("true", "false"):
            return Node("const", value=text == "true")
        if text in ("abs", "min", "max", "within"):
            self.need("(")
            args = [self.sum()]
            while self.take(","):
                args.append(self.sum())
            self.need(")")
            if len(args) != {"abs": 1, "min": 2, "max": 2, "within": 3}[text]:
                raise RuleError("SYN_ARITY", text)
            if text == "within":
                x, y, d = args
                return Node("not", (Node("lt", (d, Node("abs", (Node("sub", (y, x)),)))),))
            return Node(text, tuple(args))
        if kind == "name" and "." in text:
            slot, name = text.split(".", 1)
            if slot == "ctl":
                raise RuleError("SYN_CONTROL_IN_GUARD", text)
            if slot not in SLOTS or len(slot) != 1:
                raise RuleError("SYN_SLOT", text)
            return Node("ref", value=(slot, name))
        raise RuleError("SYN_OPERAND", text)


def type_of(node: Node, kinds: dict[tuple[str, str], str]) -> str:
    """Bool, Int, Tick, Dur, Sym or Ent; nothing is cast. Tick - Tick is Dur, Tick + Dur is Tick."""
    t = [type_of(a, kinds) for a in node.args]

    def expect(ok: bool):
        if not ok:
            raise RuleError("TYPE", f"{node.op} over {t}")

    if node.op == "ref":
        if node.value not in kinds:
            raise RuleError("TYPE_UNBOUND", ".".join(node.value))
        return kinds[node.value]
    if node.op in ("const", "int", "dur", "sym"):
        return {"const": "Bool", "int": "Int", "dur": "Dur", "sym": "Sym"}[node.op]
    if node.op in ("and", "or", "not"):
        expect(all(x == "Bool" for x in t))
        return "Bool"
    if node.op in ("eq", "lt"):
        expect(t[0] == t[1] or set(t) == {"Ent", "Sym"} and node.op == "eq")
        expect(node.op == "eq" or t[0] in ("Int", "Tick", "Dur"))
        return "Bool"
    if node.op == "abs":
        expect(t[0] in ("Int", "Dur"))
        return t[0]
    if node.op in ("min", "max"):
        expect(t[0] == t[1] and t[0] in ("Int", "Dur", "Tick"))
        return t[0]
    found = {("add", "Int", "Int"): "Int", ("add", "Dur", "Dur"): "Dur", ("add", "Tick", "Dur"): "Tick", ("add", "Dur", "Tick"): "Tick", ("sub", "Int", "Int"): "Int", ("sub", "Dur", "Dur"): "Dur", ("sub", "Tick", "Tick"): "Dur", ("sub", "Tick", "Dur"): "Tick"}.get((node.op, *t))
    expect(found is not None)
    return found


def _clamp(x: int) -> int:
    return max(MIN, min(MAX, x))


def canonical(node: Node) -> Node:
    """Constants folded, double negation and nesting gone, children of and/or distinct and in order."""
    args = tuple(canonical(a) for a in node.args)
    if node.op in ("add", "sub", "min", "max", "abs") and all(a.op in ("int", "dur") for a in args):
        v = [a.value for a in args]
        value = {"add": lambda: v[0] + v[1], "sub": lambda: v[0] - v[1], "min": lambda: min(v), "max": lambda: max(v), "abs": lambda: abs(v[0])}[node.op]()
        return Node(args[0].op, value=_clamp(value))
    if node.op == "not":
        inner = args[0]
        if inner.op == "not":
            return inner.args[0]
        if inner.op == "const":
            return Node("const", value=not inner.value)
        if inner.op in ("and", "or"):
            return canonical(Node("or" if inner.op == "and" else "and", tuple(Node("not", (a,)) for a in inner.args)))
    if node.op in ("and", "or"):
        flat = [b for a in args for b in (a.args if a.op == node.op else (a,))]
        stop = node.op == "or"
        if any(a.op == "const" and a.value is stop for a in flat):
            return Node("const", value=stop)
        kept = {a.text(): a for a in flat if a.op != "const"}
        if not kept:
            return Node("const", value=not stop)
        ordered = tuple(kept[k] for k in sorted(kept))
        return ordered[0] if len(ordered) == 1 else Node(node.op, ordered)
    return Node(node.op, args, node.value)


def compile_guard(node: Node, ref) -> Column:
    """``node`` as a two-valued column; ``ref(slot, name)`` is a slot's field. A missing operand makes eq and lt false
    and counts as 0 in arithmetic, so a negation above it is true, never null."""
    a = [compile_guard(x, ref) for x in node.args]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    if node.op == "ref":
        return ref(*node.value)
    if node.op in ("int", "dur"):
        return F.lit(node.value).cast("long")
    if node.op in ("const", "sym"):
        return F.lit(node.value)
    if node.op == "eq":
        return F.coalesce(a[0] == a[1], F.lit(False))
    if node.op == "lt":
        return F.coalesce(a[0] < a[1], F.lit(False))
    if node.op == "not":
        return ~a[0]
    if node.op in ("and", "or"):
        out = a[0]
        for x in a[1:]:
            out = (out & x) if node.op == "and" else (out | x)
        return out
    if node.op == "add":
        return saturating_add(zero(a[0]), zero(a[1]))
    if node.op == "sub":
        return saturating_subtract(zero(a[0]), zero(a[1]))
    if node.op == "abs":
        return F.when(zero(a[0]) == MIN, F.lit(MAX)).otherwise(F.abs(F.greatest(zero(a[0]), F.lit(MIN + 1))))
    return (F.least if node.op == "min" else F.greatest)(zero(a[0]), zero(a[1]))


@dataclass(frozen=True)
class Controls:
    """Controls and their level names, weakest first. Bit and rank of (control, level >= 1) by order of names."""

    levels: dict[str, tuple[str, ...]]
    lock: dict[tuple[str, int], int] = field(default_factory=dict)

    def literals(self) -> list[tuple[str, int, int]]:
        """(control, level, bit): locked bits stay, new literals take the next free ones."""
        free = max(self.lock.values(), default=-1) + 1
        out = []
        for c in sorted(self.levels):
            for level in range(1, len(self.levels[c])):
                if (c, level) in self.lock:
                    out.append((c, level, self.lock[c, level]))
                else:
                    out.append((c, level, free))
                    free += 1
        if free > 64:
            raise RuleError("CONTROL_BITS", f"{free} literals")
        return out

    def bit(self, control: str, level: int) -> int:
        return next(b for c, n, b in self.literals() if (c, n) == (control, level))

    def cut_mask(self, cut: dict[str, int]) -> int:
        """A cut raises controls to levels; it holds every literal up to them."""
        return sum(1 << b for c, n, b in self.literals() if n <= cut.get(c, 0))


def blockers(text: str, controls: Controls) -> tuple[int, ...]:
    """Masks of the terms of a disjunction of ``ctl.name >= level``; a term that a lower level implies goes."""
    low: dict[str, int] = {}
    if not text.strip():
        return ()
    if re.search(r"\band\b", text):
        raise RuleError("BLOCK_CONJUNCTION", text)
    terms = re.split(r"\bor\b", text)
    for term in terms:
        m = re.fullmatch(r"\s*ctl\.([a-z][a-z0-9_]*)\s*>=\s*([a-z][a-z0-9_]*)\s*", term)
        if not m:
            raise RuleError("SYN_THRESHOLD", term)
        if m[1] not in controls.levels or m[2] not in controls.levels[m[1]]:
            raise RuleError("CONTROL_UNKNOWN", term)
        level = controls.levels[m[1]].index(m[2])
        if level == 0:
            raise RuleError("CONTROL_LEVEL_ZERO", term)
        low[m[1]] = min(level, low.get(m[1], level))
    if len(low) > MAX_TERMS:
        raise RuleError("BLOCK_TERMS", text)
    return tuple(sorted(1 << controls.bit(c, n) for c, n in low.items()))


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str
    head: Pattern
    body: tuple[Pattern, ...]
    when: Node
    blockers: tuple[int, ...]
    sources: tuple[str, ...]
    temporal: dict | None = None
    silent_kinds: dict[str, str] | None = None
    evidence: tuple[str, ...] = ("a",)
    relation: str = "AUTHORIZES"
    version: str = "1.0.0"

    def canonical_hash(self) -> str:
        parts = [self.rule_id, self.version, self.kind, str(self.head), *map(str, self.body), self.when.text(), str(self.blockers), *self.sources, str(sorted((self.temporal or {}).items()))]
        return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def compile_rule(raw: dict, controls: Controls, axioms: set[str]) -> Rule:
    """A rule of a table (the members of a TOML table). ``axioms``: predicates that events seed."""
    if any(k in raw for k in RETRACTIONS):
        raise RuleError("RETRACTION", raw["id"])
    if raw.get("persistence", "instant") != "instant":
        raise RuleError("PERSISTENCE", raw["persistence"])
    if raw["kind"] not in ("detect", "obligation"):
        raise RuleError("KIND", raw["kind"])
    head, body = Pattern.parse(raw["head"]), tuple(map(Pattern.parse, raw["body"]))
    if not 1 <= len(body) <= len(SLOTS):
        raise RuleError("BODY", raw["id"])
    kinds = {}
    for slot, p in zip(SLOTS, body):
        kinds |= {(slot, v): "Ent" for v in p.variables} | {(slot, "t"): "Tick"}
    when = Parser(raw.get("when", "")).whole()
    if type_of(when, kinds) != "Bool":
        raise RuleError("TYPE", "a guard is Bool")
    temporal = dict(raw["temporal"]) if raw.get("temporal") else None
    if temporal:
        temporal["within"] = duration(temporal["within"])
        if temporal["op"] not in ("seq", "absence", "distinct", "obligation"):
            raise RuleError("TEMPORAL", temporal["op"])
        if temporal["op"] == "absence":
            temporal["of"] = Pattern.parse(temporal["of"])
        if temporal["op"] == "distinct":
            temporal["n"] = int(temporal["n"])
            if temporal["field"] not in body[SLOTS.index(temporal["of"])].variables:
                raise RuleError("DISTINCT_FIELD", temporal["field"])
    bound = {v for p in body for v in p.variables}
    if raw["kind"] == "detect":
        if not set(head.variables) <= bound or head.time not in {p.time for p in body}:
            raise RuleError("HEAD_UNBOUND", raw["id"])
        if not any(p.predicate in axioms for p in body):
            raise RuleError("NO_AXIOM", raw["id"])
        for k in range(1, len(body)):
            if not set(body[k].variables) & {v for p in body[:k] for v in p.variables}:
                raise RuleError("BODY_DISJOINT", raw["id"])  # slots without a shared variable would be a cross join
    elif not temporal or temporal["op"] != "obligation":
        raise RuleError("OBLIGATION", raw["id"])
    return Rule(raw["id"], raw["kind"], head, body, canonical(when), blockers(raw.get("blocked_when", ""), controls), tuple(raw["producing_sources"]), temporal, dict(raw["silent_bind_kinds"]) if raw.get("silent_possible") and raw.get("silent_bind_kinds") else None, tuple(raw.get("evidence", ["a"])), raw.get("causal_relation", "AUTHORIZES"), raw.get("version", "1.0.0"))


def compile_table(rules: list[dict], controls: Controls, axioms: set[str]) -> list[Rule]:
    done = [compile_rule(r, controls, axioms) for r in rules]
    if len({r.rule_id for r in done}) < len(done):
        raise RuleError("RULE_ID", "a rule id is there twice")
    arity: dict[str, int] = {}
    for p in (p for r in done for p in (r.head, *r.body)):
        if arity.setdefault(p.predicate, len(p.variables)) != len(p.variables):
            raise RuleError("ARITY", p.predicate)
    return sorted(done, key=lambda r: r.rule_id)
