"""Rules: YAML conditions compiled to columns, evaluated in one projection, with overrides resolved.

A compiled condition is a pair (value, ok). ``ok`` is false where a fact was missing before
short-circuiting could skip it; such a rule doesn't match. Types are known when a condition
is compiled, so operations on wrong types fold to constants: comparisons to false,
arithmetic to null.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {"==": "eq", "!=": "neq", "<": "lt", "<=": "le", ">": "gt", ">=": "ge", "in": "in", "+": "add", "-": "sub", "*": "mul", "/": "div"}


@dataclass(frozen=True)
class Value:
    """A compiled expression: its column, where it is valid, and its kind (number, string, bool, list or null)."""

    col: Column
    ok: Column
    kind: str


def _const(value, ok: Column | None = None) -> Value:
    ok = F.lit(True) if ok is None else ok
    if value is None:
        return Value(F.lit(None).cast("double"), ok, "null")
    if isinstance(value, bool):
        return Value(F.lit(value), ok, "bool")
    if isinstance(value, (int, float)):
        return Value(F.lit(float(value)), ok, "number")
    if isinstance(value, (list, tuple)):
        return Value(F.array(*[_const(v).col for v in value]), ok, "list:" + (_const(value[0]).kind if value else "null"))
    return Value(F.lit(str(value)), ok, "string")


def kind_of(spark_type: str) -> str:
    if spark_type == "boolean":
        return "bool"
    if spark_type == "string":
        return "string"
    if spark_type.startswith("array"):
        return "list:" + kind_of(spark_type[6:-1])
    return "number"


def field_ref(name: str, schema: Mapping[str, str]) -> Value:
    """A fact: a column of the frame. A missing column or a null is a missing fact."""
    if name not in schema:
        return _const(None, F.lit(False))
    kind = kind_of(schema[name])
    col = F.col(f"`{name}`")
    return Value(col.cast("double") if kind == "number" else col, col.isNotNull(), kind)


def literal(value):
    """YAML's scalars as they are; text that reads as a number or a truth value is one."""
    if isinstance(value, str):
        low = value.lower()
        if low in ("true", "false"):
            return low == "true"
        try:
            return float(value)
        except ValueError:
            return value
    return value


def _number(v: Value) -> Column | None:
    return v.col if v.kind == "number" else v.col.cast("int").cast("double") if v.kind == "bool" else None


def binary(op: str, a: Value, b: Value) -> Value:
    ok = a.ok & b.ok
    if op in ("and", "or"):
        x = F.coalesce(a.col, F.lit(False)) if a.kind == "bool" else F.lit(False)
        y = F.coalesce(b.col, F.lit(False)) if b.kind == "bool" else F.lit(False)
        # the right side counts only where the left doesn't decide
        return Value(x & y, a.ok & (~x | b.ok), "bool") if op == "and" else Value(x | y, a.ok & (x | b.ok), "bool")
    if op in ("add", "sub", "mul", "div"):
        x, y = _number(a), _number(b)
        if x is None or y is None:
            return _const(None, ok)
        return Value({"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "div": lambda: F.try_divide(x, y)}[op](), ok, "number")
    if op == "in":
        item = b.kind.removeprefix("list:")
        found = F.array_contains(b.col, a.col) if b.kind.startswith("list:") and item == a.kind else F.lit(False)
        return Value(F.coalesce(found, F.lit(False)), ok, "bool")
    same = a.col.eqNullSafe(b.col) if a.kind == b.kind else F.lit(False)
    if op in ("eq", "neq"):
        return Value(same if op == "eq" else ~same, ok, "bool")
    both = a.kind == b.kind == "number"
    less = F.coalesce(a.col < b.col, F.lit(False)) if both else F.lit(False)
    more = F.coalesce(a.col > b.col, F.lit(False)) if both else F.lit(False)
    return Value({"lt": less, "gt": more, "le": less | same, "ge": more | same}[op], ok, "bool")


def unary(op: str, a: Value) -> Value:
    if op == "not":
        return Value(~a.col, a.ok, "bool") if a.kind == "bool" else _const(None, a.ok)
    x = _number(a)
    return _const(None, a.ok) if x is None else Value(-x, a.ok, "number")


def function(name: str, args: list[Value]) -> Value:
    """avg, count, max, min, sum of numbers; len of a text in bytes or of a list. Anything else gives null."""
    ok = F.lit(True)
    for a in args:
        ok = ok & a.ok
    if name == "count":
        return Value(F.lit(float(len(args))), ok, "number")
    if name == "len":
        a = args[0]
        return Value((F.octet_length(a.col) if a.kind == "string" else F.size(a.col)).cast("double"), ok, "number") if a.kind == "string" or a.kind.startswith("list:") else _const(None, ok)
    if not args or any(a.kind != "number" for a in args):
        return _const(None, ok)
    total, missing = F.lit(0.0), F.lit(False)
    for a in args:
        total, missing = total + a.col, missing | a.col.isNull()
    value = {"sum": total, "avg": total / len(args), "max": F.greatest(*[a.col for a in args], F.lit(None).cast("double")) if len(args) == 1 else None, "min": None}.get(name)
    if name in ("max", "min"):
        value = args[0].col if len(args) == 1 else (F.greatest if name == "max" else F.least)(*[a.col for a in args])
    return Value(F.when(~missing, value), ok, "number")


def compile_condition(node, schema: Mapping[str, str], mappings: Mapping[str, str] | None = None) -> Value:
    """A condition of YAML as a value. ``mappings``: facts that path expressions stand for."""
    if not isinstance(node, dict):
        return _const(literal(node))
    for op in ("and", "or"):
        if op in node:
            if not node[op]:
                raise ValueError(f"'{op}' needs conditions")
            out = compile_condition(node[op][0], schema, mappings)
            for x in node[op][1:]:
                out = binary(op, out, compile_condition(x, schema, mappings))
            return out
    if "not" in node:
        return unary("not", compile_condition(node["not"], schema, mappings))
    if "call" in node:
        return function(node["call"], [compile_condition(x, schema, mappings) for x in node.get("args", [])])
    if "field" in node or "path" in node:
        name = node.get("field") or (mappings or {}).get(node["path"]) or "graph." + node["path"].replace("->", ".")
        left = field_ref(name, schema)
        if "op" not in node and "value" not in node:
            return left
        op = OPS.get(str(node.get("op", "==")))
        if op is None:
            raise ValueError(f"no such operator: {node['op']!r}")
        right = node.get("value")
        right = _const([literal(v) for v in right]) if isinstance(right, list) else compile_condition(right, schema, mappings)
        return binary(op, left, right)
    if "value" in node:
        return _const(literal(node["value"]))
    raise ValueError(f"not a condition: {node!r}")


def fields_of(node) -> list[str]:
    if not isinstance(node, dict):
        return []
    own = [node[k] for k in ("field", "path") if k in node]
    return own + [f for k in ("and", "or", "args") for x in node.get(k, []) for f in fields_of(x)] + fields_of(node.get("not"))


@dataclass
class Rule:
    rule_set: str
    name: str
    condition: dict | None = None
    label: str = ""
    severity: float = 0.0
    recommendation: str = ""
    priority: int = 0
    overrides: list[str] = field(default_factory=list)
    overridden_by: list[str] = field(default_factory=list)


def load_rules(text: str) -> list[Rule]:
    import yaml

    out = []
    for rule_set, rules in sorted((yaml.safe_load(text) or {}).get("rule_sets", {}).items()):
        for r in rules or []:
            if "name" not in r:
                raise ValueError(f"a rule of {rule_set} has no name")
            a = r.get("action", {})
            out.append(Rule(str(rule_set), str(r["name"]), r.get("condition"), a.get("label", ""), float(a.get("base_severity", 0)), a.get("recommendation", ""), int(r.get("priority", 0)), r.get("overrides", []), r.get("overridden_by", [])))
    return out


def override_edges(rules: list[Rule]) -> list[tuple[str, str]]:
    """(overriding, overridden), each once."""
    return sorted({(r.name, x) for r in rules for x in r.overrides} | {(x, r.name) for r in rules for x in r.overridden_by})


def has_cycle(edges: list[tuple[str, str]]) -> bool:
    todo = {n: {b for a, b in edges if a == n} for e in edges for n in e}
    while todo:
        ends = [n for n, out in todo.items() if not out & todo.keys()]
        if not ends:
            return True
        for n in ends:
            del todo[n]
    return False


def evaluate(frames: DataFrame, rules: list[Rule], resolve: bool = True) -> DataFrame:
    """``frames`` with ``resolved``: for each rule, in order of set, its struct (rule, rule_set, matched, label, severity).

    One projection: no join and no explode. A rule that a matched rule overrides isn't
    matched, even if that one is overridden itself. On a cycle among a frame's matched rules
    its matches stay as they are. Priorities have no effect.
    """
    schema = dict(frames.dtypes)
    raw = {}
    for i, r in enumerate(rules):
        v = _const(True) if r.condition is None else compile_condition(r.condition, schema)
        hit = F.coalesce(v.ok & v.col, F.lit(False)) if v.kind == "bool" else F.lit(False)
        raw[f"_rule_{i}"] = hit
    out = frames.withColumns(raw)
    place = {r.name: i for i, r in enumerate(rules)}
    edges = [(place[a], place[b]) for a, b in override_edges(rules) if a in place and b in place] if resolve else []
    cyclic = _cycle_column(edges) if has_cycle([(str(a), str(b)) for a, b in edges]) else F.lit(False)
    structs = []
    for i, r in enumerate(rules):
        beaten = F.lit(False)
        for a, b in edges:
            if b == i:
                beaten = beaten | F.col(f"_rule_{a}")
        structs.append(F.struct(F.lit(r.name).alias("rule"), F.lit(r.rule_set).alias("rule_set"), (F.col(f"_rule_{i}") & (cyclic | ~beaten)).alias("matched"), F.lit(r.label).alias("label"), F.lit(r.severity).alias("severity")))
    return out.withColumn("resolved", F.array(*structs)).drop(*raw)


def _cycle_column(edges: list[tuple[int, int]]) -> Column:
    """Whether the edges between matched rules of a frame make a cycle: some rule reaches itself."""
    nodes = sorted({n for e in edges for n in e})
    reach = {(a, b): (F.col(f"_rule_{a}") & F.col(f"_rule_{b}")) if (a, b) in edges else F.lit(False) for a in nodes for b in nodes}
    for k in nodes:
        reach = {(a, b): reach[a, b] | (reach[a, k] & reach[k, b]) for a in nodes for b in nodes}
    out = F.lit(False)
    for n in nodes:
        out = out | reach[n, n]
    return out


def overlaps(rules: list[Rule]) -> list[tuple[str, str, str, list[str]]]:
    """Pairs of rules of one set whose conditions share fields: set, rule, rule, fields."""
    out = []
    for i, a in enumerate(rules):
        for b in rules[i + 1 :]:
            if a.rule_set == b.rule_set and (common := sorted(set(fields_of(a.condition)) & set(fields_of(b.condition)))):
                out.append((a.rule_set, a.name, b.name, common))
    return out
