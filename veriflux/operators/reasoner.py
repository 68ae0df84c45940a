"""Decision trees, scores and verdicts as columns; evidence and traces as arrays of structs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sigmoid
from .rules import kind_of

VERDICTS = ("NG", "WARN", "OK", "UNCERTAIN")


@dataclass
class Formula:
    weights: list[float]
    features: list[str]
    threshold: float = 0.0


@dataclass
class Leaf:
    label: str
    recommendation: str = ""
    formulas: list[Formula] = field(default_factory=list)


@dataclass
class Branch:
    field: str
    branches: dict[str, "Branch | Leaf"]
    default: "Branch | Leaf"


def load_tree(text: str) -> tuple[Branch | Leaf, dict[str, float]]:
    """A tree of YAML, and the thresholds of its verdicts."""
    import yaml

    doc = yaml.safe_load(text)
    mapping = {"ng": 0.7, "warn": 0.3} | (doc.get("verdict_mapping") or {})

    def node(x) -> Branch | Leaf:
        if x.get("type") == "branch":
            if "default" not in x:
                raise ValueError(f"the branch on {x.get('field')!r} has no default")
            return Branch(x["field"], {str(k): node(v) for k, v in x["branches"].items()}, node(x["default"]))
        if x.get("type") == "leaf":
            return Leaf(x["label"], x.get("recommendation", ""), [Formula(list(map(float, f["weights"])), f["features"], float(f.get("threshold", 0))) for f in x.get("formulas", [])])
        raise ValueError(f"neither branch nor leaf: {x.get('type')!r}")

    return node(doc["tree"] if "tree" in doc else doc), mapping


def formula_score(f: Formula, schema: dict[str, str]) -> Column:
    """sigmoid of the weighted sum less the threshold; a missing fact, or one that is no number, adds 0."""
    total = F.lit(0.0)
    for w, name in zip(f.weights, f.features):
        if name in schema and kind_of(schema[name]) == "number":
            total = total + w * F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0))
    return sigmoid(total - f.threshold)


def leaf_score(leaf: Leaf, schema: dict[str, str]) -> Column:
    scores = [formula_score(f, schema) for f in leaf.formulas]
    return F.greatest(F.lit(0.0), *scores) if scores else F.lit(0.0)


def numeric_match(key: str, x: Column) -> Column:
    for op, test in ((">=", lambda t: x >= t), ("<=", lambda t: x <= t), (">", lambda t: x > t), ("<", lambda t: x < t)):
        if key.startswith(op):
            try:
                return F.coalesce(test(float(key[len(op) :])), F.lit(False))
            except ValueError:
                return F.lit(False)
    return F.lit(False)


def walk(node: Branch | Leaf, schema: dict[str, str]) -> Column:
    """The leaf that a frame reaches: struct (label, score, recommendation, path).

    Keys of numeric branches are tried in the order of their text; no match, or no fact, takes the default.
    """

    def step(x: Branch | Leaf, path: str) -> Column:
        if isinstance(x, Leaf):
            return F.struct(F.lit(x.label).alias("label"), leaf_score(x, schema).alias("score"), F.lit(x.recommendation).alias("recommendation"), F.lit(path).alias("path"))
        default = step(x.default, f"{path}/{x.field}=default")
        kind = kind_of(schema[x.field]) if x.field in schema else None
        out = None
        for key in sorted(x.branches):
            col = F.col(f"`{x.field}`") if kind else None
            test = F.coalesce(col == key, F.lit(False)) if kind == "string" else numeric_match(key, col.cast("double")) if kind == "number" else F.lit(False)
            there = step(x.branches[key], f"{path}/{x.field}={key}")
            out = F.when(test, there) if out is None else out.when(test, there)
        return default if out is None else out.otherwise(default)

    return step(node, "")


def verdict(label: Column, score: Column, mapping: dict[str, float]) -> Column:
    return F.when(label.isin(*VERDICTS), label).when(score > mapping["ng"], "NG").when(score > mapping["warn"], "WARN").otherwise("OK")


def reason(frames: DataFrame, tree: Branch | Leaf, mapping: dict[str, float]) -> DataFrame:
    """``frames`` (with ``resolved``) and: verdict, severity, confidence, recommendation, triggered, overridden, path."""
    out = frames.withColumn("_leaf", walk(tree, dict(frames.dtypes)))
    names = lambda matched: F.transform(F.filter("resolved", lambda r: r["matched"] == matched), lambda r: r["rule"])
    score = F.round("_leaf.score", 6)
    return out.withColumns({"verdict": verdict(F.col("_leaf.label"), F.col("_leaf.score"), mapping), "severity": score, "confidence": score, "recommendation": F.col("_leaf.recommendation"), "path": F.col("_leaf.path"), "triggered": names(True), "overridden": names(False)}).drop("_leaf")


def evidence(frames: DataFrame, facts: list[str], key: str = "frame_id") -> DataFrame:
    """One row for each fact (by name), then each rule, of a frame, with its place in order."""
    items = [F.struct(F.lit("fact").alias("kind"), F.lit(f).alias("name"), F.col(f"`{f}`").cast("string").alias("value")) for f in sorted(facts)]
    rules = F.transform("resolved", lambda r: F.struct(F.lit("rule").alias("kind"), r["rule"].alias("name"), r["matched"].cast("string").alias("value")))
    return frames.select(key, F.posexplode(F.concat(F.array(*items), rules)).alias("step", "item")).select(key, "step", "item.*")
