"""Pipeline files: stages that depend on one another, checked and chained as DataFrame transformations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What each type of stage takes and gives.
STAGE_TYPES = {
    "Capture": ("raw", "raw"),
    "Preprocess": ("raw", "surface"),
    "Inference": ("surface", "embedding"),
    "Detect": ("embedding", "detection"),
    "RuleEval": ("detection", "facts"),
    "Reason": ("facts", "result"),
    "Export": ("result", "result"),
}
POLICIES = ("block", "drop_oldest")


@dataclass(frozen=True)
class Stage:
    id: str
    type: str
    depends_on: tuple[str, ...] = ()
    config: dict = field(default_factory=dict)
    policy: str = "block"


def load_topology(text: str) -> list[Stage]:
    """The stages of a YAML file in the order they run. A ValueError names what is wrong."""
    import yaml

    doc = (yaml.safe_load(text) or {}).get("pipeline") or {}
    if not doc.get("name"):
        raise ValueError("a pipeline has a name")
    if not re.fullmatch(r"\d+\.\d+", str(doc.get("version", ""))):
        raise ValueError("a version is two numbers with a point")
    pressure = doc.get("backpressure") or {}
    policies = pressure.get("stage_overrides") or {}
    stages = [Stage(str(s.get("id") or ""), str(s.get("type")), tuple(s.get("depends_on") or ()), s.get("config") or {}, policies.get(s.get("id"), pressure.get("default", "block"))) for s in doc.get("stages") or []]
    return in_order(stages)


def in_order(stages: list[Stage]) -> list[Stage]:
    by_id = {s.id: s for s in stages}
    if not stages or "" in by_id or len(by_id) < len(stages):
        raise ValueError("stages need ids of their own, and there is one at least")
    for s in stages:
        if s.type not in STAGE_TYPES:
            raise ValueError(f"stage {s.id}: unknown type {s.type}")
        if s.policy not in POLICIES:
            raise ValueError(f"stage {s.id}: unknown policy {s.policy}")
        if missing := set(s.depends_on) - set(by_id):
            raise ValueError(f"stage {s.id} depends on unknown {sorted(missing)}")
    try:
        order = list(TopologicalSorter({s.id: s.depends_on for s in stages}).static_order())
    except CycleError as e:
        raise ValueError(f"stages depend on each other: {e.args[1]}") from None
    readers = Counter(d for s in stages for d in s.depends_on)
    if shared := [i for i, n in readers.items() if n > 1]:
        raise ValueError(f"several stages read {shared}")
    if not any(s.type == "Capture" and not s.depends_on for s in stages):
        raise ValueError("no Capture stage at the entry")
    if not any(s.type == "Export" and not readers[s.id] for s in stages):
        raise ValueError("no Export stage at the exit")
    for s in stages:
        for d in s.depends_on:
            if STAGE_TYPES[by_id[d].type][1] != STAGE_TYPES[s.type][0]:
                raise ValueError(f"{d} gives {STAGE_TYPES[by_id[d].type][1]}, {s.id} takes {STAGE_TYPES[s.type][0]}")
    return [by_id[i] for i in order]


def stage_metrics(stages: list[Stage], frames: DataFrame, transforms: Mapping[str, Callable[[DataFrame, dict], DataFrame]]) -> DataFrame:
    """Of each stage how many rows it took, gave and dropped: stage, taken, processed, dropped."""
    done, out = {}, None
    for s in in_order(stages):
        given = frames
        for i, d in enumerate(s.depends_on):
            given = done[d] if i == 0 else given.unionByName(done[d])
        done[s.id] = transforms[s.type](given, s.config) if s.type in transforms else given
        row = given.agg(F.count(F.lit(1)).alias("taken")).crossJoin(done[s.id].agg(F.count(F.lit(1)).alias("processed")))  # one row
        row = row.select(F.lit(s.id).alias("stage"), "taken", "processed", F.greatest(F.col("taken") - F.col("processed"), F.lit(0)).alias("dropped"))
        out = row if out is None else out.unionByName(row)
    return out


def run_tasks(tasks: Mapping[str, tuple[tuple[str, ...], Callable[..., object]]]) -> dict[str, tuple[str, object]]:
    """Run each task after those it depends on, once, with their results: name, to (done, result), (failed, error) or (skipped, the task that failed)."""
    order = list(TopologicalSorter({n: deps for n, (deps, _) in tasks.items()}).static_order())
    if missing := set(order) - set(tasks):
        raise ValueError(f"unknown tasks {sorted(missing)}")
    out: dict[str, tuple[str, object]] = {}
    for name in order:
        deps, run = tasks[name]
        bad = next((d if out[d][0] == "failed" else out[d][1] for d in deps if out[d][0] != "done"), None)
        if bad is not None:
            out[name] = ("skipped", bad)
            continue
        try:
            out[name] = ("done", run(*[out[d][1] for d in deps]))
        except Exception as e:  # a task's failure is a result
            out[name] = ("failed", f"{type(e).__name__}: {e}")
    return out


def run_topology(stages: list[Stage], frames: DataFrame, transforms: Mapping[str, Callable[[DataFrame, dict], DataFrame]]) -> DataFrame:
    """Chain the transforms of the stages' types; a type without one passes rows on. What the Export stage gives is returned.

    A stage that depends on several takes the union of what they give.
    """
    done: dict[str, DataFrame] = {}
    for s in in_order(stages):
        given = frames
        for i, d in enumerate(s.depends_on):
            given = done[d] if i == 0 else given.unionByName(done[d])
        done[s.id] = transforms[s.type](given, s.config) if s.type in transforms else given
        if s.type == "Export":
            last = done[s.id]
    return last
