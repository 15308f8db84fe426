"""The refresh workflow: steps in dependency order, each staged, gated by quality and promoted; statuses roll up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: What each pipeline needs, in the order of a full refresh.
DEPENDS = {"geospatial": [], "transit": [], "census": ["geospatial"], "crime": [], "assessments": ["geospatial"], "poi_standardization": ["geospatial"], "deduplication": ["poi_standardization"]}


def closure(wanted: list[str]) -> list[str]:
    """The wanted pipelines and all they need, in the fixed order."""
    need: set[str] = set()
    todo = list(wanted)
    while todo:
        name = todo.pop()
        if name not in DEPENDS:
            raise ValueError(f"no pipeline {name}")
        if name not in need:
            need.add(name)
            todo += DEPENDS[name]
    return [n for n in DEPENDS if n in need]


@dataclass
class Outcome:
    status: str = "succeeded"
    steps: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def run(wanted: list[str], steps: dict[str, Callable[[], None]], retries: int = 1) -> Outcome:
    """Run the steps; one that fails makes all that need it be skipped, the others go on."""
    out = Outcome()
    for name in closure(wanted):
        if any(out.steps.get(d) in ("failed", "skipped") for d in DEPENDS[name]):
            out.steps[name] = "skipped"
            continue
        for attempt in range(retries + 1):
            try:
                steps[name]()
                out.steps[name] = "succeeded"
                break
            except Exception as error:  # a step's error is the workflow's result, told by name
                out.errors[name] = f"{type(error).__name__}: {error}"
                out.steps[name] = "failed"
    kinds = set(out.steps.values())
    out.status = "succeeded" if kinds <= {"succeeded"} else "partial_success" if "succeeded" in kinds else "failed"
    return out
