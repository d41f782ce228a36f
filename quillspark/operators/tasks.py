"""Columns made of one another: tasks in the order of what they need."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def levels(needs: dict[str, list[str]]) -> list[list[str]]:
    """Tasks by level: each needs only those of levels before it.  Unknown needs and circles are errors."""
    if unknown := {n for ns in needs.values() for n in ns} - set(needs):
        raise ValueError(f"unknown tasks: {sorted(unknown)}")
    out: list[list[str]] = []
    done: set[str] = set()
    while len(done) < len(needs):
        ready = sorted(t for t, ns in needs.items() if t not in done and done.issuperset(ns))
        if not ready:
            raise ValueError(f"tasks in a circle: {sorted(set(needs) - done)}")
        out.append(ready)
        done.update(ready)
    return out


def run_tasks(df: DataFrame, tasks: dict[str, tuple[list[str], Callable[[], Column]]]) -> DataFrame:
    """Adds a column for each task (what it needs, its expression); one projection a level."""
    return reduce(lambda out, level: out.withColumns({t: tasks[t][1]() for t in level}), levels({t: n for t, (n, _) in tasks.items()}), df)


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with $name and ${name} by values; names without a value stay as they are, $$ is one $."""
    pieces = re.split(r"(\$\$|\$\{\w+\}|\$[A-Za-z_]\w*)", template)
    parts = [F.lit("$") if p == "$$" else values.get(p.strip("${}"), F.lit(p)) if p.startswith("$") else F.lit(p) for p in pieces if p]
    return F.concat(*parts) if parts else F.lit("")


def kept_or(existing: Column, made: Column) -> Column:
    """What is there already, or else what is made."""
    return F.when(existing.isNotNull() & (existing != ""), existing).otherwise(made)
