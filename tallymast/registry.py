"""Operators by name: ``run("odd_hours", calls, high=5)`` or ``operators()`` for the catalogue."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable

FAMILIES = ["summaries", "quality", "cdr", "location", "network", "ipdr", "tower_time", "behaviour", "identity", "movement", "geofence", "graph",
            "crossref", "correlate", "risk", "charts", "compose"]


def operators() -> dict[str, Callable]:
    """Every public operator as ``family.name``."""
    out = {}
    for family in FAMILIES:
        module = importlib.import_module(f"tallymast.operators.{family}")
        for name, fn in inspect.getmembers(module, inspect.isfunction):
            if fn.__module__ == module.__name__ and not name.startswith("_"):
                out[f"{family}.{name}"] = fn
    return out


def find(name: str) -> Callable:
    every = operators()
    if name in every:
        return every[name]
    hits = [k for k in every if k.split(".", 1)[1] == name]
    if len(hits) != 1:
        raise KeyError(f"{name!r} is {'ambiguous: ' + ', '.join(hits) if hits else 'unknown'}")
    return every[hits[0]]


def run(name: str, *frames, **params):
    """Apply an operator; thresholds are keyword arguments."""
    return find(name)(*frames, **params)
