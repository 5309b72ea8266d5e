"""All registered queries of the library, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules of plans; each has QUERIES (name -> function of (spark, sf_dir)) and ORACLES (name -> DuckDB SQL).
MODULES: tuple[str, ...] = ("events", "text", "dataset", "metrics", "tree", "values", "ordered")


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in MODULES:
        out |= import_module(f"strandlake.plans.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"strandlake.plans.{m}").ORACLES
    return out
