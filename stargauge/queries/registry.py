"""Registration of queries and of the SQL they are checked against."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from stargauge.queries.base_sql import BASE
from stargauge.sources.warehouse import Warehouse

MODULES = (
    "scans",
    "cleaning",
    "joins",
    "aggregates",
    "benchmarks",
    "subsets",
    "features",
    "models",
    "sinks",
    "streams",
)


@dataclass(frozen=True)
class Query:
    run: Callable[[Warehouse], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(
    name: str, sql: str | None = None
) -> Callable[[Callable[[Warehouse], DataFrame]], Callable[[Warehouse], DataFrame]]:
    """Register a function of the warehouse under ``name``; ``sql`` may use the base views."""

    def register(run: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(run, with_base(sql) if sql else None)
        return run

    return register


def _mentioned(sql: str) -> set[str]:
    return {name for name in BASE if re.search(rf"\b{name}\b", sql)}


def with_base(sql: str) -> str:
    """Put the base views that the statement mentions, and those they mention, in front."""
    needed: set[str] = set()
    pending = _mentioned(sql)
    while pending:
        name = pending.pop()
        needed.add(name)
        pending |= _mentioned(BASE[name]) - needed - {name}
    views = [f"{name} AS ({BASE[name].strip()})" for name in BASE if name in needed]
    body = sql.strip()
    if not views:
        return body
    separator = ",\n" if body.upper().startswith("WITH ") else "\n"
    rest = body[5:] if body.upper().startswith("WITH ") else body
    return "WITH " + ",\n".join(views) + separator + rest


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"stargauge.queries.{module}")
    return dict(_QUERIES)
