"""Named queries over the test tables, each with the SQL that states its expected result.

Modules register with :func:`query`; :func:`load_all` imports them.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
EXPECTED: dict[str, str] = {}

_MODULES = ("extraction", "packs", "graph", "verification", "review", "documents", "ledger", "investigation", "streams", "scans", "surface")


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name!r} exists")
        QUERIES[name] = run
        if sql is not None:
            EXPECTED[name] = sql
        return run

    return register


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"factloom.queries.{module}")
