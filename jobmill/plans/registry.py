"""Registry of named queries, each with the SQL that DuckDB answers it with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobmill.plans import inputs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` may use the derived views of ``inputs`` by name."""
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = with_views(oracle)
        return function

    return add


def with_views(sql: str) -> str:
    """Prepend the definitions of the derived views that ``sql`` names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in inputs.VIEWS and name not in needed:
                visit(inputs.VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{n} AS ({inputs.duckdb_text(n)})" for n in needed)
    recursive = bool(re.match(r"\s*WITH\s+RECURSIVE\b", sql, re.I))
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I)
    return head + views + (",\n" if body != sql else "\n") + body
