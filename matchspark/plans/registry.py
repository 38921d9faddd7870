"""Named queries over the driver tables, each with its SQL oracle where one exists."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchspark.sources.fixtures import VIEW_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the domain-table CTEs it needs."""
    body = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    recursive = bool(own and own.group(1))
    if own:
        body = body[own.end():]

    def uses(text: str) -> set[str]:
        return {v for v in VIEW_SQL if re.search(rf"\b{v}\b", text)}

    needed: set[str] = set()
    todo = uses(body)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= uses(VIEW_SQL[name])
    ctes = [f"{n} AS ({VIEW_SQL[n]})" for n in VIEW_SQL if n in needed]
    if not ctes and not own:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + ((", " if ctes else "") if own else "\n") + body


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap
