"""Registration of queries: a plan over the projection and, where there is one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import query
from .projection import SQL, Graph

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None, graph: bool = True) -> Callable:
    """Register a function of the graph.  ``sql`` follows the projection's tables unless ``graph`` is false."""

    def put(run: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[name] = query(lambda spark, sf_dir: run(Graph(spark, sf_dir)))
        if sql:
            # A query that brings tables of its own continues the projection's list of them.
            body = sql.strip()
            ORACLES[name] = body if not graph else SQL.rstrip() + (", " + body[4:].lstrip() if body.upper().startswith("AND ") else "\n" + body)
        return run

    return put
