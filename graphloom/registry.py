"""Queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .views import Graph, duck

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return add
