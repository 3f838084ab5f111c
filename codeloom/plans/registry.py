"""A registry of named queries with their SQL, and of named plug-in functions."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
PLUGINS: dict[tuple[str, str], Callable] = {}


def query(sql: str | None = None):
    """Register a function (tables, spark) -> DataFrame under its name, with the SQL that it equals."""

    def add(f):
        def run(spark, sf_dir):
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def plugin(kind: str, name: str):
    """Register a selector, sampler, row constructor, normaliser, validator, check or rule under a name."""

    def add(f):
        if (kind, name) in PLUGINS:
            raise ValueError(f"{kind} {name} is registered already")
        PLUGINS[kind, name] = f
        return f

    return add


def get(kind: str, name: str) -> Callable:
    if (kind, name) not in PLUGINS:
        raise KeyError(f"no {kind} named {name!r}; known: {sorted(n for k, n in PLUGINS if k == kind)}")
    return PLUGINS[kind, name]
