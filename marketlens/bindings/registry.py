"""Queries on the driver tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, tuple(operators.split()), build, sql)
        return build

    return register


def load_all() -> dict[str, Query]:
    from importlib import import_module

    for module in MODULES:
        import_module(f"marketlens.bindings.{module}")
    return QUERIES


MODULES = ["backtest", "surface", "evaluation", "books", "signals", "spatial", "tables", "labels", "catalog", "files", "streams"]
