"""Registered queries: each runs over whole tables of a data folder.

A query is a function of the model views; where SQL can state the same result, the
statement stands beside it.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from riskweave.session import configure
from riskweave.views import Views, oracle_text

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_MODULES = ["queries_findings", "queries_projects", "queries_corpus", "queries_reports", "queries_streams"]


def query(name: str, oracle: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def load() -> None:
    for module in _MODULES:
        import_module(f"riskweave.plans.{module}")


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Views(configure(spark), sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def oracles() -> dict[str, str]:
    load()
    return {name: oracle_text(sql) for name, sql in ORACLES.items()}
