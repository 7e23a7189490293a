"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fanchart.plans.bindings import Tables, with_ctes


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register a plan under ``name``; ``sql`` is the same result in plain SQL."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, plan, None if sql is None else with_ctes(sql, ctes))
        return plan

    return register


def load() -> dict[str, Query]:
    from fanchart.plans import catalog

    catalog.load_all()
    return QUERIES
