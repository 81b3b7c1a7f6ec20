"""Name → (job, SQL twin) registry filled by the catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from urnframe.sources.tables import Tables
from urnframe.plans.sql_views import with_views

JOBS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def job(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` is the body after the shared views."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in JOBS:
            raise ValueError(f"{name} is registered twice")
        JOBS[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return wrap


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = JOBS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))

    run.__name__ = name
    return run
