"""Registered checks: a Spark query and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ferrywork.plans.fixtures import with_views


class Check(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under ``key``."""

    def register(fn):
        if key in CHECKS:
            raise ValueError(f"{key} is registered twice")
        CHECKS[key] = Check(fn, None if sql is None else with_views(sql, *views))
        return fn

    return register


def load_checks() -> dict[str, Check]:
    from ferrywork.plans import load_queries, run_queries, scan_queries, sync_queries, transform_queries  # noqa: F401

    return CHECKS
