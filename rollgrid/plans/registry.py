"""The query registry: name → Spark callable, and where SQL can say it, the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollgrid.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``build(views) -> DataFrame``; ``views`` names the views the SQL needs."""

    def keep(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql.strip()
        return build

    return keep


def load() -> None:
    """Import every module that registers queries."""
    from rollgrid.plans import (  # noqa: F401
        booking_queries, directory_queries, gallery_queries, presence_queries, stream_queries, substitution_queries,
    )
