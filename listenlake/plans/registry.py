"""Where queries and the SQL that checks them are registered together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from listenlake.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function of ``Views`` under its name, and the DuckDB SQL, over ``views``, that must give the same rows."""

    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[build.__name__] = lambda spark, folder: build(Views(spark, folder))
        if sql is not None:
            ORACLES[build.__name__] = with_views(sql, *views) if views else sql
        return build

    return register
