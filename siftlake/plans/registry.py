"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlake.session import WIDE_CONF, configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(views) -> DataFrame`; `sql` is the DuckDB form over the same tables."""

    def register(fn):
        from siftlake.plans.views import Views

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(configure(spark, WIDE_CONF), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
