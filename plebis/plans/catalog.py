"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plebis.plans.fixtures import PRELUDE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, more: str = "", own: bool = False, name: str | None = None):
    """Registers a function of the election tables.  ``sql`` follows the common
    tables, ``more`` adds to those, ``own`` SQL stands alone."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = sql if own else f"{PRELUDE}{', ' + more if more else ''}\n{sql}"
        return f

    return add


def load() -> None:
    from plebis.plans import ingest_queries, result_queries, seat_queries, table_queries, upkeep_queries  # noqa: F401


load()
