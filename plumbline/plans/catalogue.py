"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
MODULES = ("points", "frames", "records", "live", "more", "surface", "views", "scalars", "gates", "motion", "texture", "flows", "archive", "scores")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and the SQL that gives its rows (None: SQL cannot, a test does)."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def r6(x: Column) -> Column:
    return F.round(x, 6)


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"plumbline.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
