"""Registry of named queries: each has a Spark builder ``(spark, sf_dir) ->
DataFrame`` and, where SQL can express it, the DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    survey_ids: str = ""


REGISTRY: dict[str, Query] = {}


def lists_as_csv(df: DataFrame) -> DataFrame:
    """Query-boundary form of list columns: comma-separated text, the
    reference's own list representation (H2).  Operators keep arrays."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            arr = F.col(f.name)
            if not isinstance(f.dataType.elementType, T.StringType):
                arr = F.transform(arr, lambda x: x.cast("string"))
            cols.append(F.array_join(arr, ",").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_lists_as_csv(sql: str, columns) -> str:
    """The same boundary form on the oracle side (DuckDB)."""
    rep = ", ".join(f"array_to_string({c}, ',') AS {c}" for c in columns)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n)"


def register(name: str, sql: str | None = None, ids: str = "", list_cols=()):
    """Register a query.  ``list_cols`` names the list-valued output columns,
    which both sides return as comma-separated text."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        build = fn
        oracle = sql
        if list_cols:
            def build(spark, sf_dir, _fn=fn):
                return lists_as_csv(_fn(spark, sf_dir))
            oracle = sql_lists_as_csv(sql, list_cols) if sql is not None else None
        REGISTRY[name] = Query(name, build, oracle, ids)
        return fn
    return deco
