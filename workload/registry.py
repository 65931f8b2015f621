"""Registry of queries and their oracle SQL, with shared output conventions.

Outputs hold long, double, string and boolean columns only: times become epoch milliseconds, doubles
are rounded to six places (adding 0.0 turns a negative zero into zero), so both engines can be
compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(t, T.TimestampType):
            c = F.unix_millis(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = DIGITS) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB equivalent where one exists."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return finish(fn(spark, sf_dir), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(*names: str, digits: int = DIGITS) -> str:
    """Rounded select items: ``name`` or ``expression AS name``."""
    items = []
    for item in names:
        expr, _, alias = item.rpartition(" AS ")
        expr, alias = (expr, alias) if expr else (item, item)
        items.append(f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {alias}")
    return ", ".join(items)


def ms(*names: str) -> str:
    """Select items turning timestamps into epoch milliseconds."""
    items = []
    for item in names:
        expr, _, alias = item.rpartition(" AS ")
        expr, alias = (expr, alias) if expr else (item, item)
        items.append(f"(epoch_us({expr}) // 1000)::BIGINT AS {alias}")
    return ", ".join(items)
