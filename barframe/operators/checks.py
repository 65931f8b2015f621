"""Data checks. Each returns the violations or missing keys as rows; empty means passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.operators.series import BLOCK_ROWS, over_rows, with_position
from barframe.schema import SERIES, TS


def publication_violations(news: DataFrame) -> DataFrame:
    """Articles published after they were ingested."""
    return news.filter(F.col("published_at") > F.col("ingested_at"))


def check_publication_order(news: DataFrame, samples: int = 3) -> int:
    """Raise when any article was published after ingestion, naming a few; returns the rows checked."""
    bad = publication_violations(news)
    found = bad.select("id", "published_at", "ingested_at").limit(samples).collect()
    if found:
        raise ValueError(f"{bad.count()} articles published after ingestion, e.g. {found}")
    return news.count()


def clamp_published(news: DataFrame) -> DataFrame:
    """Publication time no later than ingestion time."""
    return news.withColumn("published_at", F.least("published_at", "ingested_at"))


def bar_order(df: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Per series: strictly increasing ``open_time`` in arrival order, and no bar ingested before it opened.

    Bars arrive in the order of ``ingested_at``; those of one instant count as sent in time order.
    """
    positioned = with_position(df, ts="ingested_at", order=(TS,), rows=block, total=None)
    stepped = over_rows(positioned, lambda f: {"_prev": f.lag(TS)}, before=1, block=block)
    increasing = F.bool_and(F.coalesce(F.col(TS) > F.col("_prev"), F.lit(True)))
    return stepped.groupBy(*SERIES).agg(
        increasing.alias("increasing"), F.bool_and(F.col("ingested_at") >= F.col(TS)).alias("ingested_after_open"),
        F.count(F.lit(1)).alias("rows"),
    )


def check_bar_order(df: DataFrame) -> DataFrame:
    """Series failing ``bar_order``."""
    return bar_order(df).filter(~(F.col("increasing") & F.col("ingested_after_open")))


def require_keys(df: DataFrame, keys: DataFrame, key: Sequence[str] = (*SERIES, TS)) -> DataFrame:
    """Requested ``keys`` that have no row in ``df``."""
    return keys.join(df.select(*key), list(key), "left_anti")


def missing_inputs(grid: DataFrame, tables: dict[str, DataFrame], key: Sequence[str] = SERIES) -> DataFrame:
    """(key, table) combinations of ``grid`` for which a required table has no rows."""
    out = None
    for name, table in tables.items():
        part = grid.join(table.select(*key).distinct(), list(key), "left_anti").withColumn("missing", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tables to check")
    return out


def pending_runs(grid: DataFrame, metrics: DataFrame, key: Sequence[str] = (*SERIES, "model")) -> DataFrame:
    """Runs of the grid that have no finished metrics yet."""
    return grid.join(metrics.select(*key), list(key), "left_anti")


def dataset_status(bars: DataFrame, features: DataFrame | None = None, anchor: float = 0.9) -> DataFrame:
    """Per series: bar count, first and last bar, feature rows and the held-out cut row."""
    out = bars.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("bars"), F.min(TS).alias("first_bar"), F.max(TS).alias("last_bar")
    )
    if features is None:
        return out
    rows = features.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("feature_rows"))
    joined = out.join(rows, list(SERIES), "left").withColumn("feature_rows", F.coalesce("feature_rows", F.lit(0)))
    return joined.withColumn("anchor_cut", F.floor(F.col("feature_rows") * anchor))
