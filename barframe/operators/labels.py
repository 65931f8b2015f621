"""Labels and the model dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions.scalar import ratio, safe_ln
from barframe.operators.series import BLOCK_ROWS, over_rows, with_position


def _check(horizon: int) -> None:
    if horizon < 1:
        raise ValueError("horizon must be at least 1")


def with_direction_label(df: DataFrame, horizon: int = 1, name: str = "y", block: int = BLOCK_ROWS) -> DataFrame:
    """1 where the close ``horizon`` rows ahead is strictly higher, else 0; null at the tail."""
    _check(horizon)
    return over_rows(
        df, lambda f: {name: (f.lead("close", horizon) > F.col("close")).cast("long")}, after=horizon, block=block
    )


def with_return_label(df: DataFrame, horizon: int = 1, name: str = "next_ret", block: int = BLOCK_ROWS) -> DataFrame:
    """``ln(close[+h] / close)``; null at the tail."""
    _check(horizon)
    return over_rows(
        df, lambda f: {name: safe_ln(ratio(f.lead("close", horizon), F.col("close")))}, after=horizon, block=block
    )


def build_dataset(features: DataFrame, horizon: int = 1, block: int = BLOCK_ROWS) -> DataFrame:
    """Label the surviving feature rows and number them (``row``, ``n``) for splitting.

    "Next" means the next kept row, so positions are taken after the incomplete rows are gone. The
    unlabelled tail is dropped; ``next_ret`` on the last labelled rows without a successor is 0.
    Pass a stored feature table: its rows are read by the counting and by the labelling branch.
    """
    _check(horizon)
    base = with_position(features.drop("pos"), pos="row", total="_all", rows=block)
    labelled = over_rows(
        base,
        lambda f: {
            "y": (f.lead("close", horizon) > F.col("close")).cast("long"),
            "_next": f.lead("close", 1),
        },
        after=horizon, pos="row", block=block,
    )
    kept = labelled.filter(F.col("row") < F.col("_all") - horizon)
    # the return of the last labelled row looks past the dataset and therefore counts as 0
    next_ret = F.when(F.col("row") < F.col("_all") - horizon - 1, safe_ln(ratio(F.col("_next"), F.col("close"))))
    return kept.withColumns(
        {"next_ret": F.coalesce(next_ret, F.lit(0.0)), "n": F.col("_all") - horizon}
    ).drop("_all", "_next")
