"""Numeric and time Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` with a zero denominator giving null."""
    return F.try_divide(a, b)


def safe_ln(x: Column) -> Column:
    """Natural log, null for values that are not positive (as Spark's ``ln`` already is)."""
    return F.ln(x)


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of a value on a circle of ``period`` units."""
    angle = value * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def utc(ts: Column) -> Column:
    """Timestamp in a UTC session; a zone-less value (text or TIMESTAMP_NTZ) is read as UTC; bad text gives null."""
    return ts.try_cast("timestamp")


def source_slug(source: Column) -> Column:
    """Folder name of a news source."""
    return F.replace(F.lower(source), F.lit(" "), F.lit("_"))


def position_sign(y: Column) -> Column:
    """Class 1 -> +1, anything else -> -1."""
    return F.when(y == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def log_loss_term(y: Column, p: Column, eps: float = 1e-7) -> Column:
    """Negative log likelihood of one label, probability clipped to [eps, 1 - eps]."""
    clipped = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.when(y == 1, -F.ln(clipped)).otherwise(-F.ln(1 - clipped))


def p_bin(p: Column, bins: int) -> Column:
    """Histogram bin of a probability; null outside [0, 1]."""
    return F.when(p.between(0.0, 1.0), F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int"))


def signed_p(stat: Column, p: Column) -> Column:
    """p-value carrying the sign of the statistic."""
    return F.when(stat >= 0, p).otherwise(-p)


def verdict_accuracy(n: Column, overall: Column) -> Column:
    """Reading of a model's accuracy."""
    return (
        F.when(n == 0, "no closed bars yet").when(n < 8, "warming up")
        .when(overall >= 0.54, "model beats a coin").when(overall <= 0.46, "model below coin")
        .otherwise("coin-flip so far")
    )


def verdict_trades(n: Column, win_rate: Column, pnl: Column) -> Column:
    """Reading of recent trade quality."""
    return (
        F.when(n == 0, "no trades yet").when(n < 8, "warming up")
        .when((win_rate > 0.55) & (pnl > 0), "model is working")
        .when((win_rate < 0.45) & (pnl < 0), "model is losing")
        .otherwise("inconclusive")
    )
