"""Diebold-Mariano comparison of forecasts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.functions.scalar import signed_p
from barframe.operators.series import over_rows, with_position

PAIR_KEY = ("pair", "interval", "model_a", "model_b")


def pair_predictions(preds: DataFrame) -> DataFrame:
    """Predictions of every unordered model pair on their common (open_time, fold).

    One shuffle: the models' predictions of a key meet in one small array (one slot per model) from
    which the ordered pairs are taken.
    """
    key = ["pair", "interval", "open_time", "fold"]
    met = preds.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("model", "y_pred", "y_true"))).alias("m")
    )
    pairs = F.flatten(
        F.transform(
            "m", lambda a: F.transform(F.filter("m", lambda b: b["model"] > a["model"]), lambda b: F.struct(a.alias("a"), b.alias("b")))
        )
    )
    return met.select(*key, F.explode(pairs).alias("p")).select(
        *key, F.col("p.a.model").alias("model_a"), F.col("p.b.model").alias("model_b"),
        F.col("p.a.y_true").alias("y_true"), F.col("p.a.y_pred").alias("pred_a"), F.col("p.b.y_pred").alias("pred_b"),
    )


def _loss(pred: str, loss: str) -> Column:
    y, p = F.col("y_true").cast("double"), F.col(pred).cast("double")
    if loss == "zero_one":
        return (y != p).cast("double")
    if loss == "squared":
        return (y - p) * (y - p)
    if loss == "absolute":
        return F.abs(y - p)
    raise ValueError(f"unknown loss {loss!r}")


def dm_statistic(
    pairs: DataFrame, h: int = 1, loss: str = "zero_one", by: Sequence[str] = PAIR_KEY, min_rows: int = 8
) -> DataFrame:
    """HLN-corrected statistic per group: ``n``, ``dm_stat`` (null below ``min_rows`` or 8 rows).

    Autocovariances up to lag ``h - 1`` come from sums of the differences and their lags, so every
    group is one hash aggregation; only ``h > 1`` needs the rows in order.
    """
    by = list(by)
    d = pairs.withColumn("d", _loss("pred_a", loss) - _loss("pred_b", loss))
    lags = range(1, h)
    if h > 1:
        ordered = with_position(d, by=by, order=("fold",), total=None, pos="_p")
        d = over_rows(ordered, lambda f: {f"_l{k}": f.lag("d", k) for k in lags}, before=h - 1, by=by, pos="_p")
    sums = []
    for k in lags:
        lagged = F.col(f"_l{k}")
        sums += [
            F.sum(F.col("d") * lagged).alias(f"_x{k}"), F.sum(F.when(lagged.isNotNull(), F.col("d"))).alias(f"_a{k}"),
            F.sum(lagged).alias(f"_b{k}"), F.count(lagged).alias(f"_c{k}"),
        ]
    agg = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("_m"),
        F.when(F.min("d") == F.max("d"), 0.0).otherwise(F.var_pop("d")).alias("_v"), *sums,
    )
    n, m, var = F.col("n"), F.col("_m"), F.col("_v")
    for k in lags:
        cov = F.col(f"_x{k}") - m * (F.col(f"_a{k}") + F.col(f"_b{k}")) + m * m * F.col(f"_c{k}")
        var = var + 2 * F.coalesce(cov, F.lit(0.0)) / n
    var = F.greatest(var, F.lit(1e-12))
    correction = F.sqrt((n + (1 - 2 * h) + F.lit(float(h * (h - 1))) / n) / n)
    stat = F.when(n >= max(8, min_rows), m / F.sqrt(var / n) * correction)
    return agg.select(*by, "n", stat.alias("dm_stat"))


_NODES = 2000


def student_t_two_sided(stat: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t, by Simpson's rule.

    With ``t = sqrt(v) tan(a)`` the density becomes ``cos(a) ** (v - 1)`` on a quarter turn; the p-value is the integral
    beyond the statistic's angle over the whole. Both end where the integrand has fallen below exp(-72).
    """
    end = F.least(F.lit(math.pi / 2), 12 / F.sqrt(dof))
    start = F.least(F.atan(F.abs(stat) / F.sqrt(dof)), end)

    def integral(low: Column) -> Column:
        step = (end - low) / _NODES

        def term(total: Column, i: Column) -> Column:
            factor = F.when((i == 0) | (i == _NODES), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return total + factor * F.exp((dof - 1) * F.log(F.greatest(F.cos(low + i * step), F.lit(1e-300))))

        return F.aggregate(F.sequence(F.lit(0), F.lit(_NODES)), F.lit(0.0), term) * step / 3

    return F.when(stat.isNotNull(), integral(start) / integral(F.lit(0.0)))


def diebold_mariano(
    pairs: DataFrame, h: int = 1, loss: str = "zero_one", by: Sequence[str] = PAIR_KEY, min_rows: int = 8
) -> DataFrame:
    """Statistic, two-sided p-value and verdict at 5 % for each model pair."""
    stats = dm_statistic(pairs, h, loss, by, min_rows)
    p = student_t_two_sided(F.col("dm_stat"), (F.col("n") - 1).cast("double"))
    verdict = (
        F.when(F.col("dm_stat").isNull(), "n too small for DM")
        .when(F.col("p_value") >= 0.05, "no significant difference")
        .when(F.col("dm_stat") < 0, "A beats B").otherwise("B beats A")
    )
    return stats.withColumn("p_value", p).withColumn("verdict", verdict)


def dm_matrix(preds: DataFrame, models: list[str]) -> DataFrame:
    """Antisymmetric matrix of signed p-values per series: negative where the row's model wins."""
    tested = diebold_mariano(pair_predictions(preds)).withColumn(
        "sp", signed_p(F.col("dm_stat"), F.col("p_value"))
    )
    upper = tested.select("pair", "interval", "model_a", "model_b", "sp")
    lower = tested.select("pair", "interval", F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), (-F.col("sp")).alias("sp"))
    both = upper.unionByName(lower)
    return both.groupBy("pair", "interval", F.col("model_a").alias("model")).pivot("model_b", models).agg(F.first("sp"))


def dm_cross(left: DataFrame, right: DataFrame, min_rows: int = 30) -> DataFrame:
    """Signed p (4 places, half-even) of every left model against every right model; null on small overlap.

    The two prediction sets meet on (pair, interval, open_time, fold), like ``pair_predictions``.
    """
    key = ["pair", "interval", "open_time", "fold"]
    a = left.select(*key, F.col("model").alias("model_a"), "y_true", F.col("y_pred").alias("pred_a"))
    b = right.select(*key, F.col("model").alias("model_b"), F.col("y_pred").alias("pred_b"))
    tested = diebold_mariano(a.join(b, key), min_rows=min_rows)
    return tested.select(
        "pair", "interval", F.col("model_a").alias("variant"), F.col("model_b").alias("baseline"), "n", "dm_stat",
        F.bround(signed_p(F.col("dm_stat"), F.col("p_value")), 4).alias("signed_p"),
    )
