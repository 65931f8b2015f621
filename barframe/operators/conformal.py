"""Split-conformal thresholds and prediction sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.operators.tables import spread_join
from barframe.schema import SERIES
from barframe.session import materialise

MIN_CALIBRATION = 32
BITS = 12  # of a value that a round of selection looks at
SORTED = 65_536  # distinct values of a cell that are sorted in one task


def quantile_per_group(df: DataFrame, by: Sequence[str], value: str, level: Column, out: str = "quantile", most: int = SORTED) -> DataFrame:
    """Exact linear-interpolated quantile of a [0, 1] value, at a level that depends on the group's size.

    ``level`` is an expression over ``n`` (rows in the group). Equal values are counted, then the two wanted ranks are
    found digit by digit: values are summed by their next 12 bits inside the cells that hold a wanted rank, until such a cell has
    at most ``most`` distinct values, which alone are sorted. However close the values lie, no task sees a group or sorts
    a large cell. Returns ``by, n, out``; null values don't count.
    """
    by = list(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counted = materialise(counted, "values")

    def cell(digits: int) -> Column:
        return F.floor(F.col("_v") * float(1 << BITS * digits))  # exact: a power of two

    def placed(bins: DataFrame, within: list[str]) -> DataFrame:
        upto = Window.partitionBy(*within).orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        return bins.withColumn("_before", F.coalesce(F.sum("_bc").over(upto), F.lit(0)))

    sums = [F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_distinct")]
    bins = placed(counted.groupBy(*by, cell(1).alias("_next")).agg(*sums), by).withColumn("n", F.sum("_bc").over(Window.partitionBy(*by)))
    at = (F.col("n") - 1) * level
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("_t"), r.cast("long").alias("_rank")) for k, r in enumerate((F.floor(at), F.ceil(at)))]))
    bins = bins.select(*by, "_next", "_bc", "_distinct", "_before", "n", (at - F.floor(at)).alias("_w"), ranks.alias("_r")).select("*", "_r.*").drop("_r")
    holds = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_bc"))
    found = [*by, "n", "_w", "_t", F.col("_next").alias("_cell"), (F.col("_rank") - F.col("_before")).alias("_rank"), "_distinct"]
    targets = materialise(bins.filter(holds).select(*found), "cells")
    digits = 1
    while digits < 5 and (targets.agg(F.max("_distinct")).first()[0] or 0) > most:
        inside = spread_join(counted.withColumn("_cell", cell(digits)), targets.select(*by, "_cell").distinct(), [*by, "_cell"])
        bins = placed(inside.groupBy(*by, "_cell", cell(digits + 1).alias("_next")).agg(*sums), [*by, "_cell"])
        targets = materialise(bins.join(targets.drop("_distinct"), [*by, "_cell"]).filter(holds).select(*found), "cells")
        digits += 1
    inside = spread_join(counted.withColumn("_cell", cell(digits)), targets.select(*by, "_cell").distinct(), [*by, "_cell"])
    upto = Window.partitionBy(*by, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = inside.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).withColumnRenamed("_c", "_bc")
    picked = ranked.join(targets, [*by, "_cell"]).filter(holds).groupBy(*by).agg(
        F.max("n").alias("n"), F.max("_w").alias("_w"),
        *[F.max(F.when(F.col("_t") == k, F.col("_v"))).alias(c) for k, c in enumerate(("_a", "_b"))],
    )
    return picked.select(*by, "n", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias(out))


def conformal_threshold(
    calib: DataFrame, alpha: float = 0.1, by: Sequence[str] = (*SERIES, "fold"), min_rows: int = MIN_CALIBRATION
) -> DataFrame:
    """Threshold per group from calibration rows with ``y_true`` and ``y_prob``.

    Non-conformity is ``1 - p_true``; the level is ``min(1, ceil((n + 1)(1 - alpha)) / n)``. Groups
    with fewer than ``min_rows`` rows get a null threshold.
    """
    p_true = F.when(F.col("y_true") == 1, F.col("y_prob")).otherwise(1 - F.col("y_prob"))
    scored = calib.withColumn("ncf", 1 - p_true)
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * F.lit(1 - alpha)) / F.col("n"))
    q = quantile_per_group(scored, by, "ncf", level, "threshold")
    return q.withColumn("threshold", F.when(F.col("n") >= min_rows, F.col("threshold"))).withColumnRenamed("n", "n_cal")


def conformal_members(p: Column, threshold: Column) -> tuple[Column, Column]:
    """Membership of class 0 and class 1; without a threshold, the likelier class alone."""
    single = (p >= 0.5)
    zero = F.when(threshold.isNull(), (~single).cast("int")).otherwise((1 - (1 - p) <= threshold).cast("int"))
    one = F.when(threshold.isNull(), single.cast("int")).otherwise((1 - p <= threshold).cast("int"))
    return zero, one


def with_conformal_set(preds: DataFrame, thresholds: DataFrame, by: Sequence[str] = (*SERIES, "fold")) -> DataFrame:
    """Add ``in_set_0`` and ``in_set_1``. Sets may hold zero, one or two classes.

    The small threshold table is joined on salted keys, so one hot group does not meet in one task.
    """
    joined = spread_join(preds, thresholds.select(*by, "threshold"), by, "left")
    zero, one = conformal_members(F.col("y_prob"), F.col("threshold"))
    return joined.withColumns({"in_set_0": zero, "in_set_1": one})
