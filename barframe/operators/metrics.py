"""Forecast metrics, roll-ups and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.scalar import log_loss_term, p_bin, position_sign, verdict_accuracy, verdict_trades
from barframe.operators.tables import top_n_per
from barframe.schema import SERIES, TS, regime_name

RUN_KEY = (*SERIES, "model")
FOLD_KEY = (*RUN_KEY, "fold")
METRICS = [
    "accuracy", "precision", "recall", "f1", "mcc", "log_loss", "hit_rate", "pnl_log", "sharpe_per_bar",
]


def _or_zero(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def fold_metrics(preds: DataFrame, by: Sequence[str] = FOLD_KEY) -> DataFrame:
    """Classification, probability and trading metrics per group, in one aggregation pass."""
    y, p = F.col("y_true"), F.col("y_pred")
    pnl = position_sign(p) * F.col("next_ret")
    cells = preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.avg(log_loss_term(y, F.col("y_prob"))).alias("log_loss"),
        F.coalesce(F.sum(pnl), F.lit(0.0)).alias("pnl_log"), F.avg(pnl).alias("_m"),
        F.when(F.min(pnl) == F.max(pnl), 0.0).otherwise(F.stddev_pop(pnl)).alias("_s"),
    )
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    accuracy = (tp + tn) / F.col("n")
    precision, recall = _or_zero(tp, tp + fp), _or_zero(tp, tp + fn)
    mcc = _or_zero(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    return cells.select(
        *by, "n", accuracy.alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        _or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"), mcc.alias("mcc"), "log_loss",
        accuracy.alias("hit_rate"), "pnl_log",
        F.when(F.col("_s") > 0, F.col("_m") / F.col("_s")).otherwise(0.0).alias("sharpe_per_bar"),
    )


def aggregate_folds(metrics: DataFrame, by: Sequence[str] = RUN_KEY) -> DataFrame:
    """Row-weighted mean of each metric over folds; P&L is summed."""
    weighted = [
        (F.sum(F.col("n") * F.col(m)) / F.sum("n")).alias(m) if m != "pnl_log" else F.sum(m).alias(m)
        for m in METRICS
    ]
    return metrics.groupBy(*by).agg(
        F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_folds"), *weighted
    )


def conformal_stats(preds: DataFrame, by: Sequence[str] = FOLD_KEY) -> DataFrame:
    """Coverage, mean set size and singleton share per fold (needs ``in_set_0``, ``in_set_1``)."""
    zero, one = F.col("in_set_0").cast("int"), F.col("in_set_1").cast("int")
    covered = F.when(F.col("y_true") == 1, one).otherwise(zero)
    return preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(covered).alias("coverage"), F.avg(zero + one).alias("avg_set_size"),
        F.avg((zero + one == 1).cast("int")).alias("singletons"),
    )


def aggregate_conformal(stats: DataFrame, by: Sequence[str] = RUN_KEY) -> DataFrame:
    """Row-weighted conformal statistics over folds."""
    names = {"coverage": "cp_coverage", "avg_set_size": "cp_avg_set_size", "singletons": "cp_singleton_frac"}
    return stats.groupBy(*by).agg(
        *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(new) for c, new in names.items()]
    )


def summary_table(summary: DataFrame) -> DataFrame:
    """One row per (series, model), series ascending, accuracy descending."""
    return summary.orderBy(*[F.col(c).asc() for c in SERIES], F.col("accuracy").desc(), F.col("model").asc())


def regime_summary(regimes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bars and share per regime state, with the state's name."""
    counts = regimes.groupBy(*by, F.col("regime").alias("state")).agg(F.count(F.lit(1)).alias("n_bars"))
    total = F.sum("n_bars").over(Window.partitionBy(*by, F.lit(0)))  # over the few counted states
    return counts.select(
        *by, "state", regime_name(F.col("state")).alias("name"), "n_bars", (F.col("n_bars") / total).alias("share")
    )


def retention_matrix(preds: DataFrame, by: Sequence[str] = ("mode", "phase", "holdout")) -> DataFrame:
    """Accuracy of the model after each phase on each earlier holdout."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    return preds.filter(F.col("holdout") <= F.col("phase")).groupBy(*by).agg(
        F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def retention_summary(matrix: DataFrame, final_phase: int, base: str = "naive", other: str = "ewc") -> DataFrame:
    """Mean final accuracy of both training modes over all holdouts, and their difference."""
    final = matrix.filter(F.col("phase") == final_phase)
    means = final.agg(
        F.avg(F.when(F.col("mode") == base, F.col("accuracy"))).alias(base),
        F.avg(F.when(F.col("mode") == other, F.col("accuracy"))).alias(other),
    )
    return means.withColumn("delta", F.col(other) - F.col(base))


def channel_stats(images: DataFrame, col: str = "image", channels: int = 3) -> DataFrame:
    """Mean and deviation of each image channel over all pixels (variance floored at 1e-6).

    ``col`` is an array of ``channels`` flat pixel arrays. Sums are formed per row inside the array
    and then added with map-side combine; pixels never become rows.
    """
    aggs = []
    for c in range(channels):
        plane = F.col(col)[c]
        total = F.aggregate(plane, F.lit(0.0), lambda a, x: a + x)
        square = F.aggregate(plane, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        aggs += [F.sum(total).alias(f"_s{c}"), F.sum(square).alias(f"_q{c}"), F.sum(F.size(plane)).alias(f"_n{c}")]
    sums = images.agg(*aggs)
    row = []
    for c in range(channels):
        mean = F.col(f"_s{c}") / F.col(f"_n{c}")
        var = F.greatest(F.lit(1e-6), F.col(f"_q{c}") / F.col(f"_n{c}") - mean * mean)
        row.append(F.struct(F.lit(c).alias("channel"), mean.alias("mean"), F.sqrt(var).alias("std")))
    return sums.select(F.explode(F.array(*row)).alias("r")).select("r.*")


# --------------------------------------------------------------------------- prediction-log statistics
def accuracy_stats(log: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Accuracy over labelled predictions, split into confident (singleton set) and uncertain ones."""
    labelled = F.col("correct").isNotNull()
    confident = labelled & F.col("cp_singleton")
    hits = lambda cond: F.count_if(cond & F.col("correct"))
    base = log.groupBy(*by).agg(
        F.count_if(labelled).alias("n_labelled"), hits(labelled).alias("_h"),
        F.count_if(confident).alias("confident_count"), hits(confident).alias("_hc"),
    )
    n, nc = F.col("n_labelled"), F.col("confident_count")
    nu = n - nc
    overall = F.col("_h") / F.nullif(n, F.lit(0))
    return base.select(
        *by, "n_labelled", overall.alias("overall_accuracy"),
        (F.col("_hc") / F.nullif(nc, F.lit(0))).alias("confident_accuracy"),
        ((F.col("_h") - F.col("_hc")) / F.nullif(nu, F.lit(0))).alias("uncertain_accuracy"),
        "confident_count", nu.alias("uncertain_count"), verdict_accuracy(n, overall).alias("verdict"),
    )


def validity_stats(
    trades: DataFrame, window: int = 50, by: Sequence[str] = SERIES, initial_balance: float = 100.0
) -> DataFrame:
    """Quality of the last ``window`` closed trades per series.

    ``trades`` needs ``exit_time``, ``pnl_pct`` and ``balance`` (after the trade); total P&L compares
    the latest balance with the initial one.
    """
    recent = top_n_per(trades, by, [F.col("exit_time").desc()], window)
    std = F.stddev_samp("pnl_pct")
    spread = F.when(F.min("pnl_pct") == F.max("pnl_pct"), 0.0).otherwise(F.coalesce(std, F.lit(0.0)))
    stats = recent.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_closed"), F.avg((F.col("pnl_pct") > 0).cast("int")).alias("win_rate"),
        F.avg("pnl_pct").alias("avg_return_pct"), spread.alias("_sd"),
        (F.max_by("balance", "exit_time") - initial_balance).alias("pnl_total_dollars"),
    )
    sharpe = F.when(F.col("_sd") > 0, F.col("avg_return_pct") / F.col("_sd")).otherwise(0.0)
    return stats.select(
        *by, "n_closed", "win_rate", "avg_return_pct", sharpe.alias("sharpe_per_trade"), "pnl_total_dollars",
        verdict_trades(F.col("n_closed"), F.col("win_rate"), F.col("pnl_total_dollars")).alias("verdict"),
    )


def trade_counters(log: DataFrame, by: Sequence[str] = SERIES, initial_balance: float = 100.0) -> DataFrame:
    """Bars seen, traded and abstained, and total P&L (needs ``traded`` and ``balance`` per bar)."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bars_seen"), F.count_if("traded").alias("bars_traded"),
        F.count_if(~F.col("traded")).alias("bars_abstained"),
        (F.max_by("balance", TS) - initial_balance).alias("pnl_total_dollars"),
    )


def p_histogram(preds: DataFrame, bins: int = 12, p: str = "p_up") -> DataFrame:
    """Zero-filled histogram of probabilities; values outside [0, 1] are ignored."""
    counts = preds.select(p_bin(F.col(p), bins).alias("bin")).filter(F.col("bin").isNotNull())
    counts = counts.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    every = preds.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))
