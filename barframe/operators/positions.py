"""Gated, volatility-sized positions as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.operators.features import realised_vol_steps
from barframe.operators.metrics import accuracy_stats, trade_counters, validity_stats
from barframe.operators.series import BLOCK_ROWS, over_rows, running, with_position
from barframe.operators.tables import top_n_per
from barframe.schema import SERIES, TS

RUIN = 0.01


def gate(up: Column, down: Column) -> Column:
    """``long`` / ``short`` on a singleton set, ``flat`` on an empty or double one (null reads as out)."""
    up, down = F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))
    return F.when(up & ~down, "long").when(down & ~up, "short").otherwise("flat")


def direction(decision: Column) -> Column:
    """+1 long, -1 short, 0 flat."""
    return F.when(decision == "long", 1.0).when(decision == "short", -1.0).otherwise(0.0)


def position_size(
    vol_short: Column, vol_long: Column, target: float = 1.0, low: float = 0.1, high: float = 1.0
) -> Column:
    """Inverse-volatility size ``clip(target * vol_long / vol_short, low, high)``.

    A missing or non-positive short volatility gives ``target``; such a long one a ratio of 1.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v <= 0)
    scale = F.when(bad(vol_long), F.lit(1.0)).otherwise(vol_long / vol_short)
    return F.when(bad(vol_short), F.lit(target)).otherwise(
        F.greatest(F.lit(low), F.least(F.lit(high), F.lit(target) * scale))
    )


def bar_outcomes(preds: DataFrame, bars: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Join predictions to bars and derive everything a bar's trade needs, in one pass over the bars.

    ``preds`` needs ``p_up, in_set_0, in_set_1`` per bar. Bars without a prediction stay out, so the
    next bar is the next *predicted* bar. Adds decision, volatilities (over all bars), size, the
    exit at the next bar and the per-bar growth factor of the balance.
    """
    key = [*SERIES, TS]
    vols = over_rows(
        with_position(bars.select(*key, "close"), rows=block, total=None),
        realised_vol_steps({"vol_24": 24, "vol_168": 168}), before=168, block=block,
    )
    vols = vols.select(*key, "close", "vol_24", "vol_168")
    wanted = preds.select(*key, "p_up", "in_set_0", "in_set_1", *[c for c in ("regime",) if c in preds.columns])
    joined = with_position(vols.join(wanted, key), rows=block, total=None)
    up, down = F.col("in_set_1").cast("boolean"), F.col("in_set_0").cast("boolean")
    joined = joined.withColumns(
        {
            "decision": gate(up, down),
            "cp_singleton": F.coalesce(up, F.lit(False)) != F.coalesce(down, F.lit(False)),
            "predicted": (F.col("p_up") >= 0.5).cast("int"),
            "size_pct": position_size(F.col("vol_24"), F.col("vol_168")),
        }
    )
    ahead = over_rows(
        joined, lambda f: {"exit_time": f.lead(TS), "exit_price": f.lead("close")}, after=1, block=block
    )
    move = (F.col("exit_price") - F.col("close")) / F.nullif(F.col("close"), F.lit(0.0))
    return ahead.withColumn("pnl_pct", direction(F.col("decision")) * move)


def equity_curve(outcomes: DataFrame, initial: float = 100.0, block: int = BLOCK_ROWS) -> DataFrame:
    """Balance after each bar, trading stopped once it is at or below 0.01.

    A position lasts exactly one bar, so the balance is the running product of ``1 + size dir ret``
    over earlier bars. The first bar at which that product falls to the limit freezes it; both are
    block-carried running values. Adds ``balance`` and ``traded``.
    """
    growth = 1.0 + F.col("size_pct") * F.coalesce("pnl_pct", F.lit(0.0))
    free = running(outcomes, {"_p": ("product", growth)}, block=block, exclusive=True)
    free = free.withColumn("_b", F.lit(float(initial)) * F.col("_p"))
    ruin = F.when(F.col("_b") <= RUIN, F.struct(F.col("pos").alias("at"), F.col("_b").alias("b")))
    held = running(free, {"_ruin": ("min", ruin)}, block=block)
    balance = F.coalesce(F.col("_ruin.b"), F.col("_b"))
    traded = (F.col("decision") != "flat") & F.col("_ruin").isNull()
    return held.withColumns({"balance": balance, "traded": traded}).drop("_p", "_b", "_ruin")


def trade_table(equity: DataFrame) -> DataFrame:
    """Closed trades: opened at a bar's close, closed at the next bar's close."""
    dollars = F.col("balance") * F.col("size_pct")
    closed = equity.filter(F.col("traded") & F.col("exit_price").isNotNull())
    pnl = dollars * F.col("pnl_pct")
    regime = ["regime"] if "regime" in equity.columns else []
    return closed.select(
        *SERIES, F.col("decision").alias("direction"), F.col(TS).alias("entry_time"), "exit_time",
        F.col("close").alias("entry_price"), "exit_price", dollars.alias("dollars"), "size_pct",
        pnl.alias("pnl_dollars"), "pnl_pct", (pnl > 0).alias("hit"), "p_up", *regime,
        (F.col("balance") + pnl).alias("balance"),
    )


def running_pnl(trades: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Cumulative dollar P&L over closed trades."""
    numbered = with_position(trades, ts="exit_time", rows=block, total=None)
    return running(numbered, {"pnl_running": ("sum", F.col("pnl_dollars"))}, block=block)


def prediction_log(outcomes: DataFrame) -> DataFrame:
    """Every prediction with its outcome: actual direction and correctness stay null on the last bar."""
    actual = F.when(F.col("exit_price").isNotNull(), (F.col("exit_price") > F.col("close")).cast("int"))
    extra = [c for c in ("traded", "balance", "pos") if c in outcomes.columns]
    return outcomes.select(
        *SERIES, TS, F.col("close").alias("close_price"), "p_up", F.col("predicted").alias("predicted_direction"),
        "cp_singleton", "decision", actual.alias("actual_direction"),
        (actual == F.col("predicted")).alias("correct"), *extra,
    )


def running_accuracy(log: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Share of correct predictions so far, over labelled rows."""
    labelled = log.filter(F.col("correct").isNotNull()).drop("pos")
    numbered = with_position(labelled, rows=block, total=None)
    summed = running(numbered, {"_hits": ("sum", F.col("correct").cast("int"))}, block=block)
    return summed.withColumn("running_accuracy", F.col("_hits") / (F.col("pos") + 1)).drop("_hits")


def snapshot(
    equity: DataFrame, trades: DataFrame, log: DataFrame, n_trades: int = 20, n_equity: int = 500
) -> DataFrame:
    """State of every series in one row: counters, statistics, open position, recent trades, equity tail."""
    by = list(SERIES)
    counters = trade_counters(equity)
    stats = validity_stats(trades).select(*by, F.struct("n_closed", "win_rate", "avg_return_pct", "sharpe_per_trade", "verdict").alias("stats"))
    accuracy = accuracy_stats(log)
    accuracy = accuracy.select(*by, F.struct(*[c for c in accuracy.columns if c not in by]).alias("accuracy"))
    last = top_n_per(equity, by, [F.col(TS).desc()], 1)
    opened = F.when(
        F.col("traded"),
        F.struct(
            F.col("decision").alias("direction"), F.col(TS).alias("entry_time"), F.col("close").alias("entry_price"),
            (F.col("balance") * F.col("size_pct")).alias("dollars"), "size_pct", "p_up",
        ),
    )
    last = last.select(*by, F.col("balance"), F.col(TS).alias("last_bar"), opened.alias("open_position"))
    recent = top_n_per(trades, by, [F.col("exit_time").desc()], n_trades).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("entry_time", "exit_time", "direction", "pnl_dollars", "pnl_pct", "hit"))).alias("recent_trades")
    )
    tail = top_n_per(equity, by, [F.col(TS).desc()], n_equity).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(TS).alias("open_time"), F.col("balance").alias("balance")))).alias("equity_curve")
    )
    out = counters
    for part in (last, stats, accuracy, recent, tail):
        out = out.join(part, by, "left")
    return out
