"""Bar features. Every value at time t uses rows at or before t only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.functions.scalar import cyclic, ratio, safe_ln
from barframe.operators.series import BLOCK_ROWS, Frame, Rolling, ema_memory, ema_steps, over_rows, with_position
from barframe.schema import SERIES, TS

WARMUP_ROWS = 50
RETURN_LAGS = (1, 2, 3, 5, 10, 20)
ROLLING = (5, 10, 20, 50)
VOLUME_WINDOWS = (10, 50)
BASE_COLUMNS = ["open", "high", "low", "close", "volume", "taker_buy_base"]
FEATURE_COLUMNS = (
    [f"ret_{k}" for k in RETURN_LAGS]
    + [f"{s}_{w}" for w in ROLLING for s in ("sma", "std", "band_pos")]
    + ["rsi_14", "macd", "macd_signal", "macd_hist", "atr_14", "bb_pct_b"]
    + [f"vol_ratio_{w}" for w in VOLUME_WINDOWS]
    + ["taker_buy_share", "hod_sin", "hod_cos", "dow_sin", "dow_cos"]
)


# --------------------------------------------------------------------------- column sets per frame
def _returns(f: Frame, lags: Sequence[int]) -> dict[str, Column]:
    return {f"ret_{k}": safe_ln(ratio(F.col("close"), f.lag("close", k))) for k in lags}


def _rolling(stats: Rolling, windows: Sequence[int]) -> dict[str, Column]:
    out = {}
    for w in windows:
        low, high = stats.low(w), stats.high(w)
        out |= {f"sma_{w}": stats.mean(w), f"std_{w}": stats.std(w), f"band_pos_{w}": ratio(F.col("close") - low, high - low)}
    return out


def _bollinger(stats: Rolling, width: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, dev = stats.mean(width), stats.std(width)
    return {"bb_pct_b": ratio(F.col("close") - (mid - dev * k), dev * (2 * k))}


def _volume(stats: Rolling, windows: Sequence[int]) -> dict[str, Column]:
    out = {f"vol_ratio_{w}": ratio(F.col("volume"), stats.mean(w)) for w in windows}
    return out | {"taker_buy_share": ratio(F.col("taker_buy_base"), F.col("volume"))}


def _true_range(f: Frame) -> dict[str, Column]:
    prev = f.lag("close")
    return {
        "_tr": F.greatest(
            F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
        )
    }


def _moves(f: Frame) -> dict[str, Column]:
    delta = F.col("close") - f.lag("close")
    return {
        "_up": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
        "_down": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
    }


def _merge(*step_lists):
    """Zip several step lists, so that independent averages advance in the same projections."""
    length = max(len(s) for s in step_lists)

    def combined(i):
        def build(f: Frame) -> dict[str, Column]:
            out: dict[str, Column] = {}
            for steps in step_lists:
                if i < len(steps):
                    out.update(steps[i](f))
            return out

        return build

    return [combined(i) for i in range(length)]


def _rsi_value(period: int) -> Column:
    rs = ratio(F.col("_rsi_up"), F.col("_rsi_down"))
    return F.lit(100.0) - F.lit(100.0) / (rs + 1.0)


def _rsi_steps(period: int):
    up = ema_steps("_rsi_up", "_up", 1.0 / period, period)
    down = ema_steps("_rsi_down", "_down", 1.0 / period, period)
    return [_moves, *_merge(up, down), lambda f: {f"rsi_{period}": _rsi_value(period)}]


def _macd_steps(fast: int, slow: int, signal: int):
    return [
        *_merge(ema_steps("_fast", "close", 2 / (fast + 1)), ema_steps("_slow", "close", 2 / (slow + 1))),
        lambda f: {"macd": F.col("_fast") - F.col("_slow")},
        *ema_steps("macd_signal", "macd", 2 / (signal + 1)),
        lambda f: {"macd_hist": F.col("macd") - F.col("macd_signal")},
    ]


def _atr_steps(period: int):
    return [_true_range, *ema_steps(f"atr_{period}", "_tr", 1.0 / period, period)]


def _macd_memory(fast: int, slow: int, signal: int) -> int:
    return max(ema_memory(2 / (fast + 1)), ema_memory(2 / (slow + 1))) + ema_memory(2 / (signal + 1))


def _public(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


# --------------------------------------------------------------------------- single operators
def with_log_returns(df: DataFrame, lags: Sequence[int] = RETURN_LAGS, block: int = BLOCK_ROWS) -> DataFrame:
    """``ret_k = ln(close / close[-k])``."""
    return over_rows(df, lambda f: _returns(f, lags), before=max(lags), block=block)


def with_rolling_stats(df: DataFrame, windows: Sequence[int] = ROLLING, block: int = BLOCK_ROWS) -> DataFrame:
    """Mean, population deviation and band position over full windows."""
    stats = Rolling("c", "close", windows, extremes=True)
    steps = [*stats.steps, lambda f: _rolling(stats, windows)]
    return _public(over_rows(df, steps, before=max(windows) - 1, block=block))


def with_rsi(df: DataFrame, period: int = 14, block: int = BLOCK_ROWS) -> DataFrame:
    """Wilder RSI; null until ``period`` moves were seen and while the average loss is 0."""
    out = over_rows(df, _rsi_steps(period), before=ema_memory(1.0 / period) + 1, block=block)
    return _public(out)


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, block: int = BLOCK_ROWS) -> DataFrame:
    """MACD line, signal line and histogram."""
    before = _macd_memory(fast, slow, signal)
    return _public(over_rows(df, _macd_steps(fast, slow, signal), before=before, block=block))


def with_atr(df: DataFrame, period: int = 14, block: int = BLOCK_ROWS) -> DataFrame:
    """Wilder average of the true range; the first row's range is high - low."""
    return _public(over_rows(df, _atr_steps(period), before=ema_memory(1.0 / period) + 1, block=block))


def with_bollinger(df: DataFrame, width: int = 20, k: float = 2.0, block: int = BLOCK_ROWS) -> DataFrame:
    """Position of the close inside the Bollinger band (``bb_pct_b``)."""
    stats = Rolling("c", "close", [width], extremes=True)
    return _public(over_rows(df, [*stats.steps, lambda f: _bollinger(stats, width, k)], before=width - 1, block=block))


def with_volume_features(
    df: DataFrame, windows: Sequence[int] = VOLUME_WINDOWS, block: int = BLOCK_ROWS
) -> DataFrame:
    """Volume relative to its rolling mean, and the taker share of volume."""
    stats = Rolling("v", "volume", windows, spread=False)
    return _public(over_rows(df, [*stats.steps, lambda f: _volume(stats, windows)], before=max(windows) - 1, block=block))


def with_time_features(df: DataFrame, ts: str = TS) -> DataFrame:
    """Hour of day and day of week (Monday = 0) as sine and cosine."""
    hod_sin, hod_cos = cyclic(F.hour(ts), 24)
    dow_sin, dow_cos = cyclic(F.weekday(F.col(ts)), 7)
    return df.withColumns({"hod_sin": hod_sin, "hod_cos": hod_cos, "dow_sin": dow_sin, "dow_cos": dow_cos})


def with_realised_vol(df: DataFrame, bars: int, name: str | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """Population deviation of the last ``bars`` log returns; null with fewer earlier bars."""
    return _public(over_rows(df, realised_vol_steps({name or f"vol_{bars}": bars}), before=bars, block=block))


def _last_return(f: Frame) -> dict[str, Column]:
    return {"_ret": safe_ln(ratio(F.col("close"), f.lag("close")))}


def realised_vol_steps(names: dict[str, int]):
    """Steps computing several realised volatilities in one pass."""
    stats = Rolling("r", "_ret", list(names.values()))
    return [_last_return, *stats.steps, lambda f: {name: stats.std(n) for name, n in names.items()}]


def regime_inputs(df: DataFrame, vol_window: int = 24, block: int = BLOCK_ROWS) -> DataFrame:
    """``log_return`` and its rolling sample deviation; rows without both are dropped."""
    stats = Rolling("r", "_ret", [vol_window])
    steps = [_last_return, *stats.steps, lambda f: {"log_return": F.col("_ret"), "vol": stats.std(vol_window, ddof=1)}]
    return _public(over_rows(df, steps, before=vol_window, block=block)).dropna(subset=["log_return", "vol"])


# --------------------------------------------------------------------------- whole feature frame
def trim_warmup(df: DataFrame, rows: int = WARMUP_ROWS, pos: str = "pos") -> DataFrame:
    """Drop the first ``rows`` bars of each series."""
    return df.filter(F.col(pos) >= rows)


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where any of ``cols`` is null, NaN or infinite."""
    return df.filter(" AND ".join(f"`{c}` - `{c}` = 0" for c in cols))  # null, NaN or false unless finite


def compute_features(df: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """All 31 engineered columns for positioned bars, in one shuffle and one sort.

    Input rows need ``pos`` (see ``with_position``); nothing is trimmed or dropped here.
    """

    closes = Rolling("c", "close", ROLLING, extremes=True)
    volumes = Rolling("v", "volume", VOLUME_WINDOWS, spread=False)
    averages = [
        ema_steps("_rsi_up", "_up", 1 / 14, 14), ema_steps("_rsi_down", "_down", 1 / 14, 14),
        ema_steps("atr_14", "_tr", 1 / 14, 14),
        ema_steps("_fast", "close", 2 / 13), ema_steps("_slow", "close", 2 / 27),
    ]
    recursive = [
        lambda f: {**_returns(f, RETURN_LAGS), **_true_range(f), **_moves(f)},
        *_merge(*averages),
        lambda f: {"macd": F.col("_fast") - F.col("_slow"), "rsi_14": _rsi_value(14)},
        *ema_steps("macd_signal", "macd", 2 / 10),
    ]
    final = lambda f: {
        "macd_hist": F.col("macd") - F.col("macd_signal"),
        **_rolling(closes, ROLLING), **_bollinger(closes), **_volume(volumes, VOLUME_WINDOWS),
    }
    steps = [*_merge(recursive, closes.steps, volumes.steps), final]
    before = max(_macd_memory(12, 26, 9), ema_memory(1 / 14) + 1, max(ROLLING))
    return with_time_features(_public(over_rows(df, steps, before=before, block=block)))


def build_features(bars: DataFrame, drop_warmup: bool = True, block: int = BLOCK_ROWS) -> DataFrame:
    """Feature frame of deduplicated bars: positions, features, warmup trim, incomplete rows dropped."""
    keep = [*SERIES, TS, *BASE_COLUMNS]
    positioned = with_position(bars.select(*keep), rows=block, total=None)
    features = compute_features(positioned, block=block)
    if drop_warmup:
        features = trim_warmup(features)
    return drop_incomplete(features, [*BASE_COLUMNS, *FEATURE_COLUMNS])
