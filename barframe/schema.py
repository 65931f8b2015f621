"""Fixed table schemas and constants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = ("pair", "interval")
TS = "open_time"

_D, _L, _S, _TS = T.DoubleType(), T.LongType(), T.StringType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CANDLE = _struct(
    ("open_time", _TS), ("open", _D), ("high", _D), ("low", _D), ("close", _D), ("volume", _D),
    ("close_time", _TS), ("quote_volume", _D), ("trades", _L),
    ("taker_buy_base", _D), ("taker_buy_quote", _D), ("ingested_at", _TS),
)
CANDLE_KEYED = T.StructType([T.StructField("pair", _S), T.StructField("interval", _S)] + CANDLE.fields)

SENTIMENT = _struct(("cryptobert", _D), ("finbert", _D), ("ensemble", _D), ("confidence", _D))

NEWS = _struct(
    ("id", _S), ("source", _S), ("title", _S), ("url", _S), ("summary", _S),
    ("published_at", _TS), ("ingested_at", _TS), ("tickers", T.ArrayType(_S)),
    ("raw_sentiment", T.MapType(_S, _L)), ("sentiment", _S),
)

EMBEDDING = _struct(("pair", _S), ("interval", _S), ("open_time", _TS), ("embedding", T.ArrayType(T.FloatType())))
REGIME = _struct(("pair", _S), ("interval", _S), ("open_time", _TS), ("regime", T.ShortType()))

FOLD_METRICS = _struct(
    ("fold", _L), ("n", _L), ("accuracy", _D), ("precision", _D), ("recall", _D), ("f1", _D), ("mcc", _D),
    ("log_loss", _D), ("hit_rate", _D), ("pnl_log", _D), ("sharpe_per_bar", _D),
)
CONFORMAL_FOLD = _struct(("fold", _L), ("coverage", _D), ("avg_set_size", _D), ("singletons", _D))
SUMMARY = _struct(
    ("pair", _S), ("interval", _S), ("model", _S), ("n_total", _L), ("n_folds", _L),
    ("accuracy", _D), ("precision", _D), ("recall", _D), ("f1", _D), ("mcc", _D), ("log_loss", _D),
    ("hit_rate", _D), ("pnl_log", _D), ("sharpe_per_bar", _D),
)

SENTIMENT_FEATURES = [
    "sent_count", "sent_mean", "sent_std", "sent_min", "sent_max", "sent_last", "sent_conf_mean",
]

# Exchange candle intervals in milliseconds.
INTERVAL_MS = {
    "1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000,
    "1h": 3_600_000, "2h": 7_200_000, "4h": 14_400_000, "6h": 21_600_000, "8h": 28_800_000,
    "12h": 43_200_000, "1d": 86_400_000, "3d": 259_200_000, "1w": 604_800_000,
}

# Regime ids.
REGIME_NAMES = {0: "bear", 1: "sideways", 2: "bull"}

# Ticker symbols counted for each pair.
PAIR_TICKERS = {
    "BTCUSDT": ["BTC"], "ETHUSDT": ["ETH"], "BNBUSDT": ["BNB"], "SOLUSDT": ["SOL"], "XRPUSDT": ["XRP"],
}


def regime_name(regime: Column) -> Column:
    """``bear`` / ``sideways`` / ``bull``; other ids read ``state_<id>``; null stays null."""
    named = F.create_map(*[F.lit(x) for pair in REGIME_NAMES.items() for x in pair])
    return F.when(
        regime.isNotNull(),
        F.coalesce(F.try_element_at(named, regime.cast("int")), F.concat(F.lit("state_"), regime.cast("string"))),
    )


def interval_ms(interval: Column) -> Column:
    """Length of an interval string in milliseconds; null for an unknown interval."""
    table = F.create_map(*[F.lit(x) for k, v in INTERVAL_MS.items() for x in (k, v)])
    return F.try_element_at(table, interval).cast("long")
