"""The live path in Structured Streaming: messages -> closed candles -> features -> positions."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from barframe.operators.features import FEATURE_COLUMNS, with_time_features
from barframe.operators.news import DAY_MS, aggregate_news_for_bars, score_news, unscored
from barframe.operators.positions import RUIN, gate, position_size
from barframe.schema import SERIES, TS
from barframe.sources.candles import bars_from_events, closed_only, parse_kline_messages, with_ingested_at
from barframe.sources.sinks import upsert_ohlcv

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store; they are shipped by value, because the process
    that plans a stateful query does not see files added to the application."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --------------------------------------------------------------------------- sources and stateless steps
def stream_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Kline messages landed as text files, one JSON message per line."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def stream_candles(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Closed candles from landed messages, stamped with the ingest time."""
    return with_ingested_at(closed_only(parse_kline_messages(stream_messages(spark, path, max_files), "value")))


def stream_table(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """A Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    for name, value in (("pathGlobFilter", glob), ("maxFilesPerTrigger", max_files)):
        if value is not None:
            reader = reader.option(name, value)
    return reader.parquet(path)


def drop_resent(candles: DataFrame, delay: str = "2 hours", order: str = "ingested_at") -> DataFrame:
    """One row per candle, the latest by ``order`` of those sent within the watermark delay.

    A candle comes out once the watermark has passed it; re-sends after that are settled by the upsert.
    """
    key = [*SERIES, TS]
    row = F.struct(*[F.col(c) for c in candles.columns if c not in key]).alias("_row")
    latest = candles.withWatermark(TS, delay).select(*key, F.col(order).alias("_order"), row)
    latest = latest.groupBy(*key).agg(F.max_by("_row", "_order").alias("_row"))
    return latest.select(*[c if c in key else F.col(f"_row.{c}") for c in candles.columns])


def stream_bars(events: DataFrame, delay: str = "10 minutes", ts: str = "ts", **options) -> DataFrame:
    """Tumbling candles from a stream of raw events (same aggregation as the batch twin)."""
    return bars_from_events(events.withWatermark(ts, delay), ts=ts, **options)


def stream_scored_news(news: DataFrame, scorer=None) -> DataFrame:
    """Score arriving articles that have no sentiment yet."""
    return score_news(unscored(news), scorer)


# --------------------------------------------------------------------------- sinks
def _trigger(every: str | None) -> dict[str, Any]:
    return {"processingTime": every} if every else {"availableNow": True}


def sink_upsert(
    stream: DataFrame, root: str, checkpoint: str, every: str | None = None,
    upsert: Callable[[DataFrame, str], int] = upsert_ohlcv, mode: str = "append",
) -> StreamingQuery:
    """Upsert each micro-batch into the stored table; ``stream_status`` tells how many of its rows were persisted.

    The upsert is keyed, so a replayed micro-batch (after a lost driver) changes nothing. Without
    ``every`` the query works through what is there and stops: a bounded replay.
    """
    persisted = {"rows_persisted": 0, "last_persist_at": None}

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()  # the merge reads the batch twice
        try:
            persisted["rows_persisted"] += upsert(batch, root)
            persisted["last_persist_at"] = datetime.now(timezone.utc).isoformat()
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every)).start()
    )
    _PERSISTED[str(query.runId)] = persisted
    return query


def sink_parquet(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append each micro-batch to a Parquet folder (exactly once by the file sink's log), counting its rows for ``stream_status``."""
    return (
        stream.observe("persisted", F.count(F.lit(1)).alias("rows")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every)).start()
    )


def sink_news_features(
    bars: DataFrame, news: Callable[[], DataFrame], path: str, checkpoint: str, every: str | None = None,
    lookback_ms: int = DAY_MS, **options,
) -> StreamingQuery:
    """Attach the trailing news window to each micro-batch of bars.

    The stored news table is read per batch with a range filter on its publication time that covers
    just the batch's bars and the lookback before them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            span = batch.agg(F.min(F.unix_micros(TS)).alias("lo"), F.max(F.unix_micros(TS)).alias("hi")).collect()[0]
            if span["lo"] is None:
                return
            lo, hi = F.timestamp_micros(F.lit(span["lo"] - 1000 * lookback_ms)), F.timestamp_micros(F.lit(span["hi"]))
            near = news()
            if "date" in near.columns:  # stored by day: opens the days of the window only
                near = near.filter(F.col("date").between(F.date_format(lo, "yyyy-MM-dd"), F.date_format(hi, "yyyy-MM-dd")))
            near = near.filter((F.col("published_at") >= lo) & (F.col("published_at") < hi))
            features = aggregate_news_for_bars(near, batch, lookback_ms, **options)
            features.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()
    )


_NOTHING = {"messages_seen": 0, "batches": 0, "last_batch_at": None, "rows_persisted": 0, "last_persist_at": None}
_PERSISTED: dict[str, dict[str, Any]] = {}  # by run, of sinks that write for themselves


class _Totals(StreamingQueryListener):
    """Totals of every query since ``watch_progress``, however many batches it has run."""

    def __init__(self) -> None:
        self.by_run: dict[str, dict[str, Any]] = {}

    def onQueryStarted(self, event) -> None:
        self.by_run.setdefault(str(event.runId), dict(_NOTHING))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        totals = self.by_run.setdefault(str(p.runId), dict(_NOTHING))
        totals["messages_seen"] += p.numInputRows
        totals["batches"] += p.numInputRows > 0
        totals["last_batch_at"] = p.timestamp
        written = p.observedMetrics.get("persisted")
        if written is not None and written["rows"]:
            totals["rows_persisted"] += written["rows"]
            totals["last_persist_at"] = p.timestamp

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watch_progress(spark: SparkSession) -> None:
    """Start counting the progress of the session's queries (once); call before starting a query."""
    if not hasattr(spark, "_barframe_totals"):
        spark._barframe_totals = _Totals()
        spark.streams.addListener(spark._barframe_totals)


def stream_status(query: StreamingQuery, spark: SparkSession) -> dict[str, Any]:
    """Messages read in all batches of this run, batches with input, time of the last batch; rows persisted by its sink and when."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)  # progress arrives by the session's event bus
    run = str(query.runId)
    return {"running": query.isActive, **spark._barframe_totals.by_run.get(run, _NOTHING), **_PERSISTED.get(run, {})}


# --------------------------------------------------------------------------- keyed state: features
_KEEP = 169  # closes needed for the 168-bar volatility
_BAR = ["open", "high", "low", "close", "volume", "taker_buy_base"]
_NUMERIC = [c for c in FEATURE_COLUMNS if c not in ("hod_sin", "hod_cos", "dow_sin", "dow_cos")]
FEATURE_STREAM = T.StructType(
    [T.StructField("pair", T.StringType()), T.StructField("interval", T.StringType()), T.StructField(TS, T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in [*_BAR, *_NUMERIC, "vol_24", "vol_168"]]
    + [T.StructField("pos", T.LongType()), T.StructField("late", T.BooleanType())]
)


_CHUNK = 128  # bars of a running average evaluated at a time


def _div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quotients, nan for a zero divisor."""
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=np.asarray(b) != 0)


class _BarState:
    """Tail of a series plus its running averages; ``extend`` evaluates any number of new bars from them at once."""

    AVERAGES = ("up", "down", "tr", "fast", "slow", "signal")

    def __init__(self, seen: int, closes: list[float], volumes: list[float], averages: list[float]):
        self.seen, self.closes, self.volumes = seen, closes, volumes
        self.averages = dict(zip(self.AVERAGES, averages or [math.nan] * len(self.AVERAGES)))

    def _ema(self, name: str, x: np.ndarray, alpha: float) -> np.ndarray:
        """y = alpha x + (1 - alpha) y before, started by the first x: per chunk a weighted sum of its x and the decayed y before."""
        out, last = np.empty(len(x)), self.averages[name]
        done = 0
        if math.isnan(last) and len(x):
            out[0] = last = x[0]
            done = 1
        powers = (1 - alpha) ** np.arange(_CHUNK + 1)
        weights = np.tril(alpha * powers[np.abs(np.subtract.outer(np.arange(_CHUNK), np.arange(_CHUNK)))])
        for lo in range(done, len(x), _CHUNK):
            part = x[lo : lo + _CHUNK]
            out[lo : lo + len(part)] = weights[: len(part), : len(part)] @ part + powers[1 : len(part) + 1] * last
            last = out[lo + len(part) - 1]
        self.averages[name] = float(last)
        return out

    def extend(self, bars: np.ndarray) -> dict[str, np.ndarray]:
        """Features of the new bars, rows of ``_BAR`` in time order, and the state after them."""
        _, high, low, close, volume, taker = bars.T
        m, had = len(bars), len(self.closes)
        c, v = np.append(self.closes, close), np.append(self.volumes, volume)
        n = self.seen + np.arange(m)

        def windows(x: np.ndarray, width: int, tail: int, measure) -> np.ndarray:
            """A measure of the ``width`` values up to each new bar; nan where there are fewer."""
            x, short = x[max(tail - width + 1, 0) :], max(width - 1 - tail, 0)
            out = np.full(m, np.nan)
            if len(x) >= width:
                out[short:] = measure(np.lib.stride_tricks.sliding_window_view(x, width))
            return out

        def before(k: int) -> np.ndarray:
            return np.append(np.full(max(k - had, 0), np.nan), c[max(had - k, 0) : had - k + m])[:m] if had - k + m > 0 else np.full(m, np.nan)

        with np.errstate(all="ignore"):
            out = {}
            for k in (1, 2, 3, 5, 10, 20):
                ratio = _div(close, before(k))
                out[f"ret_{k}"] = np.log(np.where(ratio > 0, ratio, np.nan))
            for w in (5, 10, 20, 50):
                least, most = (windows(c, w, had, lambda x, f=f: f(x, axis=1)) for f in (np.min, np.max))
                out[f"sma_{w}"] = windows(c, w, had, lambda x: x.mean(axis=1))
                out[f"std_{w}"] = np.where(most > least, windows(c, w, had, lambda x: x.std(axis=1)), most - least)
                out[f"band_pos_{w}"] = _div(close - least, most - least)
            out["bb_pct_b"] = _div(close - (out["sma_20"] - 2 * out["std_20"]), 4 * out["std_20"])
            for w in (10, 50):
                out[f"vol_ratio_{w}"] = _div(volume, windows(v, w, len(self.volumes), lambda x: x.mean(axis=1)))
            out["taker_buy_share"] = _div(taker, volume)
            prev = before(1)
            later = n > 0
            moves = (close - prev)[later]
            rs = np.full(m, np.nan)
            up, down = self._ema("up", np.maximum(moves, 0.0), 1 / 14), self._ema("down", np.maximum(-moves, 0.0), 1 / 14)
            rs[later] = _div(up, down)
            spans = np.abs(np.stack([high - low, high - prev, low - prev]))
            spans[1:, ~later] = 0.0
            true_range = self._ema("tr", spans.max(axis=0), 1 / 14)
            out["rsi_14"] = np.where(n >= 14, 100 - 100 / (1 + rs), np.nan)
            out["atr_14"] = np.where(n >= 13, true_range, np.nan)
            out["macd"] = self._ema("fast", close, 2 / 13) - self._ema("slow", close, 2 / 27)
            out["macd_signal"] = self._ema("signal", out["macd"], 2 / 10)
            out["macd_hist"] = out["macd"] - out["macd_signal"]
            positive = np.where(c > 0, c, np.nan)
            moved = np.log(positive[1:] / positive[:-1])
            for width in (24, 168):  # moves lag closes by one; a first bar has none
                spread = windows(np.append(np.nan, moved) if had == 0 else moved, width, had if had == 0 else had - 1, lambda x: x.std(axis=1))
                out[f"vol_{width}"] = spread
        self.seen += m
        self.closes, self.volumes = c[-_KEEP:].tolist(), v[-50:].tolist()
        return out


class _FeatureProcessor(StatefulProcessor):
    """Keeps the tail of one series, and bars newer than the holding time, and emits the features of each bar in order."""

    def __init__(self, hold_ms: int):
        self.hold = hold_ms * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "tail", "times array<bigint>, seen bigint, closes array<double>, volumes array<double>, averages array<double>, "
            "held_at array<bigint>, held array<double>"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[float]] = {}
        times: list[int] = []
        tail = _BarState(0, [], [], [])
        if self.state.exists():
            kept, seen, closes, volumes, averages, held_at, held = self.state.get()
            times, tail = list(kept), _BarState(seen, list(closes), list(volumes), list(averages))
            waiting = {at: list(held[k * len(_BAR) : (k + 1) * len(_BAR)]) for k, at in enumerate(held_at)}
        for part in rows:
            waiting.update(zip(part[TS].astype("datetime64[ns]").astype("int64").tolist(), part[_BAR].astype(float).to_numpy().tolist()))
        newest, known = max([*times[-1:], *waiting]), set(times)
        ready = [at for at in sorted(waiting) if not self.hold or at <= newest - self.hold]  # before later ones an earlier bar may still come
        bars = {at: waiting.pop(at) for at in ready}
        fresh = [at for at in ready if at not in known]  # the others are candles sent again
        late = [at for at in fresh if times and at < times[-1]]
        new = fresh[len(late) :]
        held_at = sorted(waiting)
        if fresh:
            values = np.array([bars[at] for at in fresh])
            frame = pd.DataFrame({"pair": key[0], "interval": key[1], TS: pd.to_datetime(fresh)} | dict(zip(_BAR, values.T)))
            frame["late"] = np.arange(len(fresh)) < len(late)
            frame["pos"] = pd.array([None] * len(late) + list(range(tail.seen, tail.seen + len(new))), "Int64")
            if new:
                for name, column in tail.extend(values[len(late) :]).items():
                    frame[name] = np.append(np.full(len(late), np.nan), column)
            times = [*times, *new][-_KEEP:]
        self.state.update((times, tail.seen, tail.closes, tail.volumes, list(tail.averages.values()), held_at, [v for at in held_at for v in waiting[at]]))
        if fresh:
            yield frame.reindex(columns=[f.name for f in FEATURE_STREAM.fields])

    def close(self) -> None:
        pass


def stream_features(candles: DataFrame, hold_ms: int = 0) -> DataFrame:
    """Features of each new closed candle from keyed state; values equal the batch features.

    The state of a series is its last 169 closes, 50 volumes and six running averages, whatever its length, and the bars
    of the last ``hold_ms``: these wait for earlier ones still on their way. A bar that comes after a newer one was
    worked in is returned without features, as ``late``; one whose time is in the state already is a re-sent candle.
    """
    use_state_store(candles.sparkSession)
    raw = candles.select(*SERIES, TS, *_BAR).groupBy(*SERIES).transformWithStateInPandas(
        statefulProcessor=_FeatureProcessor(hold_ms), outputStructType=FEATURE_STREAM, outputMode="Append", timeMode="None"
    )
    clean = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in [*_NUMERIC, "vol_24", "vol_168"]}
    return with_time_features(raw.withColumns(clean))


# --------------------------------------------------------------------------- keyed state: positions
POSITION_STREAM = T.StructType([
    T.StructField("pair", T.StringType()), T.StructField("interval", T.StringType()), T.StructField(TS, T.TimestampType()),
    T.StructField("close", T.DoubleType()), T.StructField("p_up", T.DoubleType()), T.StructField("decision", T.StringType()),
    T.StructField("size_pct", T.DoubleType()), T.StructField("traded", T.BooleanType()), T.StructField("balance", T.DoubleType()),
    T.StructField("bars_seen", T.LongType()), T.StructField("bars_traded", T.LongType()),
    T.StructField("settled_pnl_pct", T.DoubleType()), T.StructField("previous_correct", T.BooleanType()),
])


class _PositionProcessor(StatefulProcessor):
    """Settles the open position at each bar's close, then opens the next one."""

    def __init__(self, initial: float):
        self.initial = initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "book", "last bigint, close double, balance double, side double, size double, predicted int, seen bigint, traded bigint"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).drop_duplicates(TS, keep="last").sort_values(TS)
        last, close, balance, side, size, predicted, seen, traded = (
            self.state.get() if self.state.exists() else (None, math.nan, self.initial, 0.0, 0.0, -1, 0, 0)
        )
        out = []
        for row in batch.itertuples(index=False):
            at = getattr(row, TS).value
            if last is not None and at <= last:
                continue
            price, pnl, correct = float(row.close), math.nan, None
            if seen:
                move = (price - close) / close if close else math.nan
                correct = bool((price > close) == bool(predicted))
                if side:
                    pnl = side * move
                    balance += balance * size * pnl
            last, close, seen = at, price, seen + 1
            predicted = int(row.p_up >= 0.5)
            open_now = row.decision != "flat" and balance > RUIN
            side = {"long": 1.0, "short": -1.0}.get(row.decision, 0.0) if open_now else 0.0
            size = float(row.size_pct)
            traded += open_now
            out.append((key[0], key[1], getattr(row, TS), price, float(row.p_up), row.decision, size, open_now, balance, seen, traded, pnl, correct))
        if out:
            self.state.update((last, close, balance, side, size, predicted, seen, traded))
            yield pd.DataFrame(out, columns=[f.name for f in POSITION_STREAM.fields])

    def close(self) -> None:
        pass


def stream_positions(predictions: DataFrame, initial: float = 100.0) -> DataFrame:
    """Gate, size and settle predictions per series from keyed state; equals ``equity_curve``.

    Input per bar: ``close, p_up, in_set_0, in_set_1, vol_24, vol_168``.
    """
    use_state_store(predictions.sparkSession)
    decided = predictions.select(
        *SERIES, TS, "close", "p_up",
        gate(F.col("in_set_1").cast("boolean"), F.col("in_set_0").cast("boolean")).alias("decision"),
        position_size(F.col("vol_24"), F.col("vol_168")).alias("size_pct"),
    )
    out = decided.groupBy(*SERIES).transformWithStateInPandas(
        statefulProcessor=_PositionProcessor(initial), outputStructType=POSITION_STREAM, outputMode="Append", timeMode="None"
    )
    return out.withColumn("settled_pnl_pct", F.nanvl("settled_pnl_pct", F.lit(None).cast("double")))
