"""Candle sources: stored tables, REST payloads, stream messages, raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.operators.tables import dedupe
from barframe.schema import CANDLE_KEYED, INTERVAL_MS, SERIES, TS
from barframe.session import exists, settings


def read_ohlcv(
    spark: SparkSession, root: str, pair: str | None = None, interval: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Stored candles, one row per (pair, interval, open_time), the earliest ingested kept.

    ``pair``, ``interval`` and the month of ``start`` and ``end`` (closed range of open times, as ISO text) prune
    partition folders. Raises ``FileNotFoundError`` when the table
    or the requested series is absent.
    """
    path = f"{root}/ohlcv"
    if not exists(spark, path):
        raise FileNotFoundError(f"no candle table under {path}; land candles with upsert_ohlcv first")
    df = spark.read.schema(T.StructType([*CANDLE_KEYED.fields, T.StructField("month", T.StringType())])).parquet(path)
    for name, wanted in (("pair", pair), ("interval", interval)):
        if wanted is not None:
            df = df.filter(F.col(name) == wanted)
    if (pair or interval) and df.limit(1).count() == 0:
        raise FileNotFoundError(f"no candles for pair={pair} interval={interval} under {path}")
    for bound, keep in ((start, lambda c, v: c >= v), (end, lambda c, v: c <= v)):
        if bound is not None:
            df = df.filter(keep(F.col("month"), F.lit(bound[:7])) & keep(F.col(TS), F.lit(bound).cast("timestamp")))
    return dedupe(df.drop("month"), [*SERIES, TS], [F.col("ingested_at").asc_nulls_last()])


def with_month(df: DataFrame, ts: str = TS) -> DataFrame:
    """Add the ``yyyy-MM`` partition column."""
    return df.withColumn("month", F.date_format(ts, "yyyy-MM"))


def with_ingested_at(df: DataFrame) -> DataFrame:
    """Stamp rows with the current time, floored to the millisecond."""
    return df.withColumn("ingested_at", F.date_trunc("MILLISECOND", F.current_timestamp()))


def latest_open_time(df: DataFrame) -> DataFrame:
    """High-water mark of each (pair, interval)."""
    return df.groupBy(*SERIES).agg(F.max(TS).alias("latest"))


def stored_high_water(spark: SparkSession, root: str, pair: str | None = None, interval: str | None = None) -> DataFrame:
    """High-water mark of each stored (pair, interval), whatever the length of its history.

    Folder names tell the newest month of each series; only the time column of those months is read.
    Raises ``FileNotFoundError`` when there is no table; an unknown series has no row.
    """
    path = f"{root}/ohlcv"
    if not exists(spark, path):
        raise FileNotFoundError(f"no candle table under {path}; land candles with upsert_ohlcv first")
    with settings(spark, sources__partitionColumnTypeInference__enabled="false"):
        # a file listing: the names of all files, the content of none
        listed = spark.read.format("binaryFile").load(path).select(*SERIES, "month").distinct()
        for name, wanted in (("pair", pair), ("interval", interval)):
            if wanted is not None:
                listed = listed.filter(F.col(name) == wanted)
        newest = listed.groupBy(*SERIES).agg(F.max("month").alias("month")).filter("month IS NOT NULL").collect()  # a row per series
    stored = spark.read.schema(T.StructType([*CANDLE_KEYED.fields, T.StructField("month", T.StringType())])).parquet(path)
    name = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x1e")) for c in (*SERIES, "month")])
    wanted = ["\x1f".join("\x1e" if r[c] is None else r[c] for c in (*SERIES, "month")) for r in newest]
    return latest_open_time(stored.filter(name.isin(wanted) if wanted else F.lit(False)))


def plan_backfill(
    ohlcv: DataFrame, listing: DataFrame, intervals: list[str], now_ms: int, page_size: int = 1000
) -> DataFrame:
    """Download pages still needed per (pair, interval).

    ``listing`` holds ``pair, listing_ms``. A job starts one interval after the stored high-water
    mark, else at the listing time. Unknown intervals and finished jobs are left out. One row per
    page: ``pair, interval, start_ms, end_ms, interval_ms, pages, page, page_start_ms``.
    """
    known = [i for i in intervals if i in INTERVAL_MS]
    jobs = listing.withColumn(
        "i", F.explode(F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(INTERVAL_MS[i]).alias("ms")) for i in known]))
    ).select("pair", "listing_ms", F.col("i.interval").alias("interval"), F.col("i.ms").cast("long").alias("interval_ms"))
    joined = jobs.join(latest_open_time(ohlcv), list(SERIES), "left")
    start = F.coalesce(F.unix_millis("latest") + F.col("interval_ms"), F.col("listing_ms"))
    planned = joined.select(*SERIES, start.alias("start_ms"), F.lit(now_ms).alias("end_ms"), "interval_ms")
    planned = planned.filter(F.col("start_ms") < F.col("end_ms"))
    candles = F.greatest(F.lit(1), F.expr("(end_ms - start_ms) div interval_ms"))
    planned = planned.withColumn("pages", F.floor((candles + (page_size - 1)) / page_size))
    return planned.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).withColumn(
        "page_start_ms", F.col("start_ms") + F.col("page") * page_size * F.col("interval_ms")
    )


# --------------------------------------------------------------------------- payload parsing
def parse_klines(df: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed candles from a column of JSON arrays of 12-slot arrays (the last slot is ignored)."""
    rows = F.explode(F.from_json(F.col(payload), "array<array<string>>"))
    slots = df.select(*keep, rows.alias("s"))

    def slot(i: int, kind: str) -> Column:
        return F.try_element_at(F.col("s"), F.lit(i + 1)).try_cast(kind)

    return slots.select(
        *keep,
        F.timestamp_millis(slot(0, "long")).alias("open_time"),
        *[slot(i, "double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), start=1)],
        F.timestamp_millis(slot(6, "long")).alias("close_time"),
        slot(7, "double").alias("quote_volume"),
        slot(8, "long").alias("trades"),
        slot(9, "double").alias("taker_buy_base"),
        slot(10, "double").alias("taker_buy_quote"),
    )


def parse_kline_messages(df: DataFrame, value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed candles from stream messages, enveloped under ``data`` or bare.

    Messages that are not JSON or carry no kline are skipped. Missing optional fields get their
    defaults: quote volume, trades and taker quote 0, taker base half the volume, ``is_closed`` false.
    Field names differ by case only (t/T, v/V, q/Q), so the message is parsed into a map, once.
    """
    bare = F.get_json_object(value, "$.k")
    kline = F.coalesce(F.get_json_object(value, "$.data.k"), bare)
    # a map keeps keys apart that differ by case; exploding its one-entry array keeps the parse from being repeated per field
    entries = F.explode(F.array(F.from_json(kline, "map<string,string>"))).alias("_k")
    parsed = df.select(*keep, entries).filter(F.col("_k").isNotNull())

    def field(name: str, kind: str) -> Column:
        return F.try_element_at("_k", F.lit(name)).try_cast(kind)

    volume = field("v", "double")
    out = parsed.select(
        *keep,
        field("s", "string").alias("pair"), field("i", "string").alias("interval"),
        F.timestamp_millis(field("t", "long")).alias("open_time"),
        field("o", "double").alias("open"), field("h", "double").alias("high"),
        field("l", "double").alias("low"), field("c", "double").alias("close"), volume.alias("volume"),
        F.timestamp_millis(field("T", "long")).alias("close_time"),
        F.coalesce(field("q", "double"), F.lit(0.0)).alias("quote_volume"),
        F.coalesce(field("n", "long"), F.lit(0)).alias("trades"),
        F.coalesce(field("V", "double"), volume * 0.5).alias("taker_buy_base"),
        F.coalesce(field("Q", "double"), F.lit(0.0)).alias("taker_buy_quote"),
        F.coalesce(field("x", "boolean"), F.lit(False)).alias("is_closed"),
    )
    return out.filter(F.col("open_time").isNotNull())


def closed_only(df: DataFrame, flag: str = "is_closed") -> DataFrame:
    """Drop candles still in progress."""
    return df.filter(F.col(flag))


def normalise_candles(df: DataFrame) -> DataFrame:
    """Fill the optional fields of a partial candle: any schema column may be missing or null."""
    have = set(df.columns)

    def col(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    zero = {c: F.coalesce(col(c, "double"), F.lit(0.0)) for c in ("open", "high", "low", "close", "volume")}
    filled = {
        **zero,
        "close_time": F.coalesce(col("close_time", "timestamp"), F.col(TS) + F.expr("INTERVAL 59 MINUTES 59 SECONDS")),
        "quote_volume": F.coalesce(col("quote_volume", "double"), F.lit(0.0)),
        "trades": F.coalesce(col("trades", "long"), F.lit(0)),
        "taker_buy_base": F.coalesce(col("taker_buy_base", "double"), zero["volume"] * 0.5),
        "taker_buy_quote": F.coalesce(col("taker_buy_quote", "double"), F.lit(0.0)),
    }
    return df.withColumns(filled)


# --------------------------------------------------------------------------- events to bars
def bars_from_events(
    events: DataFrame,
    pair: str | Column = "event_type",
    ts: str = "ts",
    price: str = "value",
    size: str | None = None,
    taker: Column | None = None,
    width: str = "1 hour",
    interval: str = "1h",
    tie: str | None = None,
) -> DataFrame:
    """Tumbling candles from raw events.

    Open and close are the prices at the first and last event of the window (``tie`` orders events
    of the same instant). One aggregation with map-side combine; no per-window row collection.
    """
    pair = F.col(pair) if isinstance(pair, str) else pair
    size = size or price
    at = F.struct(ts, tie) if tie else F.col(ts)
    taken = F.when(taker, F.col(size)).otherwise(0.0) if taker is not None else F.lit(0.0)
    grouped = events.groupBy(pair.alias("pair"), F.window(ts, width).alias("_w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, at).alias("close"), F.sum(size).alias("volume"),
        F.count(F.lit(1)).alias("trades"), F.sum(taken).alias("taker_buy_base"),
    )
    return grouped.withColumn(TS, F.col("_w.start")).select(
        "pair", F.lit(interval).alias("interval"), TS, "open", "high", "low", "close", "volume",
        F.timestamp_millis(F.unix_millis(TS) + (INTERVAL_MS[interval] - 1)).alias("close_time"),
        F.lit(0.0).alias("quote_volume"), "trades", "taker_buy_base", F.lit(0.0).alias("taker_buy_quote"),
    )
