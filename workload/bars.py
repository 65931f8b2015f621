"""Queries for sources, sinks, checks, features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.functions.scalar import source_slug, utc
from barframe.operators import checks, features, labels, tables
from barframe.operators.series import with_ema, with_position
from barframe.operators.windows import collect_windows, patch_windows, sequence_windows
from barframe.schema import SERIES, TS, interval_ms
from barframe.session import scratch_path
from barframe.sources import candles, sinks
from barframe.sources.news import normalise_news, normalise_posts, read_scored_news
from workload.fixtures import (
    BARS, BB, BLOCK, BP, DATASET, EMA, FEATURES, NEWS, TIME, VEC, VOLUME, WINDOWS, bars, daily_bars, dataset, news,
    returns_sql, rolling_sql, table, vectors,
)
from workload.registry import ms, query, r

OHLCV = ["open", "high", "low", "close", "volume"]
MS0 = 1_704_067_200_000  # 2024-01-01


def positioned(spark, sf):
    return with_position(bars(spark, sf), rows=BLOCK)


def stamped(spark, sf):
    return bars(spark, sf).withColumn("ingested_at", F.timestamp_millis(F.unix_millis(TS) + 3_600_000))


def resent(spark, sf):
    """The same candles a second time: close raised, 0 to 2 hours later (0 ties with the first batch)."""
    later = F.timestamp_millis(F.unix_millis("ingested_at") + (F.col("trades") % 3) * 3_600_000)
    return stamped(spark, sf).withColumns({"close": F.col("close") + 1, "ingested_at": later})


@query("x05_bars_from_events", f"""WITH {BARS} SELECT pair, "interval", {ms('open_time')}, {r(*OHLCV, 'taker_buy_base')},
  trades::BIGINT AS trades, (epoch_ms(open_time) + 3599999)::BIGINT AS close_time FROM bars""")
def _(spark, sf):
    return bars(spark, sf).select(*SERIES, TS, *OHLCV, "taker_buy_base", "trades", "close_time")


@query("x05_daily_bars", f"""SELECT o_orderpriority AS pair, {ms('o_orderdate AS open_time')},
  {r('arg_min(o_totalprice, o_orderkey) AS open', 'max(o_totalprice) AS high', 'min(o_totalprice) AS low',
     'arg_max(o_totalprice, o_orderkey) AS close', digits=2)}, count(*)::BIGINT AS trades
  FROM orders GROUP BY o_orderpriority, o_orderdate""", digits=2)
def _(spark, sf):
    return daily_bars(spark, sf).select("pair", TS, "open", "high", "low", "close", "trades")


@query("s01_candle_scan", f"""WITH {BARS} SELECT pair, "interval", {ms('open_time')}, {r(*OHLCV)}, trades::BIGINT AS trades
  FROM bars WHERE pair = 'view'""")
def _(spark, sf):
    root = scratch_path(spark, "candles")
    both = candles.with_month(stamped(spark, sf).unionByName(resent(spark, sf).filter(F.col("trades") % 3 > 0)))
    both.write.partitionBy("pair", "interval", "month").parquet(f"{root}/ohlcv")
    return candles.read_ohlcv(spark, root, "view", "1h").select(*SERIES, TS, *OHLCV, "trades")


@query("s02_s03_scored_news_scan", f"""WITH {NEWS} SELECT id, {ms('published_at')},
  {r('CASE WHEN event_id % 11 <> 0 THEN score END AS sent_score', 'CASE WHEN event_id % 11 <> 0 THEN conf END AS sent_conf')}
  FROM news""")
def _(spark, sf):
    root = scratch_path(spark, "news")
    sinks.with_news_partition(news(spark, sf, unscored=True).drop("event_id")).write.partitionBy("source", "date").parquet(f"{root}/news")
    return read_scored_news(spark, root).select("id", "published_at", "sent_score", "sent_conf")


@query("s04_parse_klines", f"""WITH {BARS} SELECT pair, {ms('open_time')}, {r(*OHLCV, 'taker_buy_base')},
  trades::BIGINT AS trades, (epoch_ms(open_time) + 3599999)::BIGINT AS close_time FROM bars""")
def _(spark, sf):
    text = lambda c: F.col(c).cast("string")
    slots = F.array(
        F.unix_millis(TS).cast("string"), *[text(c) for c in OHLCV], F.unix_millis("close_time").cast("string"),
        text("quote_volume"), text("trades"), text("taker_buy_base"), text("taker_buy_quote"), F.lit("0"),
    )
    pages = bars(spark, sf).select("pair", F.to_date(TS).alias("day"), slots.alias("s"))
    pages = pages.groupBy("pair", "day").agg(F.to_json(F.collect_list("s")).alias("payload"))
    return candles.parse_klines(pages, "payload", ("pair",)).select(
        "pair", TS, *OHLCV, "taker_buy_base", "trades", "close_time"
    )


def kline_lines(spark, sf):
    """Each bar as an open (half volume) and a closed message, enveloped or bare, plus unusable lines."""
    b = bars(spark, sf)
    base = F.concat(
        F.lit('{"s":"'), "pair", F.lit('","i":"1h","t":'), F.unix_millis(TS), F.lit(',"T":'), F.unix_millis("close_time"),
        F.lit(',"o":"'), "open", F.lit('","h":"'), "high", F.lit('","l":"'), "low", F.lit('","c":"'), "close",
        F.lit('","n":'), "trades",
    )
    closed = F.concat(base, F.lit(',"v":"'), "volume", F.lit('","V":"'), "taker_buy_base", F.lit('","x":true}'))
    going = F.concat(base, F.lit(',"v":"'), F.col("volume") / 2, F.lit('","x":false}'))
    bad = F.when(F.col("trades") % 2 == 0, F.lit("not json")).otherwise(F.lit('{"data":{"e":"ping"}}'))
    lines = F.array(
        F.concat(F.lit('{"data":{"k":'), closed, F.lit("}}")), F.concat(F.lit('{"k":'), going, F.lit("}")), bad
    )
    return b.select(F.explode(lines).alias("value"))


@query("s05_parse_kline_messages", f"""WITH {BARS} SELECT pair, {ms('open_time')}, {r('close', 'volume', 'taker_buy_base')},
  0e0 AS quote_volume, trades::BIGINT AS trades, is_closed FROM (
  SELECT pair, open_time, close, volume, taker_buy_base, trades, true AS is_closed FROM bars UNION ALL
  SELECT pair, open_time, close, volume / 2, volume / 4, trades, false FROM bars)""")
def _(spark, sf):
    return candles.parse_kline_messages(kline_lines(spark, sf), "value").select(
        "pair", TS, "close", "volume", "taker_buy_base", "quote_volume", "trades", "is_closed"
    )


@query("p01_closed_only", f"WITH {BARS} SELECT pair, {ms('open_time')}, {r('volume')} FROM bars")
def _(spark, sf):
    return candles.closed_only(candles.parse_kline_messages(kline_lines(spark, sf), "value")).select("pair", TS, "volume")


@query("s06_normalise_feed", """SELECT substr(sha1(url), 1, 16) AS id, url, 'page ' || page_id::VARCHAR AS title,
  (1704067200000 + CASE WHEN page_id % 3 = 0 THEN page_id * 60000 WHEN page_id % 3 = 1 THEN page_id * 120000 ELSE 86400000 END)::BIGINT AS published_at
  FROM pages WHERE page_id % 13 <> 0""")
def _(spark, sf):
    at = lambda step: F.date_format(F.timestamp_millis(F.lit(MS0) + F.col("page_id") * step), "yyyy-MM-dd HH:mm:ss")
    feed = table(spark, sf, "pages").select(
        F.lit("Feed A").alias("source"), F.concat(F.lit("page "), "page_id").alias("title"),
        F.when(F.col("page_id") % 13 != 0, F.col("url")).alias("url"), F.col("html").alias("summary"),
        F.when(F.col("page_id") % 3 == 0, at(60_000)).alias("published"),
        F.when(F.col("page_id") % 3 == 1, at(120_000)).otherwise(F.lit("soon")).alias("updated"),
        F.timestamp_millis(F.lit(MS0 + 86_400_000)).alias("ingested_at"),
    )
    return normalise_news(feed).select("id", "url", "title", "published_at")


@query("s06_normalise_posts", """SELECT substr(sha1(CASE WHEN page_id % 4 = 0 THEN 'example.com' ELSE url END), 1, 16) AS id,
  'CryptoPanic' AS source, CASE WHEN page_id % 4 = 0 THEN 'example.com' ELSE url END AS url,
  CASE WHEN page_id % 3 = 0 THEN 'BTC,ETH' WHEN page_id % 3 = 1 THEN 'SOL' ELSE '' END AS tickers,
  (page_id % 9)::BIGINT AS up FROM pages""")
def _(spark, sf):
    code = lambda c: F.lit(c)
    posts = table(spark, sf, "pages").select(
        F.when(F.col("page_id") % 4 != 0, F.col("url")).alias("url"), F.lit("example.com").alias("domain"),
        F.lit("t").alias("title"), F.lit("2024-01-01T00:00:00Z").alias("published_at"),
        F.when(F.col("page_id") % 3 == 0, F.array(code("ETH"), code("BTC"), code("ETH")))
        .when(F.col("page_id") % 3 == 1, F.array(code("SOL"), code(""))).alias("currencies"),
        F.create_map(F.lit("up"), F.col("page_id") % 9).alias("votes"),
        F.timestamp_millis(F.lit(MS0)).alias("ingested_at"),
    )
    return normalise_posts(posts).select(
        "id", "source", "url", F.array_join("tickers", ",").alias("tickers"), F.col("raw_sentiment")["up"].alias("up")
    )


_RESENT = """, a AS (SELECT *, open_time + to_hours(1) AS ingested_at, 0 AS batch FROM bars),
  b AS (SELECT * REPLACE (close + 1 AS close, ingested_at + to_hours((trades % 3)::INT) AS ingested_at, 1 AS batch) FROM a),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


@query("s07_candle_upsert", f"""WITH {BARS}{_RESENT} SELECT pair, {ms('open_time', 'ingested_at')}, {r('close', 'volume')},
  strftime(open_time, '%Y-%m') AS month
  FROM u QUALIFY row_number() OVER (PARTITION BY pair, open_time ORDER BY ingested_at DESC, batch DESC) = 1""")
def _(spark, sf):
    root = scratch_path(spark, "upsert")
    for batch in (stamped(spark, sf), resent(spark, sf), resent(spark, sf)):
        sinks.upsert_ohlcv(batch, root)
    return spark.read.parquet(f"{root}/ohlcv").select("pair", TS, "ingested_at", "close", "volume", "month")


@query("t04_merge_candles", f"""WITH {BARS}{_RESENT} SELECT pair, {ms('open_time', 'ingested_at')}, {r('close')}
  FROM u QUALIFY row_number() OVER (PARTITION BY pair, open_time ORDER BY ingested_at DESC, batch DESC) = 1""")
def _(spark, sf):
    return sinks.merge_candles(stamped(spark, sf), resent(spark, sf)).select("pair", TS, "ingested_at", "close")


@query("s08_news_upsert", f"""WITH {NEWS} SELECT replace(lower(source), ' ', '_') AS source, strftime(published_at, '%Y-%m-%d') AS date,
  url, id, {ms('published_at')} FROM news
  QUALIFY row_number() OVER (PARTITION BY source, strftime(published_at, '%Y-%m-%d'), url ORDER BY published_at, ingested_at) = 1""")
def _(spark, sf):
    root = scratch_path(spark, "news-upsert")
    n = news(spark, sf).drop("event_id")
    for part in (n.filter(F.hour("published_at") < 12), n):
        sinks.upsert_news(part, root)
    return spark.read.schema(sinks.with_news_partition(n).schema).parquet(f"{root}/news").select("source", "date", "url", "id", "published_at")


@query("s09_month_split", f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    return candles.with_month(table(spark, sf, "orders"), "o_orderdate").groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("s10_source_day_split", f"""WITH {NEWS} SELECT replace(lower(source), ' ', '_') AS source,
  strftime(published_at, '%Y-%m-%d') AS date, count(*)::BIGINT AS n FROM news GROUP BY 1, 2""")
def _(spark, sf):
    return sinks.with_news_partition(news(spark, sf)).groupBy("source", "date").agg(F.count(F.lit(1)).alias("n"))


@query("s11_high_water", f"""WITH {BARS} SELECT pair, "interval", {ms('max(open_time) AS latest')} FROM bars GROUP BY 1, 2""")
def _(spark, sf):
    root = scratch_path(spark, "marks")
    sinks.upsert_ohlcv(stamped(spark, sf), root)
    return candles.stored_high_water(spark, root)


@query("s12_backfill_plan", f"""WITH {BARS}, hw AS (SELECT pair, max(open_time) AS latest FROM bars GROUP BY 1),
  jobs AS (SELECT p.pair, i.iv, i.len, CASE WHEN i.iv = '1h' AND latest IS NOT NULL THEN epoch_ms(latest) + i.len ELSE 1704067200000 END AS start_ms
    FROM (SELECT DISTINCT pair FROM bars UNION SELECT 'extra') p CROSS JOIN (VALUES ('1h', 3600000), ('1d', 86400000)) i(iv, len) LEFT JOIN hw ON hw.pair = p.pair),
  sized AS (SELECT *, (greatest(1, (1706918400000 - start_ms) // len) + 9) // 10 AS pages FROM jobs WHERE start_ms < 1706918400000)
  SELECT pair, iv AS "interval", start_ms::BIGINT AS start_ms, 1706918400000::BIGINT AS end_ms, len::BIGINT AS interval_ms,
    pages::BIGINT AS pages, page::BIGINT AS page, (start_ms + page * 10 * len)::BIGINT AS page_start_ms
  FROM sized, generate_series(0, sized.pages - 1) g(page)""")
def _(spark, sf):
    b = bars(spark, sf)
    extra = spark.range(1).select(F.lit("extra").alias("pair"))
    listing = b.select("pair").distinct().unionByName(extra).withColumn("listing_ms", F.lit(MS0))
    return candles.plan_backfill(b, listing, ["1h", "1d", "7x"], 1_706_918_400_000, page_size=10)


@query("s13_normalise_candles", f"""WITH {BARS} SELECT pair, {ms('open_time')}, {r('volume')},
  (epoch_ms(open_time) + CASE WHEN trades % 2 = 0 THEN 3599000 ELSE 3599999 END)::BIGINT AS close_time, 0::BIGINT AS trades,
  {r('CASE WHEN trades % 3 = 0 THEN 0.5e0 * volume ELSE taker_buy_base END AS taker_buy_base')}, 0e0 AS taker_buy_quote FROM bars""")
def _(spark, sf):
    b = bars(spark, sf)
    partial = b.select(
        *SERIES, TS, *OHLCV, F.when(F.col("trades") % 2 != 0, F.col("close_time")).alias("close_time"),
        F.when(F.col("trades") % 3 != 0, F.col("taker_buy_base")).alias("taker_buy_base"),
    )
    return candles.normalise_candles(partial).select("pair", TS, "volume", "close_time", "trades", "taker_buy_base", "taker_buy_quote")


@query("s14_embedding_upsert", f"""WITH {VEC} SELECT {ms('open_time')}, {r("(CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END) * embedding[1] AS e0")} FROM vec""")
def _(spark, sf):
    root = scratch_path(spark, "embeddings")
    emb, _ = vectors(spark, sf)
    newer = emb.filter((F.unix_millis(TS) / 3_600_000).cast("long") % 2 == 0).withColumn(
        "embedding", F.transform("embedding", lambda x: (x * 2).cast("float"))
    )
    for batch in (emb, newer):
        sinks.upsert_embeddings(batch, root)
    return sinks.read_keyed(spark, root, "embeddings", "vec", "1h").select(TS, F.col("embedding")[0].alias("e0"))


@query("s18_keyed_scan", f"""WITH {VEC} SELECT {ms('open_time')}, regime::BIGINT AS regime FROM reg""")
def _(spark, sf):
    root = scratch_path(spark, "keyed")
    sinks.write_keyed(vectors(spark, sf)[1], root, "regimes")
    return sinks.read_keyed(spark, root, "regimes", "vec", "1h").select(TS, "regime")


@query("s19_ingest_stamp", f"WITH {BARS} SELECT pair, true AS on_millisecond, count(*)::BIGINT AS rows FROM bars GROUP BY 1")
def _(spark, sf):
    stamp = candles.with_ingested_at(bars(spark, sf))
    return stamp.groupBy("pair").agg(
        F.bool_and(F.unix_micros("ingested_at") % 1000 == 0).alias("on_millisecond"), F.count(F.lit(1)).alias("rows")
    )


# --------------------------------------------------------------------------- selections and checks
@query("p02_range_latest", f"""WITH {BARS} SELECT {ms('open_time')}, {r('close')} FROM bars WHERE pair = 'click'
  AND open_time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' ORDER BY bars.open_time DESC LIMIT 100""")
def _(spark, sf):
    one = tables.lookup(bars(spark, sf), pair="click")
    lo, hi = F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    return tables.range_latest(one, lo, hi, 100).select(TS, "close")


@query("p06_publication_order", f"WITH {NEWS} SELECT id, {ms('published_at', 'ingested_at')} FROM news WHERE published_at > ingested_at")
def _(spark, sf):
    return checks.publication_violations(news(spark, sf)).select("id", "published_at", "ingested_at")


@query("p10_clamp_published", f"WITH {NEWS} SELECT id, {ms('least(published_at, ingested_at) AS published_at')} FROM news")
def _(spark, sf):
    return checks.clamp_published(news(spark, sf)).select("id", "published_at")


_ARRIVED = """CASE WHEN trades % 5 = 0 THEN -1 WHEN pair = 'view' AND trades % 7 = 0 THEN 200 ELSE 1 END"""


@query("p08_bar_order", f"""WITH {BARS}, i AS (SELECT *, open_time + to_minutes(({_ARRIVED})::INT) AS ingested_at FROM bars),
  l AS (SELECT *, lag(open_time) OVER (PARTITION BY pair ORDER BY ingested_at, open_time) AS prev FROM i)
  SELECT pair, "interval", bool_and(coalesce(open_time > prev, true)) AS increasing, bool_and(ingested_at >= open_time) AS ingested_after_open,
  count(*)::BIGINT AS rows FROM l GROUP BY 1, 2""")
def _(spark, sf):
    b = bars(spark, sf).withColumn("ingested_at", F.timestamp_millis(F.unix_millis(TS) + F.expr(_ARRIVED) * 60_000))
    return checks.bar_order(b, block=BLOCK)


@query("p11_missing_keys", f"""WITH {BARS} SELECT pair, {ms('open_time')} FROM (SELECT DISTINCT pair FROM bars)
  CROSS JOIN (SELECT DISTINCT open_time FROM bars) EXCEPT SELECT pair, {ms('open_time')} FROM bars""")
def _(spark, sf):
    b = bars(spark, sf)
    span = b.agg(F.collect_set("pair").alias("pairs"))  # a handful of series names
    keys = b.select(TS, "interval").distinct().withColumn("_k", F.lit(0)).join(span.withColumn("_k", F.lit(0)), "_k")
    keys = keys.select(F.explode("pairs").alias("pair"), "interval", TS)
    return checks.require_keys(b, keys).select("pair", TS)


@query("p12_missing_inputs", f"""WITH {BARS} SELECT DISTINCT pair, "interval", 'regimes' AS missing FROM bars
  UNION ALL SELECT DISTINCT pair, "interval", 'sentiment' FROM bars WHERE pair < 'f'""")
def _(spark, sf):
    b = bars(spark, sf)
    return checks.missing_inputs(
        b.select(*SERIES).distinct(), {"bars": b, "sentiment": b.filter("pair >= 'f'"), "regimes": b.limit(0)}
    )


@query("p13_point_lookup", f"WITH {VEC} SELECT {ms('open_time')}, {r('embedding[1] AS e0', 'embedding[64] AS e63')} FROM vec WHERE open_time = TIMESTAMP '2024-01-05 03:00:00'")
def _(spark, sf):
    emb, _ = vectors(spark, sf)
    hit = tables.lookup(emb, pair="vec").filter(F.col(TS) == F.lit("2024-01-05 03:00:00").cast("timestamp"))
    return hit.select(TS, F.col("embedding")[0].alias("e0"), F.col("embedding")[63].alias("e63"))


@query("a26_dataset_status", f"""WITH RECURSIVE {FEATURES} SELECT b.pair, b."interval", count(*)::BIGINT AS bars, {ms('min(b.open_time) AS first_bar', 'max(b.open_time) AS last_bar')},
  (SELECT count(*) FROM feat WHERE feat.pair = b.pair)::BIGINT AS feature_rows,
  floor((SELECT count(*) FROM feat WHERE feat.pair = b.pair) * 0.9e0)::BIGINT AS anchor_cut FROM bars b GROUP BY 1, 2""")
def _(spark, sf):
    from workload.fixtures import features as feature_rows

    return checks.dataset_status(bars(spark, sf), feature_rows(spark, sf))


@query("t01_latest_per_series", f"""WITH {BARS} SELECT pair, {ms('open_time')}, {r('close')} FROM bars
  QUALIFY row_number() OVER (PARTITION BY pair ORDER BY bars.open_time DESC) <= 20""")
def _(spark, sf):
    return tables.top_n_per(bars(spark, sf), list(SERIES), [F.col(TS).desc()], 20).select("pair", TS, "close")


@query("t05_key_intersection", f"WITH {VEC} SELECT {ms('open_time')} FROM vec JOIN reg USING (open_time)")
def _(spark, sf):
    return tables.common_keys(*vectors(spark, sf)).select(TS)


@query("t08_evenly_spaced", f"""WITH {BP}, w AS (SELECT pair, floor(i * ((n_rows - 1) / 15e0))::BIGINT AS pos FROM (SELECT DISTINCT pair, n_rows FROM bp), range(16) t(i))
  SELECT bp.pair, {ms('open_time')} FROM bp JOIN (SELECT DISTINCT * FROM w) USING (pair, pos)""")
def _(spark, sf):
    return tables.evenly_spaced(bars(spark, sf), 16).select("pair", TS)


@query("f10_f11_f12_scalars", """SELECT CASE event_type WHEN 'click' THEN '1h' WHEN 'view' THEN '5m' WHEN 'error' THEN '1w' ELSE 'x' END AS iv,
  CASE event_type WHEN 'click' THEN 3600000 WHEN 'view' THEN 300000 WHEN 'error' THEN 604800000 END::DOUBLE AS len,
  'feed_' || event_type AS slug, max(epoch_ms(date_trunc('second', ts)))::BIGINT AS at, count(*)::BIGINT AS n FROM events GROUP BY event_type""")
def _(spark, sf):
    e = table(spark, sf, "events")
    iv = F.when(F.col("event_type") == "click", "1h").when(F.col("event_type") == "view", "5m").when(F.col("event_type") == "error", "1w").otherwise("x")
    return e.select(
        iv.alias("iv"), interval_ms(iv).cast("double").alias("len"), source_slug(F.concat(F.lit("Feed "), "event_type")).alias("slug"),
        utc(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"),
    ).groupBy("iv", "len", "slug").agg(F.max(F.unix_millis("ts")).alias("at"), F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- features
KEY = ["pair", TS]


def _select(df, cols):
    return df.select(*KEY, *cols)


def _windowed(items):
    return f"WITH {BP} SELECT pair, {ms('open_time')}, {r(*items)} FROM bp {WINDOWS}"


@query("w01_log_returns", _windowed(returns_sql()))
def _(spark, sf):
    return _select(features.with_log_returns(positioned(spark, sf), block=BLOCK), [f"ret_{k}" for k in features.RETURN_LAGS])


@query("w02_w03_w04_rolling", _windowed(rolling_sql()))
def _(spark, sf):
    out = features.with_rolling_stats(positioned(spark, sf), block=BLOCK)
    return _select(out, [f"{s}_{w}" for w in features.ROLLING for s in ("sma", "std", "band_pos")])


@query("w05_ema", f"WITH RECURSIVE {BP}, {EMA} SELECT pair, {ms('open_time')}, {r('fast AS ema_close')} FROM e JOIN bp USING (pair, pos)")
def _(spark, sf):
    return _select(with_ema(positioned(spark, sf), "close", span=12, block=BLOCK), ["ema_close"])


_IND = f"WITH RECURSIVE {BP}, {EMA} SELECT pair, {ms('open_time')}, {{}} FROM ind JOIN bp USING (pair, pos)"


@query("w06_rsi", _IND.format(r("rsi_14")))
def _(spark, sf):
    return _select(features.with_rsi(positioned(spark, sf), block=BLOCK), ["rsi_14"])


@query("w07_macd", _IND.format(r("macd", "macd_signal", "macd_hist")))
def _(spark, sf):
    return _select(features.with_macd(positioned(spark, sf), block=BLOCK), ["macd", "macd_signal", "macd_hist"])


@query("w08_atr", _IND.format(r("atr_14")))
def _(spark, sf):
    return _select(features.with_atr(positioned(spark, sf), block=BLOCK), ["atr_14"])


@query("w09_bollinger", _windowed([BB]))
def _(spark, sf):
    return _select(features.with_bollinger(positioned(spark, sf), block=BLOCK), ["bb_pct_b"])


@query("w10_f09_volume", _windowed(VOLUME))
def _(spark, sf):
    return _select(features.with_volume_features(positioned(spark, sf), block=BLOCK), ["vol_ratio_10", "vol_ratio_50", "taker_buy_share"])


@query("f08_cyclic_time", f"WITH {BARS} SELECT pair, {ms('open_time')}, {r(*TIME)} FROM bars")
def _(spark, sf):
    return _select(features.with_time_features(bars(spark, sf)), ["hod_sin", "hod_cos", "dow_sin", "dow_cos"])


@query("w11_direction_label", f"""WITH {BARS} SELECT pair, {ms('open_time')}, (lead(close, 1) OVER w > close)::INT::DOUBLE AS y1,
  (lead(close, 5) OVER w > close)::INT::DOUBLE AS y5 FROM bars WINDOW w AS (PARTITION BY pair ORDER BY bars.open_time)""")
def _(spark, sf):
    one = labels.with_direction_label(positioned(spark, sf), 1, "y1", block=BLOCK)
    both = labels.with_direction_label(one, 5, "y5", block=BLOCK)
    return _select(both, [F.col(c).cast("double").alias(c) for c in ("y1", "y5")])


@query("w12_return_label", f"""WITH {BARS} SELECT pair, {ms('open_time')}, {r('ln(lead(close) OVER w / close) AS next_ret')}
  FROM bars WINDOW w AS (PARTITION BY pair ORDER BY bars.open_time)""")
def _(spark, sf):
    return _select(labels.with_return_label(positioned(spark, sf), 1, block=BLOCK), ["next_ret"])


@query("w13_regime_inputs", f"""WITH {BP}, x AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY pair ORDER BY pos)) AS log_return FROM bp),
  y AS (SELECT *, CASE WHEN count(log_return) OVER w = 24 THEN stddev_samp(log_return) OVER w END AS vol FROM x
    WINDOW w AS (PARTITION BY pair ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
  SELECT pair, {ms('open_time')}, {r('log_return', 'vol')} FROM y WHERE vol IS NOT NULL""")
def _(spark, sf):
    return _select(features.regime_inputs(positioned(spark, sf), 24, block=BLOCK), ["log_return", "vol"])


@query("w14_realised_vol", f"""WITH {BP}, x AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY pair ORDER BY pos)) AS ret FROM bp)
  SELECT pair, {ms('open_time')}, {r('CASE WHEN count(ret) OVER a = 24 THEN stddev_pop(ret) OVER a END AS vol_24',
   'CASE WHEN count(ret) OVER b = 168 THEN stddev_pop(ret) OVER b END AS vol_168')} FROM x
  WINDOW a AS (PARTITION BY pair ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY pair ORDER BY pos ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    one = features.with_realised_vol(positioned(spark, sf), 24, block=BLOCK)
    return _select(features.with_realised_vol(one, 168, block=BLOCK), ["vol_24", "vol_168"])


@query("w15_collect_windows", f"""WITH {BP}, x AS (SELECT *, list({{'c': close, 'h': high}}) OVER w AS win FROM bp
    WINDOW w AS (PARTITION BY pair ORDER BY pos ROWS BETWEEN 63 PRECEDING AND CURRENT ROW))
  SELECT pair, {ms('open_time')}, len(win)::BIGINT AS bars, {r('win[1].c AS first_close', 'win[64].c AS last_close', 'list_sum([z.h * i for z, i in win]) AS checksum', digits=4)}
  FROM x WHERE len(win) = 64""", digits=4)
def _(spark, sf):
    w = collect_windows(positioned(spark, sf), ("high", "close"), 64, block=BLOCK)
    weighted = F.aggregate(F.transform("window", lambda x, i: x["high"] * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return w.select(
        *KEY, F.size("window").alias("bars"), F.col("window")[0]["close"].alias("first_close"),
        F.col("window")[63]["close"].alias("last_close"), weighted.alias("checksum"),
    )


@query("w16_w17_sequences", f"""WITH {BP}, x AS (SELECT *, list(volume) OVER w AS win FROM bp
    WINDOW w AS (PARTITION BY pair ORDER BY pos ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
  y AS (SELECT *, list_concat([0e0 for i in range(21 - len(win))], win) AS seq FROM x)
  SELECT pair, {ms('open_time')}, len(seq)::BIGINT AS length, {r('seq[1] AS oldest', 'seq[21] AS newest', digits=4)}, 2::BIGINT AS patches,
    {r('seq[6] AS patch_start', 'list_sum(seq[6:13]) AS patch_volume', digits=4)} FROM y""", digits=4)
def _(spark, sf):
    s = patch_windows(sequence_windows(positioned(spark, sf), ["close", "volume"], 21, pad=True, block=BLOCK), 8)
    first = F.col("patches")[0]
    volumes = F.filter(first, lambda x, i: i % 2 == 1)
    return s.select(
        *KEY, F.size("sequence").alias("length"), F.col("sequence")[0][1].alias("oldest"), F.col("sequence")[20][1].alias("newest"),
        F.size("patches").alias("patches"), first[1].alias("patch_start"),
        F.aggregate(volumes, F.lit(0.0), lambda a, x: a + x).alias("patch_volume"),
    )


@query("p09_feature_frame", f"WITH RECURSIVE {FEATURES} SELECT pair, {ms('open_time')}, {r(*features.FEATURE_COLUMNS)} FROM feat")
def _(spark, sf):
    return _select(features.build_features(bars(spark, sf), block=BLOCK), features.FEATURE_COLUMNS)


@query("w22_model_dataset", f"""WITH RECURSIVE {DATASET} SELECT pair, {ms('open_time')}, "row"::BIGINT AS row, n::BIGINT AS n, y, initial::BIGINT AS initial,
  test::BIGINT AS test, {r('next_ret', 'close')} FROM ds""")
def _(spark, sf):
    return _select(dataset(spark, sf), ["row", "n", "y", "initial", "test", "next_ret", "close"])
