"""Queries for gated positions, range reports and the live path."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.functions.text import decode_sentiment
from barframe.operators import metrics as X
from barframe.operators import positions as P
from barframe.operators import ranges as R
from barframe.operators.features import FEATURE_COLUMNS
from barframe.operators.series import with_position
from barframe.plans.sweep import refit
from barframe.schema import SERIES, TS
from barframe.session import materialise, scratch_path
from barframe.streaming import live
from workload.bars import kline_lines
from workload.fixtures import BARS, BLOCK, DATASET, EQUITY, FEATURES, NEWS, OUTCOME, TICKERS, VEC, bars, dataset, news, position_inputs, table, vectors
from workload.registry import ms, query, r
from workload.text import SCORED_SQL, to_score

RECURSIVE = "WITH RECURSIVE "


def outcomes(spark, sf):
    preds, b = position_inputs(spark, sf)
    return P.bar_outcomes(preds, b, block=BLOCK)


def equity(spark, sf):
    return materialise(P.equity_curve(materialise(outcomes(spark, sf), "outcomes"), block=BLOCK), "equity")


@query("g01_f21_f22_decisions", f"WITH {OUTCOME} SELECT pair, {ms('open_time')}, decision, cp_singleton, predicted, {r('size_pct', 'vol_24', 'vol_168', 'pnl_pct')} FROM outcome")
def _(spark, sf):
    return outcomes(spark, sf).select("pair", TS, "decision", "cp_singleton", "predicted", "size_pct", "vol_24", "vol_168", "pnl_pct")


@query("f22_position_size", """SELECT o_orderkey, round(CASE WHEN o_orderkey % 7 = 0 THEN 1e0 ELSE greatest(0.1e0, least(1e0, CASE WHEN o_orderkey % 5 = 0 THEN 1e0
  ELSE (o_totalprice / 100000) / ((o_orderkey % 7) / 2e0) END)) END, 9) + 0.0 AS size_pct FROM orders""", digits=9)
def _(spark, sf):
    o = table(spark, sf, "orders")
    short = (F.col("o_orderkey") % 7) / F.lit(2.0)
    long = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 100_000)
    return o.select("o_orderkey", P.position_size(short, long).alias("size_pct"))


@query("g04_equity_curve", f"{RECURSIVE}{EQUITY} SELECT pair, {ms('open_time')}, {r('balance')}, traded FROM eq")
def _(spark, sf):
    return equity(spark, sf).select("pair", TS, "balance", "traded")


@query("g03_trade_table", f"{RECURSIVE}{EQUITY} SELECT pair, direction, {ms('entry_time', 'exit_time')}, {r('entry_price', 'exit_price', 'dollars', 'size_pct', 'pnl_dollars', 'pnl_pct')}, hit FROM trades")
def _(spark, sf):
    return P.trade_table(equity(spark, sf)).select(
        "pair", "direction", "entry_time", "exit_time", "entry_price", "exit_price", "dollars", "size_pct", "pnl_dollars", "pnl_pct", "hit"
    )


@query("w18_running_pnl", f"{RECURSIVE}{EQUITY} SELECT pair, {ms('exit_time')}, {r('sum(pnl_dollars) OVER (PARTITION BY pair ORDER BY exit_time) AS pnl_running')} FROM trades")
def _(spark, sf):
    return P.running_pnl(P.trade_table(equity(spark, sf)), block=BLOCK).select("pair", "exit_time", "pnl_running")


@query("g05_w19_prediction_log", f"{RECURSIVE}{EQUITY} SELECT pair, {ms('open_time')}, {r('close AS close_price', 'p_up')}, predicted AS predicted_direction, cp_singleton, actual::DOUBLE AS actual_direction, correct FROM plog")
def _(spark, sf):
    log = P.prediction_log(equity(spark, sf))
    return log.select("pair", TS, "close_price", "p_up", "predicted_direction", "cp_singleton", F.col("actual_direction").cast("double").alias("actual_direction"), "correct")


@query("w20_running_accuracy", f"""{RECURSIVE}{EQUITY} SELECT pair, {ms('open_time')}, {r('avg(correct::INT) OVER (PARTITION BY pair ORDER BY plog.open_time) AS running_accuracy')} FROM plog WHERE correct IS NOT NULL""")
def _(spark, sf):
    return P.running_accuracy(P.prediction_log(equity(spark, sf)), block=BLOCK).select("pair", TS, "running_accuracy")


_ACC = """a AS (SELECT pair, "interval", count(correct) AS n, avg(correct::INT) AS oa, avg(correct::INT) FILTER (cp_singleton) AS ca, avg(correct::INT) FILTER (NOT cp_singleton) AS ua,
  count(correct) FILTER (cp_singleton) AS cc FROM plog GROUP BY 1, 2)"""
_ACC_VERDICT = """CASE WHEN n < 8 THEN 'warming up' WHEN oa >= 0.54 THEN 'model beats a coin' WHEN oa <= 0.46 THEN 'model below coin' ELSE 'coin-flip so far' END AS verdict"""


@query("a16_f23_accuracy_stats", f"""{RECURSIVE}{EQUITY}, {_ACC} SELECT pair, "interval", n::BIGINT AS n_labelled, {r('oa AS overall_accuracy', 'ca AS confident_accuracy', 'ua AS uncertain_accuracy')},
  cc::BIGINT AS confident_count, (n - cc)::BIGINT AS uncertain_count, {_ACC_VERDICT} FROM a""")
def _(spark, sf):
    return X.accuracy_stats(P.prediction_log(equity(spark, sf)))


_VALID = """lt AS (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY pair ORDER BY exit_time DESC) <= 50),
  vs AS (SELECT pair, "interval", count(*) AS n, avg((pnl_pct > 0)::INT) AS wr, avg(pnl_pct) AS m, coalesce(stddev_samp(pnl_pct), 0) AS sd, arg_max(balance, exit_time) - 100 AS pnl FROM lt GROUP BY 1, 2)"""


@query("a17_validity_stats", f"""{RECURSIVE}{EQUITY}, {_VALID} SELECT pair, "interval", n::BIGINT AS n_closed, {r('wr AS win_rate', 'm AS avg_return_pct', 'CASE WHEN sd > 0 THEN m / sd ELSE 0 END AS sharpe_per_trade', 'pnl AS pnl_total_dollars')},
  CASE WHEN n < 8 THEN 'warming up' WHEN wr > 0.55 AND pnl > 0 THEN 'model is working' WHEN wr < 0.45 AND pnl < 0 THEN 'model is losing' ELSE 'inconclusive' END AS verdict FROM vs""")
def _(spark, sf):
    return X.validity_stats(P.trade_table(equity(spark, sf)))


@query("a25_trade_counters", f"""{RECURSIVE}{EQUITY} SELECT pair, "interval", count(*)::BIGINT AS bars_seen, count(*) FILTER (traded)::BIGINT AS bars_traded,
  count(*) FILTER (NOT traded)::BIGINT AS bars_abstained, {r('arg_max(balance, open_time) - 100 AS pnl_total_dollars')} FROM eq GROUP BY 1, 2""")
def _(spark, sf):
    return X.trade_counters(equity(spark, sf))


@query("g06_snapshot", f"""{RECURSIVE}{EQUITY}, {_VALID}, {_ACC}, lb AS (SELECT * FROM eq QUALIFY row_number() OVER (PARTITION BY pair ORDER BY open_time DESC) = 1),
  rt AS (SELECT pair, count(*) AS n, sum(pnl_dollars) AS s FROM (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY pair ORDER BY exit_time DESC) <= 20) GROUP BY 1),
  et AS (SELECT pair, count(*) AS n, min(balance) AS lo FROM (SELECT * FROM eq QUALIFY row_number() OVER (PARTITION BY pair ORDER BY open_time DESC) <= 500) GROUP BY 1),
  ct AS (SELECT pair, count(*) AS seen, count(*) FILTER (traded) AS tr FROM eq GROUP BY 1)
  SELECT pair, seen::BIGINT AS bars_seen, tr::BIGINT AS bars_traded, {r('lb.balance AS balance', 'CASE WHEN lb.traded THEN lb.balance * lb.size_pct END AS open_dollars', 'vs.wr AS win_rate', 'a.oa AS overall_accuracy', 'rt.s AS recent_pnl', 'et.lo AS equity_low')},
    rt.n::BIGINT AS recent_trades, et.n::BIGINT AS equity_points FROM ct JOIN lb USING (pair) JOIN vs USING (pair) JOIN a USING (pair) JOIN rt USING (pair) JOIN et USING (pair)""")
def _(spark, sf):
    eq = equity(spark, sf)
    snap = P.snapshot(eq, P.trade_table(eq), P.prediction_log(eq))
    total = F.aggregate(F.col("recent_trades.pnl_dollars"), F.lit(0.0), lambda a, x: a + x)
    return snap.select(
        "pair", "bars_seen", "bars_traded", "balance", F.col("open_position.dollars").alias("open_dollars"), F.col("stats.win_rate").alias("win_rate"),
        F.col("accuracy.overall_accuracy").alias("overall_accuracy"), total.alias("recent_pnl"), F.array_min(F.col("equity_curve.balance")).alias("equity_low"),
        F.size("recent_trades").alias("recent_trades"), F.size("equity_curve").alias("equity_points"),
    )


# --------------------------------------------------------------------------- range reports
LO, HI = "2024-01-05 00:00:00", "2024-01-22 12:00:00"
BETWEEN = f"BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'"


def _range():  # bounds given in reverse: the reports swap them
    return F.lit(HI).cast("timestamp"), F.lit(LO).cast("timestamp")


@query("a11_range_ohlc", f"""WITH {BARS}, x AS (SELECT *, ln(close / lag(close) OVER (ORDER BY open_time)) AS lr FROM bars WHERE pair = 'click' AND open_time {BETWEEN})
  SELECT count(*)::BIGINT AS bars, {r('arg_min(close, open_time) AS first_close', 'arg_max(close, open_time) AS last_close', 'max(high) AS high', 'min(low) AS low',
  '(arg_max(close, open_time) - arg_min(close, open_time)) / arg_min(close, open_time) AS return_pct', 'stddev_pop(lr) AS realised_vol')} FROM x""")
def _(spark, sf):
    return R.range_ohlc(bars(spark, sf).filter("pair = 'click'"), *_range(), block=BLOCK)


@query("a12_range_regimes", f"""WITH {VEC} SELECT count(*) FILTER (regime = 0)::BIGINT AS bear, count(*) FILTER (regime = 1)::BIGINT AS sideways, count(*) FILTER (regime = 2)::BIGINT AS bull,
  ((SELECT count(*) FROM vec WHERE open_time {BETWEEN}) - count(*))::BIGINT AS unknown FROM reg WHERE open_time {BETWEEN}""")
def _(spark, sf):
    emb, reg = vectors(spark, sf)
    return R.range_regimes(emb, reg, *_range())


def decoded(spark, sf):
    n = news(spark, sf, unscored=True)
    return n.withColumn("sent_score", decode_sentiment(F.col("sentiment"))["ensemble"])


@query("a13_range_news", f"""WITH {NEWS}, x AS (SELECT CASE WHEN event_id % 11 <> 0 THEN score END AS s FROM news WHERE published_at {BETWEEN})
  SELECT count(*)::BIGINT AS count, {r('avg(s) AS mean', 'max(s) AS max', 'min(s) AS min')} FROM x""")
def _(spark, sf):
    return R.range_news(decoded(spark, sf), *_range())


@query("t02_top_articles", f"""WITH {NEWS} SELECT id, {ms('published_at')}, {r('score AS sent_score')} FROM news WHERE published_at {BETWEEN} AND event_id % 11 <> 0
  ORDER BY abs(score) DESC, id LIMIT 5""")
def _(spark, sf):
    return R.top_articles(decoded(spark, sf), *_range()).select("id", "published_at", "sent_score")


@query("a14_range_predictions", f"""{RECURSIVE}{EQUITY}, x AS (SELECT *, coalesce(correct, false)::INT AS ok FROM plog WHERE open_time >= TIMESTAMP '{LO}')
  SELECT count(*)::BIGINT AS n, count(*) FILTER (cp_singleton)::BIGINT AS n_traded, count(*) FILTER (NOT cp_singleton)::BIGINT AS n_abstained, {r('sum(ok) / count(*) AS overall_accuracy',
  'sum(ok) FILTER (cp_singleton) / count(correct) FILTER (cp_singleton) AS confident_accuracy', 'sum(ok) FILTER (NOT cp_singleton) / count(correct) FILTER (NOT cp_singleton) AS uncertain_accuracy')} FROM x""")
def _(spark, sf):
    return R.range_predictions(P.prediction_log(equity(spark, sf)), F.lit("2030-01-01").cast("timestamp"), F.lit(LO).cast("timestamp"))


@query("a15_p_histogram", """WITH x AS (SELECT (o_orderkey % 130 - 10) / 100e0 AS p FROM orders), b AS (SELECT least(11, floor(p * 12))::BIGINT AS bin, count(*) AS n FROM x WHERE p BETWEEN 0 AND 1 GROUP BY 1)
  SELECT i::BIGINT AS bin, coalesce(n, 0)::BIGINT AS count FROM range(12) t(i) LEFT JOIN b ON b.bin = i""")
def _(spark, sf):
    return X.p_histogram(table(spark, sf, "orders").select(((F.col("o_orderkey") % 130 - 10) / F.lit(100.0)).alias("p_up")))


@query("a11_a15_range_report", f"""{RECURSIVE}{EQUITY}, {NEWS}, x AS (SELECT * FROM plog WHERE pair = 'click' AND open_time {BETWEEN})
  SELECT 'predictions' AS part, count(*)::BIGINT AS n FROM x UNION ALL SELECT 'histogram', count(*)::BIGINT FROM x
  UNION ALL SELECT 'ohlc', count(*)::BIGINT FROM bars WHERE pair = 'click' AND open_time {BETWEEN} UNION ALL SELECT 'news', count(*)::BIGINT FROM news WHERE published_at {BETWEEN}
  UNION ALL SELECT 'regimes', count(*)::BIGINT FROM bars WHERE pair = 'click' AND open_time {BETWEEN} UNION ALL SELECT 'top_news', 5::BIGINT""")
def _(spark, sf):
    own = F.col("pair") == "click"
    log = P.prediction_log(equity(spark, sf)).filter(own)
    parts = R.analyze_range(bars(spark, sf).filter(own), vectors(spark, sf)[1].filter(own), decoded(spark, sf), log, *_range())
    sizes = {"ohlc": F.sum("bars"), "regimes": F.sum(F.col("bear") + F.col("sideways") + F.col("bull") + F.col("unknown")), "news": F.sum("count"),
             "top_news": F.count(F.lit(1)), "predictions": F.sum("n"), "histogram": F.sum("count")}
    out = None
    for name, size in sizes.items():
        row = parts[name].agg(size.alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# --------------------------------------------------------------------------- live path
def _finish(stream_query):
    stream_query.awaitTermination()


def _landed(spark, df, label):
    """Write a table as files for a stream to pick up."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return path


def _closed(spark, sf):
    return with_position(bars(spark, sf), total=None).drop("pos")


@query("x01_x02_x03_x10_candle_stream", f"WITH {BARS} SELECT pair, {ms('open_time')}, {r('close', 'volume')}, trades::BIGINT AS trades FROM bars")
def _(spark, sf):
    source, root = scratch_path(spark, "messages"), scratch_path(spark, "live")
    kline_lines(spark, sf).repartition(4).write.text(source)
    candles = live.stream_candles(spark, source, max_files=2)
    for attempt in ("a", "b"):  # the second run replays everything: nothing may change
        _finish(live.sink_upsert(candles, root, f"{root}-checkpoint-{attempt}"))
    return spark.read.parquet(f"{root}/ohlcv").select("pair", TS, "close", "volume", "trades")


@query("x04_drop_resent", f"""WITH {BARS} SELECT pair, {ms('open_time')}, {r('close + (trades % 3) AS close')} FROM bars
  WHERE open_time <= (SELECT max(open_time) FROM bars) - INTERVAL 2 HOUR""")
def _(spark, sf):
    # every candle comes up to three times, each copy corrected and ingested later, in no order
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("trades") % 3))
    sent = bars(spark, sf).withColumn("copy", copy).withColumn("close", F.col("close") + F.col("copy"))
    sent = sent.withColumn("ingested_at", F.timestamp_millis(F.unix_millis(TS) + F.col("copy") * 1000)).repartition(3, "copy")
    path, out = _landed(spark, sent, "resent"), scratch_path(spark, "unique")
    _finish(live.sink_parquet(live.drop_resent(live.stream_table(spark, path, sent.schema)), out, f"{out}-checkpoint"))
    return spark.read.parquet(out).select("pair", TS, "close")


@query("x05_stream_bars", f"""WITH {BARS} SELECT pair, {ms('open_time')}, {r('open', 'high', 'low', 'close', 'volume')}, trades::BIGINT AS trades FROM bars
  WHERE open_time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet").schema
    events = live.stream_table(spark, sf, raw, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "stream-bars")
    _finish(live.sink_parquet(live.stream_bars(events), out, f"{out}-checkpoint"))
    return spark.read.parquet(out).select("pair", TS, "open", "high", "low", "close", "volume", "trades")


_STREAMED = FEATURE_COLUMNS


@query("x06_x09_stream_features", f"{RECURSIVE}{FEATURES} SELECT pair, {ms('open_time')}, {r(*_STREAMED)} FROM feat")
def _(spark, sf):
    closed = _closed(spark, sf)
    path, out = _landed(spark, closed, "closed"), scratch_path(spark, "stream-features")
    _finish(live.sink_parquet(live.stream_features(live.stream_table(spark, path, closed.schema)), out, f"{out}-checkpoint"))
    rows = spark.read.parquet(out).filter((F.col("pos") >= 50) & ~F.col("late")).dropna(subset=FEATURE_COLUMNS)
    return rows.select("pair", TS, *_STREAMED)


@query("x07_stream_news_window", f"""WITH {BARS}, {NEWS} SELECT b.pair, {ms('b.open_time AS open_time')}, count(n.id)::BIGINT AS sent_count, {r('coalesce(avg(score), 0) AS sent_mean', digits=10)}
  FROM bars b LEFT JOIN news n ON (n.ticker = b.pair OR n.ticker IS NULL) AND n.published_at >= b.open_time - INTERVAL 24 HOUR AND n.published_at < b.open_time GROUP BY 1, b.open_time""", digits=10)
def _(spark, sf):
    closed = bars(spark, sf)
    path, out = _landed(spark, closed, "closed"), scratch_path(spark, "stream-news")
    stored = _landed(spark, news(spark, sf), "scored")
    stream = live.stream_table(spark, path, closed.schema, max_files=4)
    _finish(live.sink_news_features(stream, lambda: spark.read.parquet(stored), out, f"{out}-checkpoint", tickers=TICKERS))
    return spark.read.parquet(out).select("pair", TS, "sent_count", "sent_mean")


@query("x08_stream_positions", f"{RECURSIVE}{EQUITY} SELECT pair, {ms('open_time')}, decision, {r('balance')}, traded FROM eq")
def _(spark, sf):
    rows = outcomes(spark, sf).select(*SERIES, TS, "close", "p_up", "in_set_0", "in_set_1", "vol_24", "vol_168")
    path, out = _landed(spark, rows, "predicted"), scratch_path(spark, "stream-positions")
    _finish(live.sink_parquet(live.stream_positions(live.stream_table(spark, path, rows.schema)), out, f"{out}-checkpoint"))
    return spark.read.parquet(out).select("pair", TS, "decision", "balance", "traded")


@query("x11_stream_scoring", f"{SCORED_SQL} SELECT doc_id, {r('(a + b) / 2 AS ensemble', '(abs(a) + abs(b)) / 2 AS confidence')} FROM s WHERE NOT done")
def _(spark, sf):
    docs = to_score(spark, sf)
    path, out = _landed(spark, docs, "docs"), scratch_path(spark, "scored")
    _finish(live.sink_parquet(live.stream_scored_news(live.stream_table(spark, path, docs.schema)), out, f"{out}-checkpoint"))
    s = decode_sentiment(F.col("sentiment"))
    return spark.read.parquet(out).select("doc_id", s["ensemble"].alias("ensemble"), s["confidence"].alias("confidence"))


# The upsert sink gets every candle three times in each of two batches: it persists one row per candle and batch.
@query("x12_stream_status", f"""WITH {BARS}, n AS (SELECT count(*)::BIGINT AS n FROM bars), e AS (SELECT count(*)::BIGINT AS e FROM events)
  SELECT e AS messages_seen, 5::BIGINT AS batches, false AS running, e AS rows_persisted, 6 * n AS candles_seen, 2 * n AS candles_persisted, n AS candles_stored,
    e > 0 AS persisted FROM n, e""")
def _(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet").schema
    out, copies = scratch_path(spark, "status"), scratch_path(spark, "status-in")
    spark.read.parquet(f"{sf}/events.parquet").repartition(5, "event_id").write.parquet(copies)
    live.watch_progress(spark)
    q = live.sink_parquet(live.stream_table(spark, copies, raw, max_files=1), out, f"{out}-checkpoint")
    _finish(q)
    seen = live.stream_status(q, spark)
    root, landed = scratch_path(spark, "candles"), scratch_path(spark, "candles-in")
    closed = bars(spark, sf).withColumn("ingested_at", F.col(TS))
    sent = closed.withColumn("again", F.explode(F.array(*map(F.lit, range(3))))).drop("again")
    for _ in range(2):
        sent.coalesce(1).write.mode("append").parquet(landed)
    q = live.sink_upsert(live.stream_table(spark, landed, sent.schema, max_files=1), root, f"{root}-checkpoint")
    _finish(q)
    kept = live.stream_status(q, spark)
    stored = spark.read.parquet(f"{root}/ohlcv").count()
    columns = {c: seen[c] for c in ("messages_seen", "batches", "running", "rows_persisted")}
    columns |= {"candles_seen": kept["messages_seen"], "candles_persisted": kept["rows_persisted"], "candles_stored": stored}
    columns["persisted"] = seen["last_persist_at"] is not None and kept["last_persist_at"] is not None
    return spark.range(1).select(*[F.lit(v).alias(c) for c, v in columns.items()])


@query("m20_refit", f"""{RECURSIVE}{DATASET} SELECT pair, count(*) FILTER (pos >= 24)::BIGINT AS rows, 'regimes' AS step FROM bp GROUP BY pair
  UNION ALL SELECT pair, count(*) FILTER (pos >= 63)::BIGINT, 'vectors' FROM bp GROUP BY pair UNION ALL SELECT pair, count(*)::BIGINT, 'anchor' FROM ds GROUP BY pair""")
def _(spark, sf):
    from workload.retrieval import windows
    from barframe.operators.encode import embed_windows

    emb = embed_windows(windows(spark, sf, 64))
    out = refit(bars(spark, sf), emb, dataset(spark, sf))
    parts = None
    for name in ("regimes", "vectors", "anchor"):
        row = out[name].groupBy("pair").agg(F.count(F.lit(1)).alias("rows")).withColumn("step", F.lit(name))
        parts = row if parts is None else parts.unionByName(row)
    return parts


