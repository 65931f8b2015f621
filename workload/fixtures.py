"""The library's input tables, derived from the given ones, in Spark and as SQL building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.operators.features import FEATURE_COLUMNS
from barframe.operators.splits import auto_folds
from barframe.operators.labels import build_dataset
from barframe.operators.features import build_features
from barframe.schema import SERIES, TS
from barframe.session import materialise
from barframe.sources.candles import bars_from_events

BLOCK = 256  # small blocks, so that the small tables exercise block borders and halos
PAIRS = ["click", "error", "purchase", "signup", "view"]
TICKERS = {p: [p] for p in PAIRS}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_events(table(spark, sf, "events"), taker=F.col("user_id") % 2 == 0)


def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_events(
        table(spark, sf, "orders"), pair="o_orderpriority", ts="o_orderdate", price="o_totalprice",
        width="1 day", interval="1d", tie="o_orderkey",
    )


BARS = """bars AS (
  SELECT event_type AS pair, '1h' AS "interval", date_trunc('hour', ts) AS open_time,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
         sum(value) AS volume, count(*) AS trades,
         coalesce(sum(value) FILTER (WHERE user_id % 2 = 0), 0) AS taker_buy_base
  FROM events GROUP BY 1, 2, 3)"""
BP = BARS + """, bp AS (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY open_time) - 1 AS pos,
         count(*) OVER (PARTITION BY pair) AS n_rows FROM bars)"""


def news(spark: SparkSession, sf: str, unscored: bool = False) -> DataFrame:
    """Articles from events; with ``unscored`` every eleventh has no sentiment."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    s = (F.col("k") - 50) / F.lit(50.0)
    payload = F.to_json(F.struct(s.alias("cryptobert"), s.alias("finbert"), s.alias("ensemble"), F.abs(s).alias("confidence")))
    if unscored:
        payload = F.when(F.col("event_id") % 11 != 0, payload)
    late = F.when(F.col("event_id") % 97 == 0, F.lit(-1)).otherwise(F.col("event_id") % 7)
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.concat(F.lit("Feed "), F.col("user_id") % 3).alias("source"),
        F.concat_ws(" ", F.lit("item"), F.col("event_type")).alias("title"),
        F.concat(F.lit("http://n/"), F.col("event_id") % 5000).alias("url"), F.lit("").alias("summary"),
        F.col("ts").alias("published_at"), F.timestamp_micros(F.unix_micros("ts") + late * 60_000_000).alias("ingested_at"),
        F.when(F.col("event_id") % 5 != 0, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("tickers"),
        F.lit(None).cast("map<string,bigint>").alias("raw_sentiment"), payload.alias("sentiment"), "event_id",
    )


NEWS = """news AS (
  SELECT event_id::VARCHAR AS id, 'Feed ' || (user_id % 3)::VARCHAR AS source, 'item ' || event_type AS title,
         'http://n/' || (event_id % 5000)::VARCHAR AS url, ts AS published_at,
         ts + to_minutes((CASE WHEN event_id % 97 = 0 THEN -1 ELSE event_id % 7 END)::INT) AS ingested_at,
         CASE WHEN event_id % 5 <> 0 THEN event_type END AS ticker, event_id,
         ((props->>'$.k')::INT - 50) / 50e0 AS score, abs(((props->>'$.k')::INT - 50) / 50e0) AS conf
  FROM events)"""


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(embeddings, regimes) of one hourly series; every seventh bar has no regime label."""
    e = table(spark, sf, "embeddings").withColumns({
        "pair": F.lit("vec"), "interval": F.lit("1h"),
        TS: F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("vec_id") * 3_600_000),
        "regime": (F.col("label") % 3).cast("short"),
    })
    return e.select(*SERIES, TS, "embedding"), e.filter(F.col("vec_id") % 7 != 0).select(*SERIES, TS, "regime")


VEC = """vec AS (
  SELECT 'vec' AS pair, '1h' AS "interval", TIMESTAMP '2024-01-01' + to_hours(vec_id::INT) AS open_time,
         embedding::DOUBLE[] AS embedding, (label % 3)::INT AS regime, vec_id FROM embeddings),
  reg AS (SELECT pair, "interval", open_time, regime FROM vec WHERE vec_id % 7 <> 0)"""


def vector_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Next direction of the vector series: the label of the next vector against this one's."""
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("nxt"))
    return e.join(nxt, "vec_id").select(
        F.lit("vec").alias("pair"), F.lit("1h").alias("interval"),
        F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("vec_id") * 3_600_000).alias(TS),
        (F.col("nxt") > F.col("label")).cast("int").alias("next_dir"),
    )


VEC_LABELS = """vlab AS (
  SELECT a.open_time, a.pair, (b.l > a.l)::INT AS next_dir
  FROM (SELECT 'vec' AS pair, TIMESTAMP '2024-01-01' + to_hours(vec_id::INT) AS open_time, vec_id, label AS l FROM embeddings) a
  JOIN (SELECT vec_id - 1 AS vec_id, label AS l FROM embeddings) b USING (vec_id))"""


# --------------------------------------------------------------------------- features, dataset, predictions
def features(spark: SparkSession, sf: str) -> DataFrame:
    return build_features(bars(spark, sf), block=BLOCK)


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Fold-ready dataset; both stages are stored, as in ``plans.model_dataset``."""
    feats = materialise(features(spark, sf), "features")
    return materialise(auto_folds(build_dataset(feats, block=BLOCK)), "dataset")


_A14, _A12, _A26, _A9 = "(1e0/14)", "(2e0/13)", "(2e0/27)", "(2e0/10)"
EMA = f"""d AS (
  SELECT pair, pos, close, close - lag(close) OVER w AS delta,
         greatest(abs(high - low), abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM bp WINDOW w AS (PARTITION BY pair ORDER BY pos)),
e AS (
  SELECT pair, pos, close AS fast, close AS slow, 0e0 AS sig, NULL::DOUBLE AS up, NULL::DOUBLE AS down, tr AS atr
  FROM d WHERE pos = 0
  UNION ALL
  SELECT d.pair, d.pos, {_A12} * d.close + (1 - {_A12}) * e.fast, {_A26} * d.close + (1 - {_A26}) * e.slow,
         {_A9} * (({_A12} * d.close + (1 - {_A12}) * e.fast) - ({_A26} * d.close + (1 - {_A26}) * e.slow)) + (1 - {_A9}) * e.sig,
         CASE WHEN e.up IS NULL THEN greatest(d.delta, 0) ELSE {_A14} * greatest(d.delta, 0) + (1 - {_A14}) * e.up END,
         CASE WHEN e.down IS NULL THEN greatest(-d.delta, 0) ELSE {_A14} * greatest(-d.delta, 0) + (1 - {_A14}) * e.down END,
         {_A14} * d.tr + (1 - {_A14}) * e.atr
  FROM e JOIN d ON d.pair = e.pair AND d.pos = e.pos + 1),
ind AS (
  SELECT pair, pos, fast - slow AS macd, sig AS macd_signal, fast - slow - sig AS macd_hist,
         CASE WHEN pos >= 14 THEN 100 - 100 / (1 + up / nullif(down, 0)) END AS rsi_14,
         CASE WHEN pos >= 13 THEN atr END AS atr_14
  FROM e)"""


def returns_sql(lags=(1, 2, 3, 5, 10, 20)) -> list[str]:
    return [f"ln(close / nullif(lag(close, {k}) OVER w, 0)) AS ret_{k}" for k in lags]


def rolling_sql(windows=(5, 10, 20, 50)) -> list[str]:
    out = []
    for n in windows:
        o = f"OVER w{n}"
        full = f"CASE WHEN count(*) {o} = {n} THEN"
        out += [
            f"{full} avg(close) {o} END AS sma_{n}", f"{full} stddev_pop(close) {o} END AS std_{n}",
            f"{full} (close - min(close) {o}) / nullif(max(close) {o} - min(close) {o}, 0) END AS band_pos_{n}",
        ]
    return out


BB = """CASE WHEN count(*) OVER w20 = 20 THEN (close - (avg(close) OVER w20 - 2 * stddev_pop(close) OVER w20))
  / nullif(4 * stddev_pop(close) OVER w20, 0) END AS bb_pct_b"""
VOLUME = [
    f"CASE WHEN count(*) OVER w{n} = {n} THEN volume / nullif(avg(volume) OVER w{n}, 0) END AS vol_ratio_{n}" for n in (10, 50)
] + ["taker_buy_base / nullif(volume, 0) AS taker_buy_share"]
TIME = [
    "sin(2 * pi() * hour(open_time) / 24) AS hod_sin", "cos(2 * pi() * hour(open_time) / 24) AS hod_cos",
    "sin(2 * pi() * (isodow(open_time) - 1) / 7) AS dow_sin", "cos(2 * pi() * (isodow(open_time) - 1) / 7) AS dow_cos",
]
WINDOWS = "WINDOW w AS (PARTITION BY pair ORDER BY pos), " + ", ".join(
    f"w{n} AS (PARTITION BY pair ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 10, 20, 50)
)
_ALL_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLUMNS)
FEATURES = f"""{BP}, {EMA}, raw AS (
  SELECT bp.*, {', '.join(returns_sql() + rolling_sql() + [BB] + VOLUME + TIME)} FROM bp {WINDOWS}),
feat AS (
  SELECT raw.*, macd, macd_signal, macd_hist, rsi_14, atr_14 FROM raw JOIN ind USING (pair, pos)
  WHERE pos >= 50 AND {_ALL_NOT_NULL})"""
DATASET = f"""{FEATURES}, ds0 AS (
  SELECT *, row_number() OVER w - 1 AS "row", lead(close) OVER w AS nxt, count(*) OVER (PARTITION BY pair) AS total
  FROM feat WINDOW w AS (PARTITION BY pair ORDER BY open_time)),
ds1 AS (
  SELECT *, total - 1 AS n, (nxt > close)::BIGINT AS y,
         CASE WHEN "row" < total - 2 THEN ln(nxt / close) ELSE 0 END AS next_ret
  FROM ds0 WHERE nxt IS NOT NULL),
ds2 AS (SELECT *, floor(n * 0.5e0)::BIGINT AS initial FROM ds1),
ds AS (SELECT *, greatest(1, (n - initial) // 6) AS test FROM ds2)"""
FOLDS = f"""{DATASET}, sizes AS (SELECT DISTINCT pair, n, initial, test FROM ds),
folds AS (
  SELECT pair, k AS fold, initial + k * test AS train_end, initial + k * test + 1 AS test_start,
         initial + k * test + 1 + test AS test_end
  FROM sizes, range(6) t(k) WHERE initial + k * test + 1 + test <= n),
tst AS (
  SELECT ds.*, fold, train_end FROM ds JOIN folds ON ds.pair = folds.pair AND "row" >= test_start AND "row" < test_end)"""
# persistence with a smooth probability, and majority: the predictions used by metric queries
PREDS = f"""{FOLDS}, rates AS (
  SELECT folds.pair, fold, avg(y) AS p FROM folds JOIN ds ON ds.pair = folds.pair AND ds."row" < train_end GROUP BY 1, 2),
preds AS (
  SELECT pair, 'naive_persistence' AS model, fold, open_time, y AS y_true, (ret_1 > 0)::BIGINT AS y_pred,
         (ret_1 > 0)::DOUBLE AS y_prob, next_ret FROM tst
  UNION ALL
  SELECT pair, 'naive_majority', fold, open_time, y, (p >= 0.5)::BIGINT, p, next_ret FROM tst JOIN rates USING (pair, fold)
  UNION ALL
  SELECT pair, 'smooth', fold, open_time, y, (1 / (1 + exp(-50 * ret_1)) >= 0.5)::BIGINT, 1 / (1 + exp(-50 * ret_1)), next_ret FROM tst)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    from barframe.operators import models as M

    ds = dataset(spark, sf)
    smooth = M.as_predictions(M.test_rows(ds), "smooth", 1 / (1 + F.exp(-50 * F.col("ret_1"))))
    return M.persistence(ds).unionByName(M.majority(ds)).unionByName(smooth)


# gated positions: probability and sets from the last move, over all bars that have one
def position_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(predictions with conformal sets, bars); closes are lifted by 20,000, so that moves stay small."""
    from barframe.operators.features import with_log_returns
    from barframe.operators.series import with_position

    b = bars(spark, sf).withColumn("close", F.col("close") + 20000)
    moved = with_log_returns(with_position(b, rows=BLOCK, total=None), (1,), block=BLOCK).filter(F.col("ret_1").isNotNull())
    p = 1 / (1 + F.exp(20 * F.col("ret_1")))
    preds = moved.select(*SERIES, TS, p.alias("p_up")).withColumns({
        "in_set_0": (F.col("p_up") <= 0.505).cast("int"), "in_set_1": (1 - F.col("p_up") <= 0.505).cast("int"),
    })
    return preds, b


_POS = f"""{BP}, v AS (
  SELECT pair, "interval", open_time, pos, close, ln(close / lag(close) OVER (PARTITION BY pair ORDER BY pos)) AS ret
  FROM (SELECT * REPLACE (close + 20000 AS close) FROM bp)),
v2 AS (
  SELECT *, CASE WHEN count(ret) OVER a = 24 THEN stddev_pop(ret) OVER a END AS vol_24,
         CASE WHEN count(ret) OVER b = 168 THEN stddev_pop(ret) OVER b END AS vol_168
  FROM v WINDOW a AS (PARTITION BY pair ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
                b AS (PARTITION BY pair ORDER BY pos ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)),
o0 AS (
  SELECT pair, "interval", open_time, close, vol_24, vol_168, 1 / (1 + exp(20 * ret)) AS p_up,
         row_number() OVER w - 1 AS p, lead(close) OVER w AS exit_price, lead(open_time) OVER w AS exit_time
  FROM v2 WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY pair ORDER BY open_time)),
o1 AS (
  SELECT *, p_up <= 0.505 AS down_in, 1 - p_up <= 0.505 AS up_in,
         CASE WHEN vol_24 IS NULL OR vol_24 <= 0 THEN 1e0
              ELSE greatest(0.1e0, least(1e0, CASE WHEN vol_168 IS NULL OR vol_168 <= 0 THEN 1e0 ELSE vol_168 / vol_24 END)) END AS size_pct
  FROM o0),
outcome AS (
  SELECT *, CASE WHEN up_in AND NOT down_in THEN 'long' WHEN down_in AND NOT up_in THEN 'short' ELSE 'flat' END AS decision,
         up_in <> down_in AS cp_singleton, (p_up >= 0.5)::BIGINT AS predicted,
         CASE WHEN up_in AND NOT down_in THEN 1e0 WHEN down_in AND NOT up_in THEN -1e0 ELSE 0e0 END
           * (exit_price - close) / nullif(close, 0) AS pnl_pct
  FROM o1)"""
OUTCOME = _POS
EQUITY = f"""{_POS}, walk AS (
  SELECT pair, p, 100e0 AS balance FROM outcome WHERE p = 0
  UNION ALL
  SELECT o.pair, o.p, CASE WHEN walk.balance > 0.01 AND prev.decision <> 'flat'
         THEN walk.balance + walk.balance * prev.size_pct * prev.pnl_pct ELSE walk.balance END
  FROM walk JOIN outcome o ON o.pair = walk.pair AND o.p = walk.p + 1
            JOIN outcome prev ON prev.pair = walk.pair AND prev.p = walk.p),
eq AS (SELECT outcome.*, balance, decision <> 'flat' AND balance > 0.01 AS traded FROM outcome JOIN walk USING (pair, p)),
trades AS (
  SELECT pair, "interval", decision AS direction, open_time AS entry_time, exit_time, close AS entry_price, exit_price,
         balance * size_pct AS dollars, size_pct, balance * size_pct * pnl_pct AS pnl_dollars, pnl_pct,
         balance * size_pct * pnl_pct > 0 AS hit, p_up, balance + balance * size_pct * pnl_pct AS balance
  FROM eq WHERE traded AND exit_price IS NOT NULL),
plog AS (
  SELECT *, CASE WHEN exit_price IS NOT NULL THEN (exit_price > close)::BIGINT END AS actual,
         CASE WHEN exit_price IS NOT NULL THEN (exit_price > close)::BIGINT = predicted END AS correct FROM eq)"""
