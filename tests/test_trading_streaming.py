import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barframe.operators import features as X
from barframe.operators import metrics, ranges
from barframe.operators import positions as P
from barframe.operators.series import with_position
from barframe.schema import SERIES, TS
from barframe.session import scratch_path
from barframe.sources import candles
from barframe.streaming import live
from tests.helpers import random_bars


def replay(rows, initial=100.0):
    """Bar-by-bar reference: settle, then gate, size and open."""
    balance, out, prev = initial, [], None
    for r in rows:
        if prev is not None and prev["side"]:
            balance += balance * prev["size"] * prev["side"] * (r["close"] - prev["close"]) / prev["close"]
        side = {"long": 1, "short": -1}.get(r["decision"], 0) if balance > 0.01 else 0
        prev = {"side": side, "size": r["size_pct"], "close": r["close"]}
        out.append((balance, bool(side)))
    return out


@pytest.fixture(scope="module")
def outcomes(spark):
    pdf = pd.concat([random_bars(400, 1, "A"), random_bars(400, 2, "B")])
    wild = pdf["pair"] == "B"
    pdf.loc[wild, "close"] = np.where(np.arange(wild.sum()) % 90 == 60, 900.0, pdf.loc[wild, "close"])
    bars = spark.createDataFrame(pdf)
    rng = np.random.default_rng(0)
    sets = pdf[["pair", "interval", TS]].assign(p_up=rng.uniform(size=len(pdf)), in_set_0=rng.integers(0, 2, len(pdf)), in_set_1=rng.integers(0, 2, len(pdf)))
    sets.loc[sets["pair"] == "B", ["in_set_0", "in_set_1"]] = [1, 0]
    return P.bar_outcomes(spark.createDataFrame(sets), bars, block=64).cache()


def test_equity_equals_sequential_replay(outcomes):
    eq = P.equity_curve(outcomes, block=64).orderBy("pair", TS).toPandas()
    for pair, part in eq.groupby("pair"):
        want = replay(part.to_dict("records"))
        np.testing.assert_allclose(part["balance"], [b for b, _ in want], rtol=1e-9, atol=1e-9)
        assert part["traded"].tolist() == [t for _, t in want]
    ruined = eq[eq["pair"] == "B"]
    assert ruined["balance"].iloc[-1] <= 0.01 and not ruined["traded"].iloc[-1]


def test_gate_size_and_stats(spark, outcomes):
    seen = outcomes.select("in_set_0", "in_set_1", "decision").distinct().collect()
    for r in seen:
        want = {(0, 1): "long", (1, 0): "short"}.get((r["in_set_0"], r["in_set_1"]), "flat")
        assert r["decision"] == want
    v = spark.createDataFrame([(0.0, 1.0), (None, 1.0), (1.0, None), (1.0, 0.01), (1.0, 50.0), (1.0, 0.5)], "a double, b double")
    assert [r["s"] for r in v.select(P.position_size(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, 1.0, 1.0, 0.1, 1.0, 0.5]
    eq = P.equity_curve(outcomes, block=64).cache()
    log = P.prediction_log(eq)
    counts = metrics.trade_counters(eq).collect()
    assert all(r["bars_traded"] + r["bars_abstained"] == r["bars_seen"] for r in counts)
    assert log.filter("correct IS NULL").count() == 2  # the last bar of each series
    acc = metrics.accuracy_stats(log).collect()
    assert all(r["confident_count"] + r["uncertain_count"] == r["n_labelled"] for r in acc)
    snap = P.snapshot(eq, P.trade_table(eq), log).collect()
    assert all(len(r["recent_trades"]) <= 20 and len(r["equity_curve"]) <= 500 for r in snap)


def test_empty_range_gives_zeros(spark):
    bars = spark.createDataFrame(random_bars(50))
    t = F.lit("1999-01-01").cast("timestamp")
    row = ranges.range_ohlc(bars, t, t).first()
    assert row["bars"] == 0 and row["first_close"] == 0.0 and row["realised_vol"] == 0.0


def land(spark, df, label, parts):
    path = scratch_path(spark, label)
    for part in parts:
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    return path


def finish(query):
    query.awaitTermination()
    return query


def test_stream_features_equal_batch_over_restarts(spark):
    bars = candles.normalise_candles(spark.createDataFrame(random_bars(400, 3)))
    ordered = with_position(bars, total=None)
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    for lo in (0, 120, 240):  # each restart continues from the checkpointed state; 10 bars are sent twice
        part = ordered.filter((F.col("pos") >= max(0, lo - 10)) & (F.col("pos") < lo + 120)).drop("pos")
        part.write.mode("append").parquet(path)
        stream = live.stream_features(live.stream_table(spark, path, bars.schema))
        finish(live.sink_parquet(stream, out, f"{out}-checkpoint"))
    got = spark.read.parquet(out).orderBy(TS).toPandas()
    want = X.compute_features(ordered, block=4096).filter(F.col("pos") < 360).orderBy(TS).toPandas()
    assert len(got) == len(want)
    for c in X.FEATURE_COLUMNS:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-8, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("hold", [0, 120])
def test_bars_out_of_order_wait_or_come_out_as_late(spark, hold):
    bars = candles.normalise_candles(spark.createDataFrame(random_bars(181, 5, gaps=0)))
    ordered = with_position(bars, total=None)
    path, out = scratch_path(spark, "late"), scratch_path(spark, "late-out")
    for keep in (F.col("pos") >= 100, F.col("pos") < 100):  # each restart reads one more file, the newer bars first
        ordered.filter(keep).drop("pos").coalesce(1).write.mode("append").parquet(path)
        stream = live.stream_features(live.stream_table(spark, path, bars.schema), hold * 3_600_000)
        finish(live.sink_parquet(stream, out, f"{out}-checkpoint"))
    got = spark.read.parquet(out)
    if not hold:
        assert got.count() == 181 and got.filter("late").count() == 100
    else:  # all bars but those of the last 120 hours, in order
        assert got.filter("late").count() == 0 and sorted(r["pos"] for r in got.collect()) == list(range(61))


def test_stream_positions_equal_batch(spark, outcomes):
    rows = outcomes.select(*SERIES, TS, "close", "p_up", "in_set_0", "in_set_1", "vol_24", "vol_168", "pos")
    path, out = land(spark, rows, "preds", [F.col("pos") < 150, F.col("pos") >= 150]), scratch_path(spark, "pos")
    finish(live.sink_parquet(live.stream_positions(live.stream_table(spark, path, rows.schema)), out, f"{out}-checkpoint"))
    got = spark.read.parquet(out).orderBy("pair", TS).toPandas()
    want = P.equity_curve(outcomes, block=64).orderBy("pair", TS).toPandas()
    np.testing.assert_allclose(got["balance"], want["balance"], rtol=1e-9, atol=1e-9)
    assert (got["traded"] == want["traded"]).all()


def test_upsert_sink_and_status(spark):
    bars = candles.normalise_candles(spark.createDataFrame(random_bars(120, 4))).withColumn("ingested_at", F.current_timestamp())
    path, root = land(spark, bars, "closed", [F.lit(True), F.lit(True)]), scratch_path(spark, "store")
    live.watch_progress(spark)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    q = finish(live.sink_upsert(live.stream_table(spark, path, bars.schema, max_files=1), root, f"{root}-checkpoint"))
    assert candles.read_ohlcv(spark, root).count() == bars.count()
    status = live.stream_status(q, spark)
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert status["messages_seen"] == 2 * bars.count() and status["batches"] == 2 and not status["running"]
    assert status["rows_persisted"] == 2 * bars.count() and status["last_persist_at"]  # the later of equal rows wins in each batch
    stale = land(spark, bars.withColumn("ingested_at", F.lit("2020-01-01").cast("timestamp")), "stale", [F.lit(True)])
    q = finish(live.sink_upsert(live.stream_table(spark, stale, bars.schema), root, f"{root}-checkpoint-2"))
    assert live.stream_status(q, spark)["rows_persisted"] == 0 and live.stream_status(q, spark)["messages_seen"] == bars.count()
