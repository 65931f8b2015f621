import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barframe.operators import features as X
from barframe.operators.labels import build_dataset, with_direction_label
from barframe.operators.series import ema_memory, running, with_ema, with_position
from barframe.schema import TS
from tests.helpers import random_bars


@pytest.fixture(scope="module")
def pdf():
    return random_bars(2500)


def test_positions_do_not_depend_on_slots(spark, pdf):
    both = pd.concat([pdf, random_bars(300, 1, "B")])
    for rows in (64, 100_000):
        out = with_position(spark.createDataFrame(both), rows=rows).orderBy("pair", TS).toPandas()
        assert (out.groupby("pair")["pos"].apply(lambda s: (s.values == np.arange(len(s))).all())).all()
        assert (out["n_rows"] == out.groupby("pair")["pos"].transform("size")).all()


def wilder(x):
    return x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()


@pytest.mark.parametrize("block", [1024, 100_000])
def test_features_equal_pandas(spark, pdf, block):
    out = X.compute_features(with_position(spark.createDataFrame(pdf), rows=128), block=block).orderBy(TS).toPandas()
    c, v = pdf["close"], pdf["volume"]
    d = c.diff()
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    signal = macd.ewm(span=9, adjust=False).mean()
    tr = pd.concat([(pdf.high - pdf.low).abs(), (pdf.high - c.shift()).abs(), (pdf.low - c.shift()).abs()], axis=1).max(axis=1)
    w20, w10 = c.rolling(20), c.rolling(10)
    expected = {
        "ret_5": np.log(c / c.shift(5)), "sma_50": c.rolling(50).mean(), "std_20": w20.std(ddof=0),
        "band_pos_10": (c - w10.min()) / (w10.max() - w10.min()),
        "rsi_14": 100 - 100 / (1 + wilder(d.clip(lower=0)) / wilder(-d.clip(upper=0))),
        "macd": macd, "macd_signal": signal, "macd_hist": macd - signal, "atr_14": wilder(tr),
        "bb_pct_b": (c - (w20.mean() - 2 * w20.std(ddof=0))) / (4 * w20.std(ddof=0)),
        "vol_ratio_50": v / v.rolling(50).mean(),
        "dow_cos": np.cos(2 * np.pi * pdf["open_time"].dt.dayofweek / 7),
    }
    for name, want in expected.items():
        got = out[name].astype(float).to_numpy()
        assert (np.isnan(got) == np.isnan(want.to_numpy())).all(), name
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9, err_msg=name)
    assert np.isnan(out["rsi_14"][13]) and not np.isnan(out["rsi_14"][14])
    assert np.isnan(out["atr_14"][12]) and not np.isnan(out["atr_14"][13])


def test_ema_across_blocks_and_memory(spark, pdf):
    df = with_position(spark.createDataFrame(pdf))
    out = with_ema(df, "close", span=12, block=512).orderBy(TS).toPandas()
    np.testing.assert_allclose(out["ema_close"], pdf["close"].ewm(span=12, adjust=False).mean(), rtol=1e-12)
    assert (1 - 2 / 13) ** ema_memory(2 / 13) <= 2.0**-80
    same = with_ema(df, "close", alpha=1.0).toPandas()
    assert (same["ema_close"] == same["close"]).all()


def test_flat_window_and_zero_volume(spark):
    pdf = random_bars(80, gaps=0)
    pdf[["open", "high", "low", "close"]] = 5.0
    pdf["volume"] = 0.0
    out = X.compute_features(with_position(spark.createDataFrame(pdf))).orderBy(TS).toPandas()
    for name in ("band_pos_5", "bb_pct_b", "rsi_14", "vol_ratio_10", "taker_buy_share"):
        assert out[name].isna().all(), name
    assert (out["std_5"][4:] == 0).all()
    assert X.build_features(spark.createDataFrame(pdf)).count() == 0


def test_no_feature_sees_later_rows(spark, pdf):
    cut = 1500
    changed = pdf.copy()
    changed.loc[cut + 1:, ["open", "high", "low", "close", "volume", "taker_buy_base"]] *= 3.7
    frames = [X.build_features(spark.createDataFrame(p), block=1024).filter(F.col("pos") <= cut).orderBy(TS).toPandas() for p in (pdf, changed)]
    pd.testing.assert_frame_equal(*frames)


def test_labels_skip_dropped_rows_and_tail(spark, pdf):
    feats = X.build_features(spark.createDataFrame(pdf)).cache()
    kept = feats.filter(F.col("pos") % 7 != 0)
    ds = build_dataset(kept, block=256).orderBy(TS).toPandas()
    close = kept.orderBy(TS).toPandas()["close"]
    assert len(ds) == len(close) - 1 and (ds["n"] == len(ds)).all()
    assert (ds["y"].to_numpy() == (close.shift(-1) > close).to_numpy()[:-1]).all()
    assert ds["next_ret"].iloc[-1] == 0.0
    flat = spark.createDataFrame(pdf.assign(close=1.0))
    assert with_direction_label(with_position(flat)).filter("y = 1").count() == 0
    with pytest.raises(ValueError):
        with_direction_label(flat, 0)


def test_running_values_carry_over_blocks(spark, pdf):
    df = with_position(spark.createDataFrame(pdf))
    growth = F.col("close") / 100
    out = running(df, {"p": ("product", growth), "s": ("sum", F.col("volume")), "m": ("min", F.col("close"))}, block=64).orderBy(TS).toPandas()
    np.testing.assert_allclose(np.log(out["p"]), np.log(pdf["close"] / 100).cumsum(), rtol=1e-9)
    np.testing.assert_allclose(out["s"], pdf["volume"].cumsum(), rtol=1e-12)
    assert (out["m"] == pdf["close"].cummin()).all()
    before = running(df, {"s": ("sum", F.col("volume"))}, block=64, exclusive=True).orderBy(TS).toPandas()
    np.testing.assert_allclose(before["s"], pdf["volume"].cumsum().shift(fill_value=0), rtol=1e-12, atol=1e-9)
