"""Whole plans: candles to balances with a stored model, and a sweep's stored metrics with its times."""

import numpy as np
from pyspark.sql import functions as F

from barframe.operators import models as M
from barframe.operators import positions as P
from barframe.operators.features import FEATURE_COLUMNS, build_features
from barframe.plans import sweep
from barframe.schema import SERIES, TS
from barframe.session import materialise, scratch_path
from barframe.sources import candles, sinks
from tests.helpers import random_bars


def test_candles_to_balances_with_a_stored_model(spark):
    bars = candles.normalise_candles(spark.createDataFrame(random_bars(500, 4, gaps=0)))
    weights = [20.0 if c == "ret_1" else 0.0 for c in FEATURE_COLUMNS]
    models = spark.createDataFrame([("A", "1h", weights, 0.1, 0.5, 0.53)], "pair string, interval string, weights array<double>, bias double, base_rate double, threshold double")
    chain = sweep.trade_bars(bars, models, block=64).orderBy(TS).toPandas()
    closes = bars.orderBy(TS).toPandas()
    ready = build_features(bars, block=64).dropna(subset=FEATURE_COLUMNS).orderBy(TS).toPandas()
    p = 1 / (1 + np.exp(-(20 * ready["ret_1"] + 0.1)))
    assert (chain[TS] == ready[TS]).all() and 300 < len(chain) < len(closes)
    np.testing.assert_allclose(chain["p_up"], p, rtol=1e-9)
    up, down = 1 - p <= 0.53, p <= 0.53
    wanted = np.where(up & ~down, "long", np.where(down & ~up, "short", "flat"))
    assert (chain["decision"] == wanted).all() and len(set(wanted)) > 1
    balance = 100.0
    price = ready["close"].to_numpy() if "close" in ready else closes.set_index(TS).loc[ready[TS], "close"].to_numpy()
    for k in range(len(chain)):
        np.testing.assert_allclose(chain["balance"][k], balance, rtol=1e-9)
        side = {"long": 1, "short": -1, "flat": 0}[wanted[k]]
        if k + 1 < len(chain):
            balance *= 1 + chain["size_pct"][k] * side * (price[k + 1] - price[k]) / price[k]
    assert P.trade_table(sweep.trade_bars(bars, models)).count() == int(chain["traded"][:-1].sum())


def test_sweep_stores_elapsed_seconds(spark):
    bars = candles.normalise_candles(spark.createDataFrame(random_bars(400, 5, gaps=0)))
    ds = sweep.model_dataset(bars)
    root, seconds = scratch_path(spark, "sweep"), {}

    def broken(_):
        raise RuntimeError("no")

    models = {"naive_majority": M.majority, "broken": broken, "naive_persistence": M.persistence}
    preds, failures = sweep.run_sweep(ds, models, root, seconds=seconds)
    assert set(failures) == {"broken"} and set(seconds) == {"naive_majority", "naive_persistence"}
    stored = {r["model"]: r["elapsed_seconds"] for r in sinks.read_summaries(spark, root).collect()}
    assert stored == seconds and all(v > 0 for v in stored.values())
    summary = materialise(sweep.sweep_summary(preds, seconds), "summary")
    assert summary.filter(F.col("elapsed_seconds").isNull()).count() == 0 and set(SERIES) <= set(summary.columns)
    assert "elapsed_seconds" not in sweep.sweep_summary(preds).columns
