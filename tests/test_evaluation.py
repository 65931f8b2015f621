from datetime import datetime, timedelta
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from barframe.operators import conformal, dm, metrics
from barframe.operators import models as M
from barframe.operators.splits import auto_folds, fold_table
from barframe.schema import SERIES, TS
from barframe.session import materialise, scratch_path
from barframe.streaming import live


def test_student_t_known_values(spark):
    known = [(0.0, 10.0, 1.0), (1.0, 1.0, 0.5), (2.0, 2.0, 1 - 2 / math.sqrt(6)), (2.228138852, 10.0, 0.05), (1.959963985, 1e7, 0.05), (-1.0, 1.0, 0.5)]
    rows = spark.createDataFrame(known, "t double, v double, p double")
    for r in rows.select("p", dm.student_t_two_sided(F.col("t"), F.col("v")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["p"], abs=1e-7)


def preds(spark, rows):
    return spark.createDataFrame(rows, "pair string, interval string, model string, fold long, open_time timestamp, y_true long, y_pred long, y_prob double, next_ret double")


def make(model, truth, guess, prob=None, ret=0.01):
    t0 = datetime(2024, 1, 1)
    return [("A", "1h", model, 0, t0 + timedelta(hours=i), y, g, 0.5 if prob is None else prob[i], ret) for i, (y, g) in enumerate(zip(truth, guess))]


def test_one_class_fold_and_zero_spread(spark):
    row = metrics.fold_metrics(preds(spark, make("m", [1] * 10, [1] * 10))).collect()[0]
    assert row["mcc"] == 0.0 and row["accuracy"] == 1.0 and row["sharpe_per_bar"] == 0.0
    none = metrics.fold_metrics(preds(spark, make("m", [1, 0], [0, 0], [0.0, 1.0]))).collect()[0]
    assert none["precision"] == 0.0 and none["f1"] == 0.0 and none["log_loss"] == pytest.approx(-math.log(1e-7))


def test_intervals_stay_apart(spark):
    """Hourly and daily bars of one pair share times, but never a group."""
    rows = make("a", [1, 0] * 12, [1] * 24) + make("b", [1, 0] * 12, [0] * 24)
    hourly = preds(spark, rows)
    both = hourly.unionByName(hourly.withColumn("interval", F.lit("1d")).withColumn("y_pred", F.lit(1).cast("long")))
    pairs = dm.pair_predictions(both)
    assert pairs.count() == 48
    alone = dm.diebold_mariano(dm.pair_predictions(hourly)).collect()
    assert dm.diebold_mariano(pairs).filter("interval = '1h'").collect() == alone
    folds = metrics.fold_metrics(both)
    assert {(r["interval"], r["n"]) for r in folds.collect()} == {("1h", 24), ("1d", 24)}
    assert metrics.aggregate_folds(folds).count() == 4


def test_folds_follow_the_dataset(spark):
    ds = auto_folds(dataset(spark).drop("initial", "test", "n_folds"), n_folds=10)
    tested = M.test_rows(ds).select("fold").distinct().count()
    assert tested == fold_table(ds, ["pair"], max_folds=10).count() == 10 - (400 - 200) % 10 - 1
    assert M.majority(ds).select("fold").distinct().count() == tested
    assert M.test_rows(ds, 3).select("fold").distinct().count() == 3


def test_dm_edges(spark):
    both = preds(spark, make("a", [1] * 6, [1] * 6) + make("b", [1] * 6, [0] * 6))
    small = dm.diebold_mariano(dm.pair_predictions(both)).collect()[0]
    assert small["dm_stat"] is None and small["verdict"] == "n too small for DM"
    flat = preds(spark, make("a", [1] * 20, [1] * 20) + make("b", [1] * 20, [0] * 20))
    row = dm.diebold_mariano(dm.pair_predictions(flat)).collect()[0]
    assert row["dm_stat"] == pytest.approx(-1 / math.sqrt(1e-12 / 20) * math.sqrt(19 / 20)) and row["verdict"] == "A beats B"
    matrix = {r["model"]: r for r in dm.dm_matrix(flat, ["a", "b"]).collect()}
    assert matrix["a"]["b"] == -matrix["b"]["a"]


def test_conformal_quantile_equals_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"x": rng.uniform(size=501), "y": np.repeat(0.25, 300), "z": np.round(rng.uniform(size=97), 2), "w": rng.uniform(size=31)}
    rows = [(k, 0, 0, float(v)) for k, vs in groups.items() for v in vs]
    calib = spark.createDataFrame(rows, "pair string, fold long, y_true long, y_prob double")
    got = {r["pair"]: r for r in conformal.conformal_threshold(calib, by=("pair", "fold")).collect()}
    for k, vs in groups.items():
        n = len(vs)
        level = min(1.0, math.ceil((n + 1) * 0.9) / n)
        if n < 32:
            assert got[k]["threshold"] is None
        else:
            assert got[k]["threshold"] == pytest.approx(np.quantile(vs, level), abs=1e-12)


def test_close_values_are_selected_digit_by_digit(spark):
    """All values within 1e-4 of a half, one group within 1e-12 of it, one of tiny values: no cell of more than 16 is sorted."""
    rng = np.random.default_rng(2)
    groups = {
        "close": 0.5 + rng.uniform(-1e-4, 1e-4, 4000), "closer": 0.5 + rng.uniform(-1e-12, 1e-12, 3000), "ends": rng.choice([0.0, 1.0, 1 - 2**-53], 900),
        "tiny": rng.uniform(0, 1e-13, 500), "same": np.full(700, 1 / 3), "one": np.array([0.7]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None)], "pair string, v double").repartition(6)
    for level in (0.0, 0.37, 0.9, 1.0):
        got = {r["pair"]: r for r in conformal.quantile_per_group(df, ["pair"], "v", F.lit(level), most=16).collect()}
        for k, vs in groups.items():
            assert got[k]["n"] == len(vs) and got[k]["quantile"] == pytest.approx(np.quantile(vs, level), rel=1e-15, abs=1e-30), (k, level)
    assert conformal.quantile_per_group(df.limit(0), ["pair"], "v", F.lit(0.5)).count() == 0


def test_conformal_sets_can_be_empty_or_double(spark):
    df = spark.createDataFrame([("A", 0, 0.5), ("A", 0, 0.9)], "pair string, fold long, y_prob double")
    thr = lambda v: spark.createDataFrame([("A", 0, v)], "pair string, fold long, threshold double")
    sizes = lambda v: sorted(r["in_set_0"] + r["in_set_1"] for r in conformal.with_conformal_set(df, thr(v), ("pair", "fold")).collect())
    assert sizes(0.3) == [0, 1] and sizes(0.95) == [2, 2] and sizes(None) == [1, 1]


def dataset(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 100] + [0, 3, -50]
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    rows = [("A", "1h", datetime(2024, 1, 1) + timedelta(hours=i), i, n, n // 2, n // 12, 6, int(y[i]), 0.0, *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, f"pair string, interval string, {TS} timestamp, row long, n long, initial long, test long, n_folds long, y long, next_ret double, a double, b double, c double")


def test_grouped_newton_equals_spark_ml(spark):
    ds = dataset(spark)
    inputs = ds.withColumn("x", F.array("a", "b", "c"))
    fits = M.fit_logistic(inputs, 3, conformal=False, max_folds=2)
    train = ds.filter(F.col("row") < 200)
    scaled = M.balance_weights(M.standardise(train, train, ["a", "b", "c"]))
    model = M.logistic_estimator(200).fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(scaled))
    stats = M.scaling_stats(train, ["a", "b", "c"]).first()
    fit = fits.filter("fold = 0").first()
    np.testing.assert_allclose(np.array(fit["weights"]) * stats["std"], model.coefficients.toArray(), atol=1e-5)
    assert fit["bias"] + np.dot(fit["weights"], stats["mean"]) == pytest.approx(model.intercept, abs=1e-5)
    assert fits.filter("NOT converged").count() == 0 and fits.count() == 2
    probs = model.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(scaled)).select(vector_to_array("probability")[1].alias("p"), TS)
    ours = M.score_with(fits, inputs.filter("row < 200").withColumn("fold", F.lit(0).cast("long")))
    worst = probs.join(ours, TS).agg(F.max(F.abs(F.col("p") - F.col("prob"))).alias("d")).collect()[0]["d"]
    assert worst < 1e-5


def test_stored_model_scores_later_bars_in_batch_and_stream(spark, monkeypatch):
    monkeypatch.setattr(M, "FEATURE_COLUMNS", ["a", "b", "c"])
    ds = dataset(spark, 600)
    models = materialise(M.anchor_model(ds), "model")
    row = models.first()
    assert row["converged"] and len(row["weights"]) == 3 and 0 < row["threshold"] < 1
    whole = M.fit_anchor(ds)
    x, _ = M.input_array()
    later = ds.filter("row >= 500").select(*SERIES, TS, x.alias("x"))
    batch = M.predict_bars(models, later)
    both = batch.join(whole.select(TS, F.col("p_up").alias("p"), F.col("in_set_0").alias("i0"), F.col("in_set_1").alias("i1")), TS)
    assert both.count() == 100 and both.filter("abs(p - p_up) > 1e-9 OR i0 <> in_set_0 OR i1 <> in_set_1").count() == 0
    path, out = scratch_path(spark, "bars"), scratch_path(spark, "scored")
    later.repartition(3).write.parquet(path)
    stream = M.predict_bars(models, live.stream_table(spark, path, later.schema, max_files=1))
    live.sink_parquet(stream, out, f"{out}-checkpoint").awaitTermination()
    assert spark.read.parquet(out).select(TS, "p_up").exceptAll(batch.select(TS, "p_up")).count() == 0


def test_degenerate_fold_predicts_base_rate(spark):
    ds = dataset(spark).withColumn("y", F.lit(1).cast("long")).withColumn("x", F.array("a", "b", "c"))
    fit = M.fit_logistic(ds, 3, conformal=True, max_folds=1).first()
    assert fit["weights"] is None and fit["base_rate"] == 1.0 and not fit["converged"]


def test_fits_in_blocks_of_many_series_are_one_fit_each(spark, monkeypatch):
    ds = dataset(spark).withColumn("x", F.array("a", "b", "c"))
    alone = {r["fold"]: r for r in M.fit_logistic(ds, 3, max_folds=3).collect()}
    monkeypatch.setattr(M, "_BLOCK", 37)
    many = ds.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: k.cast("string"))))
    found = M.fit_logistic(many, 3, max_folds=3).collect()
    assert len(found) == 41 * len(alone) and len(alone) == 3
    for r in found:
        np.testing.assert_allclose(r["weights"], alone[r["fold"]]["weights"], rtol=1e-7)
        assert r["bias"] == pytest.approx(alone[r["fold"]]["bias"], rel=1e-7) and r["base_rate"] == pytest.approx(alone[r["fold"]]["base_rate"])
    assert M.fit_logistic(ds.limit(0), 3).count() == 0


def test_walk_forward_never_trains_on_test_rows(spark):
    tested = M.test_rows(dataset(spark))
    assert tested.filter(F.col("row") < F.col("train_end") + 1).count() == 0
    rates = M.base_rates(dataset(spark)).orderBy("fold").collect()
    ys = [r["y"] for r in dataset(spark).orderBy("row").collect()]
    assert rates[1]["base_rate"] == pytest.approx(np.mean(ys[:233]))
    assert M.random_coin(dataset(spark)).select(*SERIES, "y_prob").exceptAll(M.random_coin(dataset(spark)).select(*SERIES, "y_prob")).count() == 0
