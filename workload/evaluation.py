"""Queries for splits, models, metrics, forecast comparison and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.functions.scalar import signed_p
from barframe.operators import conformal as C
from barframe.operators import boosting, dm, splits
from barframe.operators import metrics as X
from barframe.operators import models as M
from barframe.operators.checks import pending_runs
from barframe.operators.features import FEATURE_COLUMNS
from barframe.operators.news import align_modalities
from barframe.plans import sweep
from barframe.schema import SERIES, TS
from barframe.session import materialise, scratch_path
from barframe.sources import sinks
from workload.fixtures import BP, DATASET, FOLDS, PREDS, VEC, bars, dataset, predictions, table, vectors
from workload.registry import ms, query, r
from workload.text import sentiment

RECURSIVE = "WITH RECURSIVE "


@query("m01_walk_forward", f'{RECURSIVE}{FOLDS} SELECT pair, {ms("open_time")}, fold::BIGINT AS fold, "row"::BIGINT AS row, train_end::BIGINT AS train_end FROM tst')
def _(spark, sf):
    return M.test_rows(dataset(spark, sf)).select("pair", TS, "fold", "row", "train_end")


@query("m01_overlapping_folds", f"""WITH {BP}, f AS (SELECT pair, n_rows, k FROM (SELECT DISTINCT pair, n_rows FROM bp), range(1000) t(k)
    WHERE 100 + k * 20 + 2 + 50 <= n_rows)
  SELECT bp.pair, {ms('open_time')}, k::BIGINT AS fold FROM bp JOIN f ON f.pair = bp.pair AND pos >= 102 + k * 20 AND pos < 152 + k * 20""")
def _(spark, sf):
    from workload.bars import positioned

    out = splits.walk_forward(positioned(spark, sf), 100, 50, step=20, gap=2, row="pos", n="n_rows")
    return out.select("pair", TS, "fold")


@query("m02_auto_folds", f"{RECURSIVE}{FOLDS} SELECT pair, fold::BIGINT AS fold, train_end::BIGINT AS train_end, test_start::BIGINT AS test_start, test_end::BIGINT AS test_end FROM folds")
def _(spark, sf):
    return splits.fold_table(dataset(spark, sf), ["pair"], max_folds=6)


@query("m03_phase_splits", f"""WITH {BP}, e AS (SELECT *, [floor(n_rows * k / 3e0)::BIGINT for k in [0, 1, 2, 3]] AS ed FROM bp),
  p AS (SELECT *, (pos >= ed[2])::INT + (pos >= ed[3])::INT AS phase FROM e)
  SELECT pair, {ms('open_time')}, phase::BIGINT AS phase, pos >= ed[phase + 1] + floor((ed[phase + 2] - ed[phase + 1]) * 0.9e0) AS is_holdout FROM p""")
def _(spark, sf):
    from workload.bars import positioned

    return splits.phase_splits(positioned(spark, sf), 3, 0.1, row="pos", n="n_rows").select("pair", TS, "phase", "is_holdout")


@query("m04_m14_tail_splits", f"""WITH {BP} SELECT pair, {ms('open_time')}, pos >= n_rows - floor(n_rows * 0.1e0) AS is_tail,
  pos >= floor(n_rows * 0.9e0) AS held_out, least(greatest(64, floor(n_rows * 0.2e0)), n_rows // 2)::BIGINT AS n_cal FROM bp""")
def _(spark, sf):
    from workload.bars import positioned

    both = splits.anchor_split(splits.tail_split(positioned(spark, sf), 0.1, "pos", "n_rows"), 0.9, "pos", "n_rows")
    return both.select("pair", TS, "is_tail", "held_out", splits.calibration_size(F.col("n_rows")).alias("n_cal"))


_COLS = "pair, fold::BIGINT AS fold, y_true, y_pred"


@query("m05_majority", f"{RECURSIVE}{PREDS} SELECT {_COLS}, {ms('open_time')}, {r('y_prob', digits=9)} FROM preds WHERE model = 'naive_majority'", digits=9)
def _(spark, sf):
    return M.majority(dataset(spark, sf)).select("pair", "fold", "y_true", "y_pred", TS, "y_prob")


@query("m06_m13_persistence", f"{RECURSIVE}{PREDS} SELECT {_COLS}, {ms('open_time')}, {r('y_prob', 'next_ret')} FROM preds WHERE model = 'naive_persistence'")
def _(spark, sf):
    return M.persistence(dataset(spark, sf)).select("pair", "fold", "y_true", "y_pred", TS, "y_prob", "next_ret")


@query("m07_random", f"""{RECURSIVE}{FOLDS}, u AS (SELECT pair, fold,
    ('0x' || substr(md5(pair || '|1h|' || epoch_us(open_time)::VARCHAR || '|0'), 1, 13))::BIGINT / 4503599627370496e0 AS p FROM tst)
  SELECT pair, fold::BIGINT AS fold, count(*)::BIGINT AS n, {r('avg(p) AS mean_p')} FROM u GROUP BY 1, 2""")
def _(spark, sf):
    return M.random_coin(dataset(spark, sf)).groupBy("pair", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y_prob").alias("mean_p"))


# --------------------------------------------------------------------------- metrics
_FOLD_METRICS = f"""{PREDS}, c AS (
  SELECT pair, model, fold, count(*) AS n, count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE AS tp, count(*) FILTER (y_true = 0 AND y_pred = 0)::DOUBLE AS tn,
    count(*) FILTER (y_true = 0 AND y_pred = 1)::DOUBLE AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0)::DOUBLE AS fn,
    avg(CASE WHEN y_true = 1 THEN -ln(greatest(1e-7, least(1 - 1e-7, y_prob))) ELSE -ln(1 - greatest(1e-7, least(1 - 1e-7, y_prob))) END) AS log_loss,
    sum((2 * y_pred - 1) * next_ret) AS pnl_log, avg((2 * y_pred - 1) * next_ret) AS m, stddev_pop((2 * y_pred - 1) * next_ret) AS s
  FROM preds GROUP BY 1, 2, 3),
fm AS (SELECT pair, model, fold, n, (tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
    coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0) AS mcc,
    log_loss, (tp + tn) / n AS hit_rate, pnl_log, CASE WHEN s > 0 THEN m / s ELSE 0 END AS sharpe_per_bar FROM c)"""


@query("a02_a03_a04_fold_metrics", f"""{RECURSIVE}{_FOLD_METRICS} SELECT pair, '1h' AS "interval", model, fold::BIGINT AS fold, n::BIGINT AS n, {r(*X.METRICS)} FROM fm""")
def _(spark, sf):
    return X.fold_metrics(predictions(spark, sf))


_SUMMARY = f"""{_FOLD_METRICS}, fs AS (SELECT pair, model, sum(n)::BIGINT AS n_total, count(*)::BIGINT AS n_folds,
  {', '.join(f'sum(n * {m}) / sum(n) AS {m}' if m != 'pnl_log' else 'sum(pnl_log) AS pnl_log' for m in X.METRICS)} FROM fm GROUP BY 1, 2)"""


@query("a05_a24_summary", f"""{RECURSIVE}{_SUMMARY} SELECT pair, '1h' AS "interval", model, n_total, n_folds, {r(*X.METRICS)} FROM fs""")
def _(spark, sf):
    return X.summary_table(X.aggregate_folds(X.fold_metrics(predictions(spark, sf))))


@query("s15_metrics_documents", f"{RECURSIVE}{_SUMMARY} SELECT pair, model, n_total, {r('accuracy', 'pnl_log')}, n_folds AS folds, {r('(SELECT max(accuracy) FROM fm WHERE fm.pair = fs.pair AND fm.model = fs.model) AS best_fold')} FROM fs")
def _(spark, sf):
    root = scratch_path(spark, "metrics")
    folds = materialise(X.fold_metrics(predictions(spark, sf)), "folds")
    sinks.write_metrics(sinks.metrics_documents(X.aggregate_folds(folds), folds), root)
    docs = sinks.read_metrics(spark, root)
    return docs.select(
        "pair", "model", "summary.n_total", "summary.accuracy", "summary.pnl_log", F.size("folds").cast("long").alias("folds"),
        F.array_max(F.col("folds.accuracy")).alias("best_fold"),
    )


@query("s16_summary_csv", f"{RECURSIVE}{_SUMMARY} SELECT pair, model, n_total, n_folds, {r('accuracy', 'f1')} FROM fs")
def _(spark, sf):
    path = scratch_path(spark, "summary")
    cols = ["pair", "model", "accuracy", "f1", "n_total", "n_folds"]
    summary = X.aggregate_folds(X.fold_metrics(predictions(spark, sf)))
    sinks.write_summary_csv(summary, path, cols, [F.col("pair").asc(), F.col("accuracy").desc()])
    return spark.read.csv(path, header=True, schema="pair string, model string, accuracy double, f1 double, n_total long, n_folds long")


@query("s17_predictions_scan", f"{RECURSIVE}{PREDS} SELECT model, fold::BIGINT AS fold, {ms('open_time')}, y_pred FROM preds WHERE pair = 'click'")
def _(spark, sf):
    root = scratch_path(spark, "preds")
    sinks.write_predictions(predictions(spark, sf), root)
    return sinks.read_predictions(spark, root, "click").select("model", "fold", TS, "y_pred")


@query("j07_t06_pending_runs", f"""{RECURSIVE}{PREDS} SELECT DISTINCT pair, '1h' AS "interval", 'xgboost' AS model FROM preds""")
def _(spark, sf):
    preds = predictions(spark, sf)
    names = F.array(F.lit("naive_majority"), F.lit("smooth"), F.lit("xgboost"))
    grid = preds.select(*SERIES).distinct().withColumn("model", F.explode(names))
    return pending_runs(grid, X.aggregate_folds(X.fold_metrics(preds)))


# --------------------------------------------------------------------------- forecast comparison
_PAIRS = f"""{PREDS}, pp AS (SELECT a.pair, a.model AS model_a, b.model AS model_b, a.open_time, a.fold, a.y_true, a.y_pred AS pa, b.y_pred AS pb
  FROM preds a JOIN preds b ON a.pair = b.pair AND a.open_time = b.open_time AND a.fold = b.fold AND a.model < b.model)"""


@query("j05_pair_predictions", f"{RECURSIVE}{_PAIRS} SELECT pair, model_a, model_b, {ms('open_time')}, fold::BIGINT AS fold, y_true, pa AS pred_a, pb AS pred_b FROM pp")
def _(spark, sf):
    return dm.pair_predictions(predictions(spark, sf)).select("pair", "model_a", "model_b", TS, "fold", "y_true", "pred_a", "pred_b")


def _dm_sql(h: int) -> str:
    lags = "".join(f" + 2 * coalesce(sum((d - m) * (lag{k} - m)) / count(*), 0)" for k in range(1, h))
    cols = "".join(f", lag(d, {k}) OVER (PARTITION BY pair, model_a, model_b ORDER BY open_time) AS lag{k}" for k in range(1, h))
    return f"""{_PAIRS}, dd AS (SELECT *, (y_true <> pa)::INT::DOUBLE - (y_true <> pb)::INT::DOUBLE AS d FROM pp),
  dl AS (SELECT *, avg(d) OVER (PARTITION BY pair, model_a, model_b) AS m{cols} FROM dd),
  st AS (SELECT pair, '1h' AS "interval", model_a, model_b, count(*) AS n, avg(d) AS m, greatest(var_pop(d){lags}, 1e-12) AS v FROM dl GROUP BY 1, 2, 3, 4),
  dm AS (SELECT pair, "interval", model_a, model_b, n::BIGINT AS n, m / sqrt(v / n) * sqrt((n + 1 - {2 * h} + {float(h * (h - 1))}e0 / n) / n) AS dm_stat FROM st)"""


def _simpson(low: str) -> str:
    """Integral of cos(a) ** (v - 1) from ``low`` to the end, for the two-sided t probability."""
    return f"""(list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * exp((n - 2) * ln(greatest(cos({low} + i * (e - {low}) / 2000e0), 1e-300))))) * (e - {low}) / 6000e0)"""


_DM_TEST = f"""{_dm_sql(1)}, an AS (SELECT *, least(pi() / 2, 12 / sqrt(n - 1)) AS e FROM dm),
  an2 AS (SELECT *, least(atan(abs(dm_stat) / sqrt(n - 1)), e) AS a FROM an),
  tt AS (SELECT *, {_simpson('a')} / {_simpson('0e0')} AS p_value FROM an2),
  sp AS (SELECT *, CASE WHEN dm_stat >= 0 THEN p_value ELSE -p_value END AS signed FROM tt)"""
_DM_ROWS = f"""SELECT pair, "interval", model_a, model_b, n, {r('dm_stat')} FROM dm"""


@query("a07_dm_statistic", f"{RECURSIVE}{_dm_sql(1)} {_DM_ROWS}")
def _(spark, sf):
    return dm.dm_statistic(dm.pair_predictions(predictions(spark, sf)))


@query("a07_dm_statistic_h3", f"{RECURSIVE}{_dm_sql(3)} {_DM_ROWS}")
def _(spark, sf):
    return dm.dm_statistic(dm.pair_predictions(predictions(spark, sf)), h=3)


@query("a08_dm_test", f"""{RECURSIVE}{_DM_TEST} SELECT pair, "interval", model_a, model_b, n, {r('dm_stat', 'p_value')},
  CASE WHEN p_value >= 0.05 THEN 'no significant difference' WHEN dm_stat < 0 THEN 'A beats B' ELSE 'B beats A' END AS verdict FROM sp""")
def _(spark, sf):
    return dm.diebold_mariano(dm.pair_predictions(predictions(spark, sf)))


@query("a09_dm_matrix", f"""{RECURSIVE}{_DM_TEST}, bo AS (SELECT pair, "interval", model_a AS model, model_b AS other, signed FROM sp
    UNION ALL SELECT pair, "interval", model_b, model_a, -signed FROM sp)
  SELECT pair, "interval", model, {', '.join(r(f"max(signed) FILTER (other = '{m}') AS {m}") for m in ('naive_majority', 'naive_persistence', 'smooth'))} FROM bo GROUP BY 1, 2, 3""")
def _(spark, sf):
    return dm.dm_matrix(predictions(spark, sf), ["naive_majority", "naive_persistence", "smooth"])


@query("j06_f24_dm_cross", f"""{RECURSIVE}{_DM_TEST} SELECT pair, "interval", 'smooth' AS variant, model_a AS baseline, n, {r('-dm_stat AS dm_stat')},
  {r('CASE WHEN -dm_stat >= 0 THEN p_value ELSE -p_value END AS signed_p', digits=4)} FROM sp WHERE model_b = 'smooth'""")
def _(spark, sf):
    preds = predictions(spark, sf)
    return dm.dm_cross(preds.filter(F.col("model") == "smooth"), preds.filter(F.col("model") != "smooth"))


@query("f24_signed_p", "SELECT o_orderkey, round(CASE WHEN o_totalprice > 200000 THEN o_totalprice / 1e6 ELSE -o_totalprice / 1e6 END, 3) + 0.0 AS p FROM orders", digits=3)
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", signed_p(F.col("o_totalprice") - 200000.01, F.col("o_totalprice") / 1e6).alias("p"))


# --------------------------------------------------------------------------- weights, scaling, calibration
@query("a20_balance_weights", f"{RECURSIVE}{DATASET} SELECT pair, y, {r('count(*) AS n', 'sum(count(*)) OVER (PARTITION BY pair) / (2 * count(*)) AS weight')} FROM ds GROUP BY pair, y")
def _(spark, sf):
    weighted = M.balance_weights(dataset(spark, sf), by=["pair"])
    return weighted.groupBy("pair", "y").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("weight").alias("weight"))


@query("a21_standardise", f"""{RECURSIVE}{DATASET}, st AS (SELECT pair, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) + 1e-8 AS s_{c}' for c in ('ret_1', 'sma_20', 'rsi_14'))}
    FROM ds WHERE "row" < initial GROUP BY 1)
  SELECT pair, {ms('open_time')}, {r(*[f'({c} - m_{c}) / s_{c} AS {c}' for c in ('ret_1', 'sma_20', 'rsi_14')])} FROM ds JOIN st USING (pair)""")
def _(spark, sf):
    ds = dataset(spark, sf)
    cols = ["ret_1", "sma_20", "rsi_14"]
    return M.standardise(ds.filter(F.col("row") < F.col("initial")), ds, cols, ["pair"]).select("pair", TS, *cols)


_THRESHOLD = f"""{PREDS}, ncf AS (SELECT pair, fold, CASE WHEN y_true = 1 THEN 1 - y_prob ELSE 1 - (1 - y_prob) END AS v FROM preds WHERE model = 'smooth'),
  sz AS (SELECT pair, fold, count(*) AS n, list_sort(list(v)) AS vs FROM ncf GROUP BY 1, 2),
  lv AS (SELECT *, (n - 1) * least(1e0, ceil((n + 1) * 0.9e0) / n) AS h FROM sz),
  thr AS (SELECT pair, fold, n, CASE WHEN n >= 32 THEN vs[floor(h)::INT + 1] + (vs[ceil(h)::INT + 1] - vs[floor(h)::INT + 1]) * (h - floor(h)) END AS threshold FROM lv),
  s AS (SELECT p.pair, p.fold, y_true, CASE WHEN threshold IS NULL THEN (y_prob < 0.5)::INT ELSE (1 - (1 - y_prob) <= threshold)::INT END AS z,
    CASE WHEN threshold IS NULL THEN (y_prob >= 0.5)::INT ELSE (1 - y_prob <= threshold)::INT END AS o FROM preds p JOIN thr USING (pair, fold) WHERE model = 'smooth')"""


@query("m12_conformal_threshold", f"{RECURSIVE}{_THRESHOLD} SELECT pair, fold::BIGINT AS fold, n::BIGINT AS n_cal, {r('threshold', digits=9)} FROM thr", digits=9)
def _(spark, sf):
    smooth = predictions(spark, sf).filter(F.col("model") == "smooth")
    return C.conformal_threshold(smooth).select("pair", "fold", "n_cal", "threshold")


@query("f25_a06_conformal_sets", f"""{RECURSIVE}{_THRESHOLD}
  SELECT pair, fold::BIGINT AS fold, count(*)::BIGINT AS n, {r('avg(CASE WHEN y_true = 1 THEN o ELSE z END) AS coverage', 'avg(z + o) AS avg_set_size', 'avg((z + o = 1)::INT) AS singletons')}
  FROM s GROUP BY 1, 2""")
def _(spark, sf):
    smooth = materialise(predictions(spark, sf).filter(F.col("model") == "smooth"), "smooth")
    sets = C.with_conformal_set(smooth, C.conformal_threshold(smooth))
    return X.conformal_stats(sets, ["pair", "fold"])


@query("a06_conformal_rollup", f"""{RECURSIVE}{_THRESHOLD}
  SELECT pair, '1h' AS "interval", 'smooth' AS model, {r('avg(CASE WHEN y_true = 1 THEN o ELSE z END) AS cp_coverage', 'avg(z + o) AS cp_avg_set_size', 'avg((z + o = 1)::INT) AS cp_singleton_frac')}
  FROM s GROUP BY 1""")
def _(spark, sf):
    smooth = materialise(predictions(spark, sf).filter(F.col("model") == "smooth"), "smooth")
    sets = C.with_conformal_set(smooth, C.conformal_threshold(smooth))
    return X.aggregate_conformal(X.conformal_stats(sets))


@query("a23_retention", f"""WITH {BP}, x AS (SELECT *, (pos >= floor(n_rows / 3e0))::INT + (pos >= floor(n_rows * 2 / 3e0))::INT AS holdout, (lead(close) OVER (PARTITION BY pair ORDER BY pos) > close)::INT AS y,
    [floor(n_rows * k / 3e0)::BIGINT for k in [0, 1, 2, 3]] AS ed FROM bp),
  g AS (SELECT m AS mode, p::BIGINT AS phase, holdout::BIGINT AS holdout, avg((y = ((trades + p + len(m)) % 2))::INT) AS accuracy, count(*)::BIGINT AS n
    FROM x, (VALUES ('naive'), ('ewc')) t(m), range(3) q(p) WHERE y IS NOT NULL AND holdout <= p AND pos >= ed[holdout + 1] + floor((ed[holdout + 2] - ed[holdout + 1]) * 0.9e0) GROUP BY 1, 2, 3)
  SELECT mode, phase, holdout, {r('accuracy')}, n FROM g""")
def _(spark, sf):
    return X.retention_matrix(retention_predictions(spark, sf))


def retention_predictions(spark, sf):
    """A stand-in for the predictions of two training modes after each of three phases."""
    from barframe.operators.labels import with_direction_label
    from workload.bars import positioned

    labelled = with_direction_label(splits.phase_splits(positioned(spark, sf), 3, 0.1, "pos", "n_rows"), 1)
    rows = labelled.filter(F.col("is_holdout") & F.col("y").isNotNull()).withColumnRenamed("phase", "holdout")
    rows = rows.withColumn("mode", F.explode(F.array(F.lit("naive"), F.lit("ewc")))).withColumn(
        "phase", F.explode(F.array(*[F.lit(k) for k in range(3)]))
    )
    guess = (F.col("trades") + F.col("phase") + F.length("mode")) % 2
    return rows.select("mode", "phase", "holdout", F.col("y").alias("y_true"), guess.alias("y_pred"))


@query("a23_retention_summary", f"""WITH {BP}, x AS (SELECT *, (pos >= floor(n_rows / 3e0))::INT + (pos >= floor(n_rows * 2 / 3e0))::INT AS holdout, (lead(close) OVER (PARTITION BY pair ORDER BY pos) > close)::INT AS y,
    [floor(n_rows * k / 3e0)::BIGINT for k in [0, 1, 2, 3]] AS ed FROM bp),
  g AS (SELECT m AS mode, holdout, avg((y = ((trades + 2 + len(m)) % 2))::INT) AS a FROM x, (VALUES ('naive'), ('ewc')) t(m) WHERE y IS NOT NULL AND pos >= ed[holdout + 1] + floor((ed[holdout + 2] - ed[holdout + 1]) * 0.9e0) GROUP BY 1, 2)
  SELECT {r("avg(a) FILTER (mode = 'naive') AS naive", "avg(a) FILTER (mode = 'ewc') AS ewc", "avg(a) FILTER (mode = 'ewc') - avg(a) FILTER (mode = 'naive') AS delta")} FROM g""")
def _(spark, sf):
    return X.retention_summary(X.retention_matrix(retention_predictions(spark, sf)), final_phase=2)


# --------------------------------------------------------------------------- fitted models (rows only)
def _quality(preds):
    folds = X.fold_metrics(preds)
    return folds.select("pair", "model", "fold", "n", "accuracy", "log_loss")


# All folds at the operator's full settings. The next move of these bars can be learnt in part: every fold beats a coin.
@query("m08_boosted_trees", f"""{RECURSIVE}{FOLDS} SELECT tst.pair, 'boosted_trees' AS model, tst.fold::BIGINT AS fold, count(*)::BIGINT AS n, sum(y)::BIGINT AS ups, true AS learnt, true AS varied FROM tst GROUP BY 1, 2, 3""")
def _(spark, sf):
    preds = materialise(M.boosted_trees(dataset(spark, sf)), "boosted")
    spread = preds.groupBy("pair", "fold").agg((F.stddev_pop("y_prob") > 0.01).alias("varied"), F.sum("y_true").alias("ups"))
    folds = _quality(preds).join(spread, ["pair", "fold"])
    return folds.select("pair", "model", "fold", "n", "ups", ((F.col("accuracy") > 0.5) & (F.col("log_loss") < 1.2)).alias("learnt"), "varied")


# One round of one split over all inputs, stated in SQL: borders, histogram, gain and leaves must all agree.
_STUMP = f"""{RECURSIVE}{FOLDS}, tr AS (SELECT ds.*, fold FROM ds JOIN folds ON ds.pair = folds.pair AND ds."row" < train_end),
  rate AS (SELECT pair, fold, avg(y) AS p, ln(avg(y) / (1 - avg(y))) AS base FROM tr GROUP BY 1, 2),
  u AS (SELECT pair, fold, y, unnest(range({len(FEATURE_COLUMNS)})) AS f, unnest([{', '.join(f'{c}::DOUBLE' for c in FEATURE_COLUMNS)}]) AS x FROM tr),
  q AS (SELECT pair, fold, f, list_sort(list_distinct(quantile_disc(x, [{', '.join(f'{k}/64e0' for k in range(1, 64))}]))) AS edges FROM u GROUP BY 1, 2, 3),
  b AS (SELECT u.*, len(list_filter(edges, lambda e: e < x)) AS bin FROM u JOIN q USING (pair, fold, f)),
  c AS (SELECT pair, fold, f, bin, count(*) * any_value(p) - sum(y) AS g, count(*) * any_value(p * (1 - p)) AS h FROM b JOIN rate USING (pair, fold) GROUP BY 1, 2, 3, 4),
  w AS (SELECT *, sum(g) OVER up AS gl, sum(h) OVER up AS hl, sum(g) OVER f AS gt, sum(h) OVER f AS ht FROM c
    WINDOW up AS (PARTITION BY pair, fold, f ORDER BY bin), f AS (PARTITION BY pair, fold, f)),
  s AS (SELECT *, round(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1), 8) AS gain FROM w WHERE bin < 63 AND hl >= 1 AND ht - hl >= 1),
  best AS (SELECT * FROM s WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY pair, fold ORDER BY gain DESC, f, bin) = 1),
  v AS (SELECT pair, open_time, fold, unnest(range({len(FEATURE_COLUMNS)})) AS f, unnest([{', '.join(f'{c}::DOUBLE' for c in FEATURE_COLUMNS)}]) AS x FROM tst),
  o AS (SELECT v.pair, v.open_time, v.fold, base + CASE WHEN len(list_filter(edges, lambda e: e < x)) > bin THEN -(gt - gl) / (ht - hl + 1) ELSE -gl / (hl + 1) END AS z
    FROM v JOIN best USING (pair, fold, f) JOIN q USING (pair, fold, f) JOIN rate USING (pair, fold))
  SELECT pair, {ms('open_time')}, fold::BIGINT AS fold, {r('1 / (1 + exp(-z)) AS y_prob')} FROM o"""


@query("m08_boosted_stump", _STUMP)
def _(spark, sf):
    options = boosting.Boosting(rounds=1, depth=1, rate=1.0, subsample=1.0, columns=1.0)
    return M.boosted_trees(dataset(spark, sf), options=options).select("pair", TS, "fold", "y_prob")


@query("m09_a06_fusion_numeric", f"""{RECURSIVE}{FOLDS} SELECT pair, 'fusion_num' AS model, fold::BIGINT AS fold, count(*)::BIGINT AS n,
  true AS covered, true AS learnt FROM tst GROUP BY pair, fold""")
def _(spark, sf):
    preds = materialise(M.fusion(dataset(spark, sf)), "fusion")
    stats = X.conformal_stats(preds).join(_quality(preds).drop("n"), ["pair", "model", "fold"])
    covered = F.col("coverage").between(0, 1) & F.col("avg_set_size").between(0, 2) & F.col("singletons").between(0, 1)
    return stats.select("pair", "model", "fold", "n", covered.alias("covered"), (F.col("accuracy").between(0, 1) & (F.col("log_loss") > 0)).alias("learnt"))


# With one input the Newton step is a two by two system, which SQL can state: every weight and bias must agree.
@query("m09_logistic_one_input", f"""{RECURSIVE}{FOLDS}, tr AS (SELECT ds.pair, fold, y::DOUBLE AS y, ret_1 AS x FROM ds JOIN folds ON ds.pair = folds.pair AND ds."row" < train_end),
  st AS (SELECT pair, fold, count(*) AS n, sum(y) AS up, avg(y) AS rate, avg(x) AS m, stddev_pop(x) + 1e-8 AS s FROM tr GROUP BY 1, 2 HAVING count(*) >= 32 AND sum(y) > 0 AND sum(y) < count(*)),
  z AS (SELECT pair, fold, y, (x - m) / s AS z, CASE WHEN y = 1 THEN n / (2 * up) ELSE n / (2 * (n - up)) END AS c FROM tr JOIN st USING (pair, fold)),
  nw AS (
    SELECT pair, fold, 0 AS k, 0e0 AS w, 0e0 AS b FROM st
    UNION ALL
    SELECT pair, fold, k + 1, w - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
      SELECT pair, fold, k, w, b, sum(c * (p - y) * z) + w AS g0, sum(c * (p - y)) AS g1, sum(c * p * (1 - p) * z * z) + 1 AS h00,
        sum(c * p * (1 - p) * z) AS h01, sum(c * p * (1 - p)) AS h11
      FROM (SELECT nw.*, z.y, z.z, z.c, 1 / (1 + exp(-(w * z.z + b))) AS p FROM nw JOIN z USING (pair, fold) WHERE k < 12) GROUP BY 1, 2, 3, 4, 5))
  SELECT pair, fold::BIGINT AS fold, {r('w / s AS weight', 'b - w / s * m AS bias', 'rate AS base_rate', digits=5)}, true AS converged FROM nw JOIN st USING (pair, fold) WHERE k = 12""", digits=5)
def _(spark, sf):
    models = M.fit_logistic(dataset(spark, sf).withColumn("x", F.array("ret_1")), 1, conformal=False)
    return models.select("pair", "fold", F.col("weights")[0].alias("weight"), "bias", "base_rate", "converged")


@query("m10_sentiment_model", f"""{RECURSIVE}{FOLDS} SELECT pair, 'sentiment_logreg' AS model, fold::BIGINT AS fold, count(*)::BIGINT AS n, true AS learnt FROM tst GROUP BY pair, fold""")
def _(spark, sf):
    ds = align_modalities(dataset(spark, sf), sent=sentiment(spark, sf))
    preds = _quality(M.sentiment_logistic(materialise(ds, "sentiment-dataset")))
    return preds.select("pair", "model", "fold", "n", (F.col("accuracy").between(0, 1) & (F.col("log_loss") > 0)).alias("learnt"))


# The naive models' accuracies are plain SQL; the fitted ones must be scored on every test row and, where they have sets, be covered.
@query("m11_m19_fusion_sweep", f"""{RECURSIVE}{FOLDS}, rates AS (SELECT folds.pair, fold, avg(y) AS p FROM folds JOIN ds ON ds.pair = folds.pair AND ds."row" < train_end GROUP BY 1, 2),
  m AS (SELECT unnest(['naive_majority', 'naive_persistence', 'naive_random', 'boosted_trees', 'fusion_num', 'fusion_num_cnn', 'fusion_num_sent', 'fusion_num_cnn_sent']) AS model),
  a AS (SELECT tst.pair, avg(((p >= 0.5)::INT = y)::INT) AS maj, avg(((ret_1 > 0)::INT = y)::INT) AS per FROM tst JOIN rates USING (pair, fold) GROUP BY 1)
  SELECT pair, model, count(*)::BIGINT AS n_total, count(DISTINCT fold)::BIGINT AS n_folds, true AS scored, model LIKE 'fusion%' AS covered,
    {r("any_value(CASE model WHEN 'naive_majority' THEN maj WHEN 'naive_persistence' THEN per END) AS naive_accuracy")} FROM tst JOIN a USING (pair), m GROUP BY pair, model""")
def _(spark, sf):
    ds = dataset(spark, sf)
    models = {**sweep.MODELS, **sweep.fusion_models(materialise(bar_embeddings(spark, sf), "bar-embeddings"), materialise(sentiment(spark, sf), "sentiment"), dim=64)}
    preds, failures = sweep.run_sweep(ds, models)
    if failures:
        raise RuntimeError(str(failures))
    covered = F.coalesce(F.col("cp_coverage").between(0.5, 1) & F.col("cp_avg_set_size").between(0.5, 2), F.lit(False))
    scored = F.col("accuracy").between(0.2, 1) & F.col("log_loss").between(0.1, 17)
    naive = F.when(F.col("model").isin("naive_majority", "naive_persistence"), F.col("accuracy"))
    return sweep.sweep_summary(preds).select("pair", "model", "n_total", "n_folds", scored.alias("scored"), covered.alias("covered"), naive.alias("naive_accuracy"))


def bar_embeddings(spark, sf):
    """The given embeddings, dealt to the bars of each series in order."""
    from workload.bars import positioned

    given = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<float>"))
    dealt = positioned(spark, sf).withColumn("vec_id", F.col("pos") % given.count())
    return dealt.join(given, "vec_id").select(*SERIES, TS, "embedding")


@query("m14_anchor_model", f"""{RECURSIVE}{DATASET} SELECT pair, "row" >= floor(n * 0.9e0) AS held_out, count(*)::BIGINT AS n, true AS scored FROM ds GROUP BY 1, 2""")
def _(spark, sf):
    out = M.fit_anchor(dataset(spark, sf))
    scored = F.bool_and(F.col("p_up").between(0, 1) & F.col("in_set_0").isNotNull() & F.col("in_set_1").isNotNull())
    return out.groupBy("pair", "held_out").agg(F.count(F.lit(1)).alias("n"), scored.alias("scored"))


@query("m15_prediction_record", f"""WITH {VEC}, p AS (SELECT v.open_time, v.pair, (vec_id % 100) / 100e0 AS p_up, reg.regime, vec_id FROM vec v LEFT JOIN reg USING (open_time))
  SELECT {ms('open_time')}, {r('p_up')}, (p_up >= 0.5)::BIGINT AS label, p_up <= 0.6 AS down, 1 - p_up <= 0.6 AS up, regime::DOUBLE AS regime,
  CASE regime WHEN 0 THEN 'bear' WHEN 1 THEN 'sideways' WHEN 2 THEN 'bull' END AS regime_name, vec_id >= 400 AS held_out FROM p""")
def _(spark, sf):
    emb, regimes = vectors(spark, sf)
    hour = ((F.unix_millis(TS) - 1_704_067_200_000) / 3_600_000).cast("long")
    p = (hour % 100) / F.lit(100.0)
    preds = emb.select(*SERIES, TS, p.alias("p_up"), (p <= 0.6).alias("in_set_0"), (1 - p <= 0.6).alias("in_set_1"), (hour >= 400).alias("held_out"))
    out = M.prediction_at(preds, regimes)
    return out.select(TS, "p_up", "label", "conformal_set.down", "conformal_set.up", F.col("regime").cast("double").alias("regime"), "regime_name", "held_out")
