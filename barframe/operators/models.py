"""Baseline and fusion classifiers over walk-forward folds.

Datasets carry ``pair, interval, open_time, row, n, y, next_ret`` and the feature columns
(``labels.build_dataset``) plus ``initial``, ``test`` and ``n_folds`` (``splits.auto_folds``); models take all
folds unless ``max_folds`` asks for fewer. Models return
predictions: ``pair, interval, model, fold, open_time, y_true, y_pred, y_prob, next_ret``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.operators import boosting
from barframe.operators.conformal import conformal_threshold, with_conformal_set
from barframe.operators.features import FEATURE_COLUMNS
from barframe.operators.splits import calibration_size, walk_forward
from barframe.operators.tables import key_hash, spread_join
from barframe.schema import SENTIMENT_FEATURES, SERIES, TS, regime_name
from barframe.session import materialise, settings

GAP = 1
Model = Callable[[DataFrame], DataFrame]


def folds_of(max_folds: int | None) -> Column:
    """Folds per series: those of the dataset, or fewer where asked for."""
    own = F.col("n_folds")
    return own if max_folds is None else F.least(own, F.lit(max_folds).cast("long"))


def test_rows(ds: DataFrame, max_folds: int | None = None) -> DataFrame:
    """Test rows of every fold."""
    return walk_forward(ds, F.col("initial"), F.col("test"), gap=GAP, max_folds=folds_of(max_folds))


def as_predictions(df: DataFrame, model: str, prob: Column, *extra: str) -> DataFrame:
    """Prediction columns from test rows; the class is 1 from a probability of 0.5 up."""
    return df.select(
        *SERIES, F.lit(model).alias("model"), "fold", TS, F.col("y").alias("y_true"),
        (prob >= 0.5).cast("long").alias("y_pred"), prob.alias("y_prob"), "next_ret", *extra,
    )


# --------------------------------------------------------------------------- naive models
def base_rates(ds: DataFrame, max_folds: int | None = None) -> DataFrame:
    """Mean training label of every (series, fold).

    Rows are summed once per segment (initial part, then one segment per step) with map-side combine;
    the expanding sums then run over the few segments.
    """
    beyond = F.floor((F.col("row") - F.col("initial")) / F.col("test")) + 1
    segment = F.when(F.col("row") < F.col("initial"), F.lit(0)).otherwise(beyond).cast("long")
    sums = ds.withColumn("fold", segment).filter(F.col("fold") < folds_of(max_folds)).groupBy(*SERIES, "fold").agg(
        F.sum("y").alias("_s"), F.count(F.lit(1)).alias("_c")
    )
    w = Window.partitionBy(*SERIES).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select(*SERIES, "fold", (F.sum("_s").over(w) / F.sum("_c").over(w)).alias("base_rate"))


def majority(ds: DataFrame, max_folds: int | None = None) -> DataFrame:
    """Predict the training share of up moves."""
    tested = spread_join(test_rows(ds, max_folds), base_rates(ds, max_folds), [*SERIES, "fold"])
    return as_predictions(tested, "naive_majority", F.col("base_rate"))


def persistence(ds: DataFrame, max_folds: int | None = None) -> DataFrame:
    """Predict that the last move repeats."""
    return as_predictions(test_rows(ds, max_folds), "naive_persistence", (F.col("ret_1") > 0).cast("double"))


def random_coin(ds: DataFrame, seed: int = 0, max_folds: int | None = None) -> DataFrame:
    """Uniform probabilities from a hash of the bar's key, repeatable whatever the partitioning."""
    bits = F.conv(F.substring(key_hash(ds, [*SERIES, TS], seed), 1, 13), 16, 10).cast("long")
    return as_predictions(test_rows(ds, max_folds), "naive_random", bits / F.lit(float(1 << 52)))


# --------------------------------------------------------------------------- weights and scaling
def balance_weights(df: DataFrame, label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Class weight ``n / (2 n_class)`` on every row."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c").over(Window.partitionBy(*by, F.lit(0)))  # over the two counted classes
    weights = counts.select(*by, label, (total / (2 * F.col("_c"))).alias("weight"))
    return spread_join(df, weights, [*by, label])


def scaling_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation (+ 1e-8) of each column per group, as two arrays."""
    agg = df.groupBy(*by).agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    return agg.select(
        *by, F.array(*[f"m_{c}" for c in cols]).alias("mean"),
        F.array(*[F.col(f"s_{c}") + 1e-8 for c in cols]).alias("std"),
    )


def standardise(train: DataFrame, apply_to: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Scale ``apply_to`` with the training rows' statistics."""
    stats = scaling_stats(train, cols, by)
    key = list(by) or ["_all"]
    if not by:
        stats, apply_to = stats.withColumn("_all", F.lit(0)), apply_to.withColumn("_all", F.lit(0))
    joined = spread_join(apply_to, stats, key)
    scaled = {c: (F.col(c) - F.col("mean")[i]) / F.col("std")[i] for i, c in enumerate(cols)}
    return joined.withColumns(scaled).drop("mean", "std", "_all")


# --------------------------------------------------------------------------- logistic regression, all groups at once
MODEL_SQL = "pair string, interval string, fold long, weights array<double>, bias double, base_rate double, fit_end long, converged boolean"
_BLOCK = 4096  # rows of a stored block of inputs
_BLOCK_SQL = "pair string, interval string, rows binary, y binary, x binary"
_FIT_SQL = (
    "pair string, interval string, fold long, train_end long, fit_end long, base_rate double, n_fit long, n_up long, "
    "mean array<double>, std array<double>, coef array<double>, open boolean, converged boolean"
)
_SUM_SQL = "pair string, interval string, fold long, g array<double>"
_FIT_KEY = [*SERIES, "fold"]


def _pack(table: pa.Table) -> pa.Table:
    """A block of rows as one row of matrices."""
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    blobs = [np.ascontiguousarray(v).tobytes() for v in (table.column("row").to_numpy().astype(np.int64), table.column("y").to_numpy().astype(np.float64), x)]
    columns = [[table.column(c)[0].as_py()] for c in SERIES] + [[b] for b in blobs]
    kinds = [pa.string(), pa.string(), *[pa.binary()] * 3]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], [*SERIES, "rows", "y", "x"])


def _counts(rows: np.ndarray, y: np.ndarray, x: np.ndarray, fit: dict) -> np.ndarray:
    train, used = rows < fit["train_end"], rows < fit["fit_end"]
    return np.concatenate([[train.sum(), y[train].sum(), used.sum(), y[used].sum()], x[used].sum(axis=0)])


def _squares(rows: np.ndarray, y: np.ndarray, x: np.ndarray, fit: dict) -> np.ndarray:
    return ((x[rows < fit["fit_end"]] - fit["mean"]) ** 2).sum(axis=0)


def _newton(rows: np.ndarray, y: np.ndarray, x: np.ndarray, fit: dict) -> np.ndarray:
    """Gradient and Hessian, flat."""
    used, coef = rows < fit["fit_end"], np.array(fit["coef"])
    xs, yu = (x[used] - fit["mean"]) / fit["std"], y[used]
    p = 0.5 * (1.0 + np.tanh(0.5 * (xs @ coef[:-1] + coef[-1])))
    n, up = fit["n_fit"], fit["n_up"]
    weight = np.where(yu == 1, n / (2.0 * up), n / (2.0 * (n - up)))
    design = np.hstack([xs, np.ones((len(xs), 1))])
    hessian = (design * (weight * p * (1 - p))[:, None]).T @ design
    return np.concatenate([design.T @ (weight * (p - yu)), hessian.ravel()])


def _partials(measure):
    """Per task: sums of ``measure`` over the rows of its blocks, for every fit of their series."""

    def emit(sums: dict) -> pa.RecordBatch:
        keys = list(sums)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([sums[k] for k in keys], pa.list_(pa.float64()))], names=[*_FIT_KEY, "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                rows, y = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["y"])
                x = np.frombuffer(r["x"]).reshape(len(rows), -1)
                for fit in r["fits"]:
                    if rows.min() < fit["train_end"]:
                        key, flat = (r["pair"], r["interval"], fit["fold"]), measure(rows, y, x, fit)
                        sums[key] = sums[key] + flat if key in sums else flat
            if len(sums) > 256:
                yield emit(sums)
                sums = {}
        if sums:
            yield emit(sums)

    return run


def _summed(blocks: DataFrame, fits: DataFrame, measure) -> DataFrame:
    """``g``: the sums of ``measure`` per fit, one pass over the blocks; a series' fits meet its blocks by a join."""
    inside = [c for c in fits.columns if c not in SERIES]
    held = fits.groupBy(*SERIES).agg(F.collect_list(F.struct(*inside)).alias("fits"))
    parts = spread_join(blocks, held, SERIES).mapInArrow(_partials(measure), _SUM_SQL)
    total = parts.groupBy(*_FIT_KEY).agg(Summarizer.metrics("sum").summary(array_to_vector(F.col("g"))).alias("s"))
    return total.select(*_FIT_KEY, vector_to_array("s.sum").alias("g"))


def _solve(dim: int, c: float, tol: float):
    """One step of every fit, in the tasks."""
    penalty = np.append(np.full(dim, 1.0 / c), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coefs, done = [], []
            for coef, g in zip(batch.column("coef").to_pylist(), batch.column("g").to_pylist()):
                flat, coef = np.array(g), np.array(coef)
                gradient = flat[: dim + 1] + penalty * coef
                hessian = flat[dim + 1:].reshape(dim + 1, dim + 1) + np.diag(penalty)
                step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
                size = float(np.max(np.abs(step)))
                coefs.append((coef - (step if size <= 5.0 else step * (5.0 / size))).tolist())
                done.append(size < tol)
            kept = [batch.column(f) for f in ("pair", "interval", "fold", "train_end", "fit_end", "base_rate", "n_fit", "n_up", "mean", "std")]
            done = pa.array(done, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(coefs, pa.list_(pa.float64())), pa.array([not d.as_py() for d in done], pa.bool_()), done],
                names=[*(f.split()[0] for f in _FIT_SQL.split(", "))],
            )

    return run


def fit_logistic(
    ds: DataFrame, dim: int, conformal: bool = True, c: float = 1.0, calib_frac: float = 0.2,
    max_folds: int | None = None, max_iter: int = 30, tol: float = 1e-9, min_rows: int = 32,
) -> DataFrame:
    """Fit an L2 logistic regression with balanced classes for every (series, fold) at the same time: a model table.

    ``ds`` holds ``pair, interval, row, n, initial, test, n_folds, y`` and the inputs as ``x array<double>``; they are
    stored in blocks once. Each Newton step is one pass: the fits, a table, meet the blocks of their series, tasks sum gradients and
    Hessians, Spark adds them up per fit, tasks solve the small systems and the result is the next table. The driver
    only learns whether a fit is open. So a sweep over all series and folds reads the data about ten times in total,
    not once per model and iteration. Inputs are scaled by the fitting rows' mean and population deviation; the
    intercept is not penalised. ``converged`` is false where ``max_iter`` ended a fit; fits with fewer than ``min_rows`` rows or
    one class have no weights and predict their base rate.
    """
    spark = ds.sparkSession
    blocks = ds.select(*SERIES, "row", "y", "x", F.floor(F.col("row") / _BLOCK).alias("blk"))
    blocks = materialise(blocks.groupBy(*SERIES, "blk").applyInArrow(_pack, _BLOCK_SQL), "blocks")
    grid = ds.groupBy(*SERIES).agg(*[F.max(k).alias(k) for k in ("n", "initial", "test", "n_folds")])
    grid = grid.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), folds_of(max_folds) - 1)))
    train_end = (F.col("initial") + F.col("fold") * F.col("test")).cast("long")
    grid = grid.withColumn("train_end", train_end).filter(F.col("train_end") + GAP + F.col("test") <= F.col("n"))
    n_cal = calibration_size(F.col("train_end"), calib_frac) if conformal else F.lit(0)
    fits = materialise(grid.select(*_FIT_KEY, "train_end", (F.col("train_end") - n_cal).cast("long").alias("fit_end")), "fits")
    with settings(spark, execution__arrow__maxRecordsPerBatch="16"):  # a row is a block
        part = [F.slice("g", 5, dim) if k == 4 else F.col("g")[k] for k in range(5)]
        n = part[2].cast("long")
        moments = fits.join(_summed(blocks, fits, _counts), _FIT_KEY).select(
            *fits.columns, (part[1] / part[0]).alias("base_rate"), n.alias("n_fit"), part[3].cast("long").alias("n_up"),
            F.transform(part[4], lambda v: v / part[2]).alias("mean"),
        )
        moments = materialise(moments, "moments")
        usable = (F.col("n_fit") >= min_rows) & (F.col("n_up") > 0) & (F.col("n_up") < F.col("n_fit"))
        std = F.transform("g", lambda v: F.sqrt(v / F.col("n_fit")) + 1e-8)
        spread = _summed(blocks, moments.filter(usable).select(*_FIT_KEY, "train_end", "fit_end", "mean"), _squares)
        fits = moments.join(spread, _FIT_KEY, "left").select(
            *moments.columns, std.alias("std"), F.when(usable, F.array_repeat(F.lit(0.0), dim + 1)).alias("coef"), usable.alias("open"), F.lit(False).alias("converged"),
        )
        fits = materialise(fits, "fits")
        for _ in range(max_iter):
            if not fits.filter("open").limit(1).count():
                break
            live = fits.filter("open")
            sums = _summed(blocks, live.select(*_FIT_KEY, "train_end", "fit_end", "n_fit", "n_up", "mean", "std", "coef"), _newton)
            solved = live.join(sums, _FIT_KEY).select(*live.columns, "g").mapInArrow(_solve(dim, c, tol), _FIT_SQL)
            fits = materialise(fits.filter("NOT open").unionByName(solved), "fits")
    scaled = F.zip_with(F.slice("coef", 1, dim), "std", lambda a, s: a / s)
    centre = F.aggregate(F.zip_with("weights", "mean", lambda a, m: a * m), F.lit(0.0), lambda t, v: t + v)
    models = fits.withColumn("weights", scaled).withColumn("bias", F.element_at("coef", -1) - centre)
    return models.select(*_FIT_KEY, "weights", "bias", "base_rate", "fit_end", "converged")


def score_with(models: DataFrame, rows: DataFrame, by: Sequence[str] = (*SERIES, "fold")) -> DataFrame:
    """Add ``prob`` (up probability) and ``flat`` (no weights) to rows with ``x``, from a model table, in batch or stream.

    The few model rows are joined on salted keys; the score itself is a Column expression. Rows without a model get 0.5.
    """
    kept = [c for c in rows.columns if c != "x"]
    joined = spread_join(rows, models.select(*by, "weights", "bias", "base_rate"), by, "left")
    z = F.aggregate(F.zip_with("x", "weights", lambda a, w: a * w), F.col("bias"), lambda t, v: t + v)
    prob = F.when(F.col("weights").isNull(), F.coalesce("base_rate", F.lit(0.5))).otherwise(1 / (1 + F.exp(-z)))
    return joined.select(*kept, prob.alias("prob"), F.col("weights").isNull().alias("flat"))


# Ablation variants and the inputs they use besides the numeric features.
VARIANTS = {
    "fusion_num": (), "fusion_num_cnn": ("cnn",), "fusion_num_sent": ("sent",), "fusion_num_cnn_sent": ("cnn", "sent"),
}


def fusion_inputs(ds: DataFrame, variant: str, dim: int = 0) -> tuple[DataFrame, int]:
    """Assemble the input array ``x`` of a variant (aligned ``embedding`` / sentiment columns expected)."""
    x, size = input_array(variant, dim)
    keep = [*SERIES, TS, "row", "n", "initial", "test", "n_folds", "y", "next_ret"]
    return ds.select(*keep, x.alias("x")), size


def input_array(variant: str = "fusion_num", dim: int = 0) -> tuple[Column, int]:
    """(input array of a variant from aligned feature columns, its length)."""
    uses = VARIANTS[variant]
    parts = [F.array(*[F.col(c).cast("double") for c in FEATURE_COLUMNS])]
    size = len(FEATURE_COLUMNS)
    if "cnn" in uses:
        parts.append(F.col("embedding").cast("array<double>"))
        size += dim
    if "sent" in uses:
        parts.append(F.array(*[F.col(c).cast("double") for c in SENTIMENT_FEATURES]))
        size += len(SENTIMENT_FEATURES)
    return F.concat(*parts), size


def fusion(
    ds: DataFrame, variant: str = "fusion_num", dim: int = 0, alpha: float = 0.1, calib_frac: float = 0.2,
    max_folds: int | None = None,
) -> DataFrame:
    """Late-fusion logistic model with split-conformal sets: predictions plus ``in_set_0/1``."""
    inputs, size = fusion_inputs(ds, variant, dim)
    inputs = materialise(inputs, "fusion-inputs")  # read once per Newton step
    models = fit_logistic(inputs, size, True, calib_frac=calib_frac, max_folds=max_folds)
    tested = test_rows(inputs, max_folds).withColumn("role", F.lit("test"))
    calib = inputs.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), folds_of(max_folds) - 1)))
    train_end = (F.col("initial") + F.col("fold") * F.col("test")).cast("long")
    calib = calib.withColumn("train_end", train_end).withColumn("role", F.lit("calibration"))
    lower = F.col("train_end") - calibration_size(F.col("train_end"), calib_frac)
    calib = calib.filter((F.col("row") >= lower) & (F.col("row") < F.col("train_end")))
    scored = score_with(models, tested.unionByName(calib))
    key = [*SERIES, "fold"]
    held = scored.filter((F.col("role") == "calibration") & ~F.col("flat"))
    thresholds = conformal_threshold(held.select(*key, F.col("y").alias("y_true"), F.col("prob").alias("y_prob")), alpha, key)
    preds = as_predictions(scored.filter(F.col("role") == "test"), variant, F.col("prob"))
    return with_conformal_set(preds, thresholds, key)


def sentiment_logistic(ds: DataFrame, max_folds: int | None = None) -> DataFrame:
    """Logistic model on the sentiment columns, fitted and applied on bars with articles only.

    A series with fewer than 32 such training rows predicts its base rate; other bars without
    articles predict 0.5.
    """
    keep = [*SERIES, TS, "row", "n", "initial", "test", "n_folds", "y", "next_ret", "sent_count"]
    x = F.array(*[F.col(c).cast("double") for c in SENTIMENT_FEATURES])
    inputs = materialise(ds.select(*keep, x.alias("x")), "sentiment-inputs")
    size = len(SENTIMENT_FEATURES)
    models = fit_logistic(inputs.filter(F.col("sent_count") > 0), size, False, max_folds=max_folds)
    scored = score_with(models, test_rows(inputs, max_folds))
    rates = base_rates(ds, max_folds)
    joined = spread_join(scored, rates, [*SERIES, "fold"], "left")
    prob = F.when(F.col("flat"), F.col("base_rate")).when(F.col("sent_count") > 0, F.col("prob")).otherwise(0.5)
    return as_predictions(joined, "sentiment_logreg", prob)


# --------------------------------------------------------------------------- boosted trees
def boosted_trees(
    ds: DataFrame, cols: Sequence[str] = FEATURE_COLUMNS, max_folds: int | None = None, options: boosting.Boosting = boosting.Boosting(),
    in_task: int = 2_000_000,
) -> DataFrame:
    """Gradient-boosted trees of every series and fold at once (see ``boosting``), predicting each fold's test rows."""
    x = F.array(*[F.col(c).cast("double") for c in cols]).alias("x")
    inputs = materialise(ds.select(*SERIES, TS, "row", "n", "initial", "test", "n_folds", "y", "next_ret", x), "boosting-inputs")
    folds = inputs.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), folds_of(max_folds) - 1)))
    train_end = F.col("initial") + F.col("fold") * F.col("test")
    train = folds.filter((train_end + GAP + F.col("test") <= F.col("n")) & (F.col("row") < train_end) & F.col("y").isNotNull())
    models, borders = boosting.fit(train.select(*boosting.KEY, "row", "y", "x"), len(cols), options, in_task)
    tested = test_rows(inputs, max_folds).select(*SERIES, TS, "fold", "row", "y", "next_ret", "x")
    scored = boosting.score(tested, models, borders, (*boosting.KEY, TS, "y", "next_ret"), options)
    return as_predictions(scored, "boosted_trees", F.col("prob"))


def _anchored(ds: DataFrame, variant: str, dim: int, frac: float) -> tuple[DataFrame, int]:
    """Inputs with one fold: all rows before the cut at ``frac`` of each series."""
    cut = F.floor(F.col("n") * F.lit(float(frac))).cast("long")
    anchored = ds.withColumn("initial", cut).withColumn("test", F.col("n") - F.col("initial") - GAP)
    inputs, size = fusion_inputs(anchored.withColumn("n_folds", F.lit(1).cast("long")), variant, dim)
    return materialise(inputs, "anchor-inputs"), size


def anchor_model(ds: DataFrame, variant: str = "fusion_num", dim: int = 0, frac: float = 0.9, alpha: float = 0.1) -> DataFrame:
    """The fusion model fitted on the first ``frac`` of each series, with its conformal ``threshold``: a row per series.

    Store it (any table format) and apply it to later bars with ``predict_bars``, in batch or stream.
    """
    inputs, size = _anchored(ds, variant, dim, frac)
    return _with_threshold(inputs, fit_logistic(inputs, size, True, max_folds=1), alpha)


def _with_threshold(inputs: DataFrame, models: DataFrame, alpha: float) -> DataFrame:
    models = models.drop("fold")
    lower = F.col("initial") - calibration_size(F.col("initial"))
    calib = score_with(models, inputs.filter((F.col("row") < F.col("initial")) & (F.col("row") >= lower)), SERIES)
    held = calib.filter(~F.col("flat")).select(*SERIES, F.col("y").alias("y_true"), F.col("prob").alias("y_prob"))
    return models.join(conformal_threshold(held, alpha, SERIES).select(*SERIES, "threshold"), list(SERIES), "left")


def predict_bars(models: DataFrame, rows: DataFrame) -> DataFrame:
    """``p_up`` and the conformal set ``in_set_0/1`` of any bars with inputs ``x`` (see ``input_array``), from ``anchor_model`` rows."""
    scored = score_with(models, rows, SERIES).withColumnRenamed("prob", "y_prob").drop("flat")
    return with_conformal_set(scored, models, SERIES).withColumnRenamed("y_prob", "p_up").drop("threshold")


def fit_anchor(ds: DataFrame, variant: str = "fusion_num", dim: int = 0, frac: float = 0.9, alpha: float = 0.1) -> DataFrame:
    """Fit the anchor model and score every bar of the dataset: ``p_up``, the conformal set and ``held_out`` after the cut."""
    inputs, size = _anchored(ds, variant, dim, frac)
    models = materialise(_with_threshold(inputs, fit_logistic(inputs, size, True, max_folds=1), alpha), "anchor-model")
    held_out = (F.col("row") >= F.col("initial")).alias("held_out")
    out = predict_bars(models, inputs.select(*SERIES, TS, F.col("y").alias("y_true"), held_out, "x"))
    return out.select(*SERIES, TS, "y_true", "p_up", "held_out", "in_set_0", "in_set_1")


# --------------------------------------------------------------------------- spark.ml
def logistic_estimator(n_fit: int, c: float = 1.0) -> LogisticRegression:
    """``spark.ml`` logistic regression minimising the same objective as ``fit_logistic`` for ``n_fit`` rows.

    Expects scaled inputs in ``features`` and balanced weights in ``weight``.
    """
    return LogisticRegression(
        labelCol="y", weightCol="weight", maxIter=500, regParam=1.0 / (c * max(1, n_fit)), elasticNetParam=0.0,
        standardization=False, tol=1e-10,
    )


def prediction_at(preds: DataFrame, regimes: DataFrame, ts=None) -> DataFrame:
    """Prediction record of one bar (or of every bar when ``ts`` is omitted).

    ``preds`` needs ``p_up, in_set_0, in_set_1, held_out``; the regime is null where unlabelled.
    """
    if ts is not None:
        preds = preds.filter(F.col(TS) == F.lit(ts))
    key = [*SERIES, TS]
    joined = preds.join(regimes.select(*key, "regime"), key, "left")
    return joined.select(
        *key, "p_up", (F.col("p_up") >= 0.5).cast("int").alias("label"),
        F.struct(F.col("in_set_0").cast("boolean").alias("down"), F.col("in_set_1").cast("boolean").alias("up")).alias("conformal_set"),
        "regime", regime_name(F.col("regime")).alias("regime_name"), "held_out",
    )
