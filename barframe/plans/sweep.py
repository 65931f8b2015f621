"""End-to-end plans: dataset, model sweep, news features, refit."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.operators import models as M
from barframe.operators.checks import missing_inputs
from barframe.operators.features import build_features
from barframe.operators.labels import build_dataset
from barframe.operators.metrics import aggregate_conformal, aggregate_folds, conformal_stats, fold_metrics
from barframe.operators.news import align_modalities
from barframe.operators.positions import bar_outcomes, equity_curve
from barframe.operators.regimes import label_regimes
from barframe.operators.retrieval import build_vectors
from barframe.operators.series import BLOCK_ROWS
from barframe.operators.splits import auto_folds
from barframe.schema import SERIES, TS
from barframe.session import materialise
from barframe.sources.sinks import metrics_documents, write_metrics, write_predictions

log = logging.getLogger("barframe")

MODELS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "naive_majority": M.majority,
    "naive_persistence": M.persistence,
    "naive_random": M.random_coin,
    "boosted_trees": M.boosted_trees,
}


def model_dataset(
    bars: DataFrame, horizon: int = 1, n_folds: int = 6, train_frac: float = 0.5, block: int = BLOCK_ROWS
) -> DataFrame:
    """Bars to a stored, labelled, fold-ready dataset.

    Features and labels are each written once to the shared folder: their rows are read several times
    (positions, folds, every model), and a stored stage survives lost executors.
    """
    features = materialise(build_features(bars, block=block), "features")
    dataset = auto_folds(build_dataset(features, horizon, block=block), n_folds, train_frac)
    return materialise(dataset, "dataset")


def fusion_models(
    emb: DataFrame | None = None, sent: DataFrame | None = None, dim: int = 0, max_folds: int | None = None
) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The fusion variants whose inputs are at hand, as sweep models."""
    have = {"cnn": emb is not None, "sent": sent is not None}
    wanted = [v for v, uses in M.VARIANTS.items() if all(have[u] for u in uses)]

    def build(variant: str) -> Callable[[DataFrame], DataFrame]:
        uses = M.VARIANTS[variant]
        return lambda ds: M.fusion(
            align_modalities(ds, emb if "cnn" in uses else None, sent if "sent" in uses else None, dim or None),
            variant, dim, max_folds=max_folds,
        )

    return {v: build(v) for v in wanted}


def run_sweep(
    dataset: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]] | None = None, root: str | None = None,
    required: dict[str, DataFrame] | None = None, seconds: dict[str, float] | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """Fit and predict every model over every series and fold; returns (predictions, failures).

    A model that fails is reported and the others continue. ``required`` tables are checked for every
    series first. With ``root``, predictions and metrics are stored per pair and model. All series and folds of a model are fitted
    together, so its ``elapsed_seconds`` are those of all of them; they go into the stored metrics and into ``seconds``.
    """
    models = MODELS if models is None else models
    seconds = {} if seconds is None else seconds
    if required:
        missing = missing_inputs(dataset.select(*SERIES).distinct(), required).collect()  # series x tables
        if missing:
            raise ValueError(f"missing inputs: {missing}")
    preds, failures = None, {}
    for name, fit in models.items():
        started = time.monotonic()
        try:
            part = materialise(fit(dataset), f"predictions-{name}")
            seconds[name] = round(time.monotonic() - started, 3)
        except Exception as error:  # noqa: BLE001 - one failing model must not end the sweep
            log.exception("model %s failed", name)
            failures[name] = str(error)
            continue
        preds = part if preds is None else preds.unionByName(part, allowMissingColumns=True)
    if preds is None:
        raise RuntimeError(f"every model failed: {failures}")
    if root:
        write_predictions(preds, root)
        folds = fold_metrics(preds)
        conformal = None
        if "in_set_0" in preds.columns:
            conformal = conformal_stats(preds.filter(F.col("in_set_0").isNotNull())).drop("n")
        write_metrics(metrics_documents(_timed(aggregate_folds(folds), seconds), folds, conformal), root)
    return preds, failures


def _timed(summary: DataFrame, seconds: dict[str, float]) -> DataFrame:
    """Adds ``elapsed_seconds`` of each row's model, null where they aren't known."""
    known = F.create_map(*[F.lit(v) for item in seconds.items() for v in item]) if seconds else None
    return summary.withColumn("elapsed_seconds", F.lit(None).cast("double") if known is None else F.try_element_at(known, F.col("model")))


def sweep_summary(preds: DataFrame, seconds: dict[str, float] | None = None) -> DataFrame:
    """Fold metrics rolled up per (series, model), with conformal columns where sets exist and ``elapsed_seconds`` where given."""
    summary = aggregate_folds(fold_metrics(preds))
    if seconds is not None:
        summary = _timed(summary, seconds)
    if "in_set_0" not in preds.columns:
        return summary
    cover = aggregate_conformal(conformal_stats(preds.filter(F.col("in_set_0").isNotNull())))
    return summary.join(cover, [*SERIES, "model"], "left")


def trade_bars(bars: DataFrame, models: DataFrame, variant: str = "fusion_num", initial: float = 100.0, block: int = BLOCK_ROWS) -> DataFrame:
    """The whole chain over closed candles: features, predictions of ``anchor_model`` rows, gated and sized positions, balance.

    Bars whose features aren't complete have no prediction and no position. The variant must take bar features only.
    """
    x, _ = M.input_array(variant)
    ready = build_features(bars, block=block).dropna(subset=list(M.FEATURE_COLUMNS))
    preds = M.predict_bars(models, ready.select(*SERIES, TS, x.alias("x")))
    outcomes = materialise(bar_outcomes(materialise(preds, "live-predictions"), bars, block=block), "live-outcomes")
    return equity_curve(outcomes, initial, block=block)


def refit(bars: DataFrame, emb: DataFrame, dataset: DataFrame | None = None, **regime_options) -> dict:
    """Recompute regimes, vectors and the anchor model from the current tables, with step timings."""
    steps, out = {}, {}

    def timed(name: str, job: Callable[[], DataFrame]) -> DataFrame:
        started = time.monotonic()
        out[name] = materialise(job(), name)
        steps[name] = round(time.monotonic() - started, 3)
        return out[name]

    regimes = timed("regimes", lambda: label_regimes(bars, **regime_options))
    timed("vectors", lambda: build_vectors(emb, regimes))
    timed("anchor", lambda: M.fit_anchor(model_dataset(bars) if dataset is None else dataset))
    return {**out, "seconds": steps}
