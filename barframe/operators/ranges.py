"""Everything known about a time range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions.scalar import ratio, safe_ln
from barframe.operators.metrics import p_histogram
from barframe.operators.series import BLOCK_ROWS, over_rows, with_position
from barframe.schema import REGIME_NAMES, TS


def _between(df: DataFrame, ts: str, start, end) -> DataFrame:
    lo, hi = F.least(F.lit(start), F.lit(end)), F.greatest(F.lit(start), F.lit(end))
    return df.filter(F.col(ts).between(lo, hi))


def range_ohlc(bars: DataFrame, start, end, block: int = BLOCK_ROWS) -> DataFrame:
    """First and last close, extremes, return and realised volatility of the range (zeros when empty)."""
    inside = with_position(_between(bars, TS, start, end), rows=block, total=None)
    stepped = over_rows(inside, lambda f: {"_r": safe_ln(ratio(F.col("close"), f.lag("close")))}, before=1, block=block)
    agg = stepped.agg(
        F.count(F.lit(1)).alias("bars"), F.min_by("close", TS).alias("first_close"),
        F.max_by("close", TS).alias("last_close"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.stddev_pop("_r").alias("realised_vol"),
    )
    ret = ratio(F.col("last_close") - F.col("first_close"), F.col("first_close"))
    names = ["first_close", "last_close", "high", "low", "return_pct", "realised_vol"]
    return agg.withColumn("return_pct", ret).select("bars", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names])


def range_regimes(bars: DataFrame, regimes: DataFrame, start, end) -> DataFrame:
    """Bars per regime; ``unknown`` also counts the bars without a label."""
    labels = _between(regimes, TS, start, end).agg(
        F.count(F.lit(1)).alias("labelled"),
        *[F.count_if(F.col("regime") == k).alias(v) for k, v in REGIME_NAMES.items()],
        F.count_if(~F.col("regime").isin(*REGIME_NAMES)).alias("other"),
    )
    total = _between(bars, TS, start, end).agg(F.count(F.lit(1)).alias("bars"))
    both = total.withColumn("_k", F.lit(0)).join(labels.withColumn("_k", F.lit(0)), "_k")  # one row each
    unknown = F.greatest(F.lit(0), F.col("bars") - F.col("labelled")) + F.col("other")
    return both.select(*REGIME_NAMES.values(), unknown.alias("unknown"))


def range_news(news: DataFrame, start, end) -> DataFrame:
    """Articles in the range: count, and mean / max / min of the scores present."""
    return _between(news, "published_at", start, end).agg(
        F.count(F.lit(1)).alias("count"), F.avg("sent_score").alias("mean"),
        F.max("sent_score").alias("max"), F.min("sent_score").alias("min"),
    )


def top_articles(news: DataFrame, start, end, n: int = 5) -> DataFrame:
    """Articles with the largest absolute score, unscored ones last; ties by id."""
    inside = _between(news, "published_at", start, end)
    return inside.orderBy(F.abs("sent_score").desc_nulls_last(), F.col("id").asc()).limit(n)


def range_predictions(log: DataFrame, start, end) -> DataFrame:
    """Prediction counts and accuracies; the overall one divides by all predictions, labelled or not."""
    confident, right = F.col("cp_singleton"), F.coalesce("correct", F.lit(False))
    labelled = F.col("correct").isNotNull()
    share = lambda num, den: F.count_if(num) / F.nullif(F.count_if(den), F.lit(0))
    return _between(log, TS, start, end).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(confident).alias("n_traded"),
        F.count_if(~confident).alias("n_abstained"), share(right, F.lit(True)).alias("overall_accuracy"),
        share(confident & right, confident & labelled).alias("confident_accuracy"),
        share(~confident & right, ~confident & labelled).alias("uncertain_accuracy"),
    )


def analyze_range(
    bars: DataFrame, regimes: DataFrame, news: DataFrame, log: DataFrame, start, end, bins: int = 12
) -> dict[str, DataFrame]:
    """Range report of one series as small frames: ohlc, regimes, news, top_news, predictions, histogram."""
    return {
        "ohlc": range_ohlc(bars, start, end),
        "regimes": range_regimes(bars, regimes, start, end),
        "news": range_news(news, start, end),
        "top_news": top_articles(news, start, end),
        "predictions": range_predictions(log, start, end),
        "histogram": p_histogram(_between(log, TS, start, end), bins),
    }
