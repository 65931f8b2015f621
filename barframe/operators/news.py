"""News selection and aggregation onto bars."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.text import decode_sentiment, ensemble_score, pairs_of, scoring_text
from barframe.functions.vectors import let
from barframe.schema import INTERVAL_MS, PAIR_TICKERS, SENTIMENT_FEATURES, SERIES, TS

DAY_MS = 86_400_000
_BLOCK_BUCKETS = 4096
_MACRO = "*"


def filter_news_for_pair(
    news: DataFrame, pair: str, tickers: dict[str, list[str]] | None = None, include_macro: bool = True
) -> DataFrame:
    """Articles counting for ``pair``: overlapping tickers, plus ticker-less (macro) ones if wanted.

    ``ALL`` keeps everything; a pair without known tickers keeps nothing.
    """
    if pair == "ALL":
        return news
    symbols = (PAIR_TICKERS if tickers is None else tickers).get(pair, [])
    if not symbols:
        return news.limit(0)
    keep = F.coalesce(F.arrays_overlap("tickers", F.array(*[F.lit(s) for s in symbols])), F.lit(False))
    macro = F.coalesce(F.size("tickers"), F.lit(0)) <= 0
    return news.filter(keep | macro if include_macro else keep)


def latest_news(news: DataFrame, limit: int = 25, ticker: str | None = None) -> DataFrame:
    """Newest articles first, optionally only those tagged ``ticker``."""
    if ticker is not None:
        news = news.filter(F.array_contains("tickers", ticker))
    return news.orderBy(F.col("published_at").desc(), F.col("id").desc()).limit(limit)


def unscored(news: DataFrame) -> DataFrame:
    """Articles without a sentiment payload."""
    return news.filter(F.col("sentiment").isNull() | (F.col("sentiment") == ""))


# --------------------------------------------------------------------------- scoring
def _lexicon_share(text: Column, positive: list[str], negative: list[str]) -> Column:
    """A text is searched once, for whole words of both lists; only those found are counted."""
    words = "|".join(map(re.escape, [*positive, *negative]))
    found = F.regexp_extract_all(F.lower(text), F.lit(f"(?<![a-z])(?:{words})(?![a-z])"), F.lit(0))

    def share(found: Column) -> Column:
        up, down = (F.size(F.filter(found, lambda w: w.isin(some))) for some in (positive, negative))
        return F.when(up + down > 0, (up - down) / (up + down)).otherwise(F.lit(0.0))

    return let(found, share)


# The default scorer's words. Two small lists stand in for the two text models.
MARKET_WORDS = (["surge", "rally", "gain", "bullish", "record"], ["crash", "hack", "ban", "bearish", "fear"])
FINANCE_WORDS = (["growth", "profit", "gain", "up", "strong"], ["loss", "fraud", "decline", "down", "weak"])


def lexicon_scorer(first=MARKET_WORDS, second=FINANCE_WORDS) -> Callable[[Column], tuple[Column, Column]]:
    """Scorer built from two word lists: (positives - negatives) / (positives + negatives)."""
    return lambda text: (_lexicon_share(text, *first), _lexicon_share(text, *second))


def score_news(
    news: DataFrame, scorer: Callable[[Column], tuple[Column, Column]] | None = None, text: Column | None = None
) -> DataFrame:
    """Write the sentiment JSON of every article that has none yet; scored rows pass through.

    ``scorer`` maps a text Column to two score Columns in [-1, 1]; a pandas or ``predict_batch_udf``
    function applied to the Column works, so model batches run inside the tasks.
    """
    scorer = scorer or lexicon_scorer()
    body = scoring_text(F.col("title"), F.col("summary")) if text is None else text
    todo = F.col("sentiment").isNull() | (F.col("sentiment") == "")
    payload = F.to_json(ensemble_score(body, *scorer(body)))
    return news.withColumn("sentiment", F.when(todo, payload).otherwise(F.col("sentiment")))


# --------------------------------------------------------------------------- news onto bars
def _partials(scored: DataFrame) -> DataFrame:
    """One row per (pair or macro, time bucket): everything the window statistics need."""
    latest = F.struct(F.col("published_at").alias("at"), F.col("id"), F.col("score"))
    return scored.groupBy("pair", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"),
        F.min("score").alias("lo"), F.max("score").alias("hi"), F.max(latest).alias("last"),
        F.sum("conf").alias("cs"),
    )


def _windowed(bars: DataFrame, buckets: DataFrame, span: int) -> DataFrame:
    """Statistics of the ``span`` buckets before each bar's, in a constant number of steps per row whatever the span.

    The bucket axis is cut into segments of ``span``. A window then is the end of one segment, from its first bucket on, and
    the beginning of the next: both come from running totals inside segments, forwards and backwards. A mark at the
    window's first bucket stands where the backward total is read. One shuffle by (pair, block of whole segments).
    """
    marks = bars.groupBy("pair", "_blk", "bucket").agg(F.lit(True).alias("_mark")).select("pair", (F.col("bucket") - span).alias("bucket"), "_blk")
    both = bars.unionByName(buckets, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("_seg", F.floor(F.col("bucket") / span)).repartition("pair", "_blk")
    segment = Window.partitionBy("pair", "_blk", "_seg")
    before = segment.orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    onward = segment.orderBy(F.col("bucket").desc()).rangeBetween(Window.unboundedPreceding, 0)
    pick = {"n": F.sum, "s": F.sum, "ss": F.sum, "lo": F.min, "hi": F.max, "last": F.max, "cs": F.sum}

    def totals(over) -> Column:
        return F.struct(*[f(c).over(over).alias(c) for c, f in pick.items()])

    both = both.withColumns({"_late": totals(before), "_early": totals(onward)})
    start = Window.partitionBy("pair", "_blk").orderBy("bucket").rangeBetween(-span, -span)
    both = both.withColumn("_early", F.first("_early").over(start)).filter(F.col(TS).isNotNull())

    def joined(c: str) -> Column:
        late, early = F.col(f"_late.{c}"), F.col(f"_early.{c}")
        if c == "last":
            return F.coalesce(late, early)  # the later segment's articles are the later ones
        if pick[c] is F.sum:
            return F.when(late.isNotNull() | early.isNotNull(), F.coalesce(late, F.lit(0)) + F.coalesce(early, F.lit(0)))
        return (F.least if c == "lo" else F.greatest)(late, early)

    return both.select(*SERIES, TS, *[joined(c).alias(c) for c in pick])


def aggregate_news_for_bars(
    news: DataFrame,
    bars: DataFrame,
    lookback_ms: int = DAY_MS,
    include_macro: bool = True,
    tickers: dict[str, list[str]] | None = None,
    grid_ms: int | None = None,
    with_last_at: bool = False,
) -> DataFrame:
    """Sentiment of the articles in ``[open_time - lookback, open_time)`` for every bar.

    Articles are first summed into buckets of ``grid_ms`` per pair (macro articles once, and only
    their bucket rows are copied to the pairs), which caps the rows of a hot pair at one per bucket.
    Bars and buckets are then unioned per (pair, block of buckets) and read through running totals (see ``_windowed``);
    buckets within the lookback of the next block are copied into it. There is no join, and a bar costs the same however
    many buckets its window has.

    ``grid_ms`` must divide the lookback and every bar's open time; other bars raise an error. By default it is the
    greatest common divisor of the lookback, an hour and the bars' intervals.
    """
    if grid_ms is None:
        known = [INTERVAL_MS[r["interval"]] for r in bars.select("interval").distinct().collect() if r["interval"] in INTERVAL_MS]
        grid_ms = math.gcd(lookback_ms, 3_600_000, *known)  # intervals are a handful of names
    if lookback_ms % grid_ms:
        raise ValueError("grid_ms must divide lookback_ms")
    mapping = PAIR_TICKERS if tickers is None else tickers
    sentiment = decode_sentiment(F.col("sentiment"))
    macro = F.coalesce(F.size("tickers"), F.lit(0)) <= 0
    macro_target = F.array(F.lit(_MACRO)) if include_macro else F.array().cast("array<string>")
    # exploding the one parsed payload keeps the parse from being repeated by the filter and behind the pairs
    parsed = news.select("id", "published_at", "tickers", F.explode(F.array(sentiment)).alias("sent")).filter(F.col("sent").isNotNull())
    routed = parsed.select(
        "id", "published_at", "sent",
        F.explode(F.when(macro, macro_target).otherwise(pairs_of(F.col("tickers"), mapping))).alias("pair"),
    )
    scored = routed.select(
        "pair", "id", "published_at", F.coalesce("sent.ensemble", F.lit(0.0)).alias("score"),
        F.coalesce("sent.confidence", F.lit(0.0)).alias("conf"),
        F.floor(F.unix_millis("published_at") / grid_ms).alias("bucket"),
    )
    every = F.array(*[F.lit(p) for p in mapping])
    buckets = _partials(scored).withColumn(
        "pair", F.explode(F.when(F.col("pair") == _MACRO, every).otherwise(F.array("pair")))
    )
    # a bar at bucket b reads buckets [b - span, b - 1]
    span = lookback_ms // grid_ms
    size = span * max(1, _BLOCK_BUCKETS // span)  # blocks hold whole segments of span buckets
    block = F.floor(F.col("bucket") / size)
    spills = F.when(F.pmod(F.col("bucket"), F.lit(size)) >= size - span, block + 1)
    buckets = buckets.withColumn("_blk", F.explode(F.array_compact(F.array(block, spills))))
    open_ms = F.unix_millis(TS)
    aligned = F.when(open_ms % grid_ms == 0, F.floor(open_ms / grid_ms)).otherwise(
        F.raise_error(F.lit("bar open_time is not on the news grid; choose a smaller grid_ms")).cast("long")
    )
    keys = bars.select(*SERIES, TS, aligned.alias("bucket")).withColumn("_blk", F.floor(F.col("bucket") / size))
    both = _windowed(keys, buckets, span)
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean))
    zero = F.lit(0.0)
    out = {
        "sent_count": F.coalesce("n", F.lit(0)),
        "sent_mean": F.coalesce(mean, zero),
        "sent_std": F.coalesce(F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(spread), zero),
        "sent_min": F.coalesce("lo", zero),
        "sent_max": F.coalesce("hi", zero),
        "sent_last": F.coalesce("last.score", zero),
        "sent_conf_mean": F.coalesce(F.col("cs") / F.col("n"), zero),
    }
    cols = [out[c].alias(c) for c in SENTIMENT_FEATURES]
    if with_last_at:
        cols.append(F.col("last.at").alias("sent_last_at"))
    return both.select(*SERIES, TS, *cols)


def check_no_future_news(features: DataFrame, news: DataFrame, lookback_ms: int = DAY_MS, **options) -> DataFrame:
    """Bars of a supplied sentiment table whose article count or mean differs from the strict window before the bar.

    A table that let an article count at or after its publication bar, or lost one, shows up here; empty means passed.
    """
    key = [*SERIES, TS]
    strict = aggregate_news_for_bars(news, features.select(*key), lookback_ms, **options)
    strict = strict.select(*key, F.col("sent_count").alias("_n"), F.col("sent_mean").alias("_m"))
    joined = features.join(strict, key, "left")
    same = (F.col("sent_count") == F.col("_n")) & (F.abs(F.col("sent_mean") - F.col("_m")) <= 1e-9)
    return joined.filter(~F.coalesce(same, F.lit(False))).select(*key, "sent_count", F.col("_n").alias("strict_count"))


# --------------------------------------------------------------------------- alignment
def align_modalities(
    features: DataFrame, emb: DataFrame | None = None, sent: DataFrame | None = None, dim: int | None = None
) -> DataFrame:
    """Attach embeddings and sentiment to feature rows; a missing vector or value becomes zeros."""
    key = [*SERIES, TS]
    out = features
    if emb is not None:
        if dim is None:
            raise ValueError("give the embedding dimension")
        out = out.join(emb.select(*key, "embedding"), key, "left")
        zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
        out = out.withColumn("embedding", F.coalesce("embedding", zeros))
    if sent is not None:
        out = out.join(sent.select(*key, *SENTIMENT_FEATURES), key, "left")
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in SENTIMENT_FEATURES})
    return out


def align_sentiment_only(features: DataFrame, sent: DataFrame) -> DataFrame:
    """Feature rows that have at least one article in their window."""
    key = [*SERIES, TS]
    return features.join(sent.filter(F.col("sent_count") > 0).select(*key, *SENTIMENT_FEATURES), key)
