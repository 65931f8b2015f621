"""News sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.functions.text import decode_sentiment, extract_tickers, strip_html, url_id
from barframe.schema import NEWS
from barframe.session import exists


def read_news(spark: SparkSession, root: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored articles; an empty frame when nothing was landed yet.

    ``start`` and ``end`` (closed range of publication times, as ISO text) open the days between them only.
    """
    path = f"{root}/news"
    schema = T.StructType(NEWS.fields + [T.StructField("date", T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    news = spark.read.schema(schema).parquet(path)
    for bound, keep in ((start, lambda c, v: c >= v), (end, lambda c, v: c <= v)):
        if bound is not None:
            news = news.filter(keep(F.col("date"), F.lit(bound[:10])) & keep(F.col("published_at"), F.lit(bound).cast("timestamp")))
    return news


def with_decoded_sentiment(news: DataFrame) -> DataFrame:
    """Decode the sentiment JSON into ``sent_score`` and ``sent_conf``; rows without a valid time go."""
    decoded = decode_sentiment(F.col("sentiment"))
    return (
        news.withColumns({"published_at": F.col("published_at").try_cast("timestamp"), "_s": decoded})
        .filter(F.col("published_at").isNotNull())
        .withColumns({"sent_score": F.col("_s.ensemble"), "sent_conf": F.col("_s.confidence")})
        .drop("_s")
    )


def read_scored_news(spark: SparkSession, root: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored articles with decoded sentiment, in no particular order."""
    return with_decoded_sentiment(read_news(spark, root, start, end))


def normalise_news(feed: DataFrame, ingested_at: str = "ingested_at") -> DataFrame:
    """Typed articles from raw feed entries.

    Input columns: ``source, title, url, summary, published, updated, ingested_at`` (times as text or
    timestamps). Entries without a URL are dropped. Publication falls back to the update time, then
    to the ingest time. The summary is stripped of markup, tickers come from title and summary.
    """
    entries = feed.filter(F.col("url").isNotNull() & (F.col("url") != ""))
    stripped = strip_html(entries, "summary")
    title = F.coalesce(F.col("title"), F.lit(""))
    published = F.coalesce(
        F.col("published").try_cast("timestamp"), F.col("updated").try_cast("timestamp"), F.col(ingested_at)
    )
    return stripped.select(
        url_id(F.col("url")).alias("id"), "source", title.alias("title"), "url", "summary",
        published.alias("published_at"), F.col(ingested_at).alias("ingested_at"),
        extract_tickers(title, F.col("summary")).alias("tickers"),
        F.lit(None).cast(T.MapType(T.StringType(), T.LongType())).alias("raw_sentiment"),
        F.lit(None).cast("string").alias("sentiment"),
    )


def normalise_posts(posts: DataFrame, source: str = "CryptoPanic", ingested_at: str = "ingested_at") -> DataFrame:
    """Typed articles from aggregator posts.

    Input columns: ``url, domain, title, published_at, currencies array<string>, votes map, ingested_at``.
    The domain stands in for a missing URL; tickers are the sorted distinct currency codes.
    """
    url = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.nullif(F.col("domain"), F.lit("")))
    codes = F.filter(F.coalesce("currencies", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    return posts.withColumn("url", url).filter(F.col("url").isNotNull()).select(
        url_id(F.col("url")).alias("id"), F.lit(source).alias("source"),
        F.coalesce("title", F.lit("")).alias("title"), "url", F.lit("").alias("summary"),
        F.col("published_at").try_cast("timestamp").alias("published_at"), F.col(ingested_at).alias("ingested_at"),
        F.array_sort(F.array_distinct(codes)).alias("tickers"),
        F.col("votes").cast(T.MapType(T.StringType(), T.LongType())).alias("raw_sentiment"),
        F.lit(None).cast("string").alias("sentiment"),
    )
