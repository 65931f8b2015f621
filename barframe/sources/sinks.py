"""Idempotent Parquet sinks and keyed table scans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.functions.scalar import source_slug
from barframe.operators.tables import merge
from barframe.schema import CANDLE_KEYED, EMBEDDING, REGIME, SERIES, TS
from barframe.session import exists
from barframe.sources.candles import with_month

_CANDLE_KEY = [*SERIES, TS]
_PRODUCERS = {"embeddings": "embed_windows", "features_sentiment": "aggregate_news_for_bars", "regimes": "label_regimes"}


def _upsert(
    df: DataFrame, path: str, partitions: Sequence[str], key: Sequence[str], order: Sequence[str], keep: str
) -> int:
    """Merge ``df`` into the partitioned table at ``path``, rewriting only the partitions it touches.

    Returns how many rows of ``df`` are in the table now: not those that repeat a key in it or lose to a stored row. They are
    counted while the table is written. Null is a partition value like others. Folders can't tell an empty string
    from null, so it becomes null.
    """
    spark = df.sparkSession
    texts = [f.name for f in df.schema.fields if f.name in partitions and isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in texts})
    if exists(spark, path):
        stored = spark.read.schema(df.schema).parquet(path)
        touched = df.select(*partitions).distinct()
        wanted = touched.select(*[F.col(c).alias(f"_{c}") for c in partitions])
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in partitions])
        old = _pruned(stored, touched, partitions).join(wanted, same, "left_semi")
    else:
        old = df.limit(0)
    written = Observation()
    merged = merge(old, df, key, order, keep, batch="_new").observe(written, F.sum("_new").alias("rows")).select(df.columns)
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))
    return written.get["rows"] or 0


def _pruned(stored: DataFrame, touched: DataFrame, partitions: Sequence[str], most: int = 4096) -> DataFrame:
    """``stored`` limited to the values of the touched partitions as literals, so that the scan opens no other folder.

    Partition values are few per batch; a batch that touches more than ``most`` partitions reads the table instead.
    """
    values = touched.limit(most + 1).collect()
    if len(values) > most:
        return stored
    for name in partitions:
        known = sorted({r[name] for r in values if r[name] is not None})
        wanted = F.col(name).isin(known) if known else F.lit(False)
        stored = stored.filter(wanted | F.col(name).isNull() if any(r[name] is None for r in values) else wanted)
    return stored


def merge_candles(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row per candle, the latest ingested; a tie goes to the new batch."""
    return merge(existing, new, _CANDLE_KEY, ["ingested_at"], "latest")


def merge_news(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (source, day, url), the earliest published and ingested."""
    return merge(existing, new, ["source", "date", "url"], ["published_at", "ingested_at"], "earliest")


def merge_embeddings(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One vector per (pair, interval, open_time), the newer batch winning."""
    return merge(existing, new, _CANDLE_KEY, [], "latest")


def upsert_ohlcv(df: DataFrame, root: str) -> int:
    """Upsert candles into ``<root>/ohlcv``, partitioned by pair, interval and month."""
    fixed = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in CANDLE_KEYED.fields])
    return _upsert(with_month(fixed), f"{root}/ohlcv", ["pair", "interval", "month"], _CANDLE_KEY, ["ingested_at"], "latest")


def with_news_partition(df: DataFrame) -> DataFrame:
    """Add ``date`` (of publication) and slug the source: the news table's partition columns."""
    return df.withColumns(
        {"source": source_slug(F.col("source")), "date": F.date_format("published_at", "yyyy-MM-dd")}
    )


def upsert_news(df: DataFrame, root: str) -> int:
    """Upsert articles into ``<root>/news``, partitioned by source and day; deduped within a source-day."""
    return _upsert(
        with_news_partition(df), f"{root}/news", ["source", "date"], ["source", "date", "url"],
        ["published_at", "ingested_at"], "earliest",
    )


def upsert_embeddings(df: DataFrame, root: str) -> int:
    """Upsert vectors into ``<root>/embeddings``, partitioned by pair, interval and month."""
    return _upsert(with_month(df), f"{root}/embeddings", [*SERIES, "month"], _CANDLE_KEY, [], "latest")


def write_keyed(df: DataFrame, root: str, kind: str) -> None:
    """Store one typed per-bar table (embeddings, sentiment features, regimes), partitioned by series."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SERIES).parquet(f"{root}/{kind}"))


def read_keyed(
    spark: SparkSession, root: str, kind: str, pair: str | None = None, interval: str | None = None
) -> DataFrame:
    """Read a per-bar table; the error for a missing one names the job that produces it."""
    path = f"{root}/{kind}"
    hint = f"; run {_PRODUCERS[kind]} and write_keyed" if kind in _PRODUCERS else ""
    if not exists(spark, path):
        raise FileNotFoundError(f"no {kind} table under {path}{hint}")
    schema = {"embeddings": EMBEDDING, "regimes": REGIME}.get(kind)
    df = spark.read.parquet(path)
    if schema:  # a month folder, if there is one, only divides the files
        df = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    for name, wanted in (("pair", pair), ("interval", interval)):
        if wanted is not None:
            df = df.filter(F.col(name) == wanted)
    if (pair or interval) and df.limit(1).count() == 0:
        raise FileNotFoundError(f"no {kind} for pair={pair} interval={interval}{hint}")
    return df


def wide_to_array(df: DataFrame, prefix: str = "e", out: str = "embedding") -> DataFrame:
    """Pack the columns ``e0, e1, ...`` into one array<float> column."""
    wide = sorted(
        (c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()), key=lambda c: int(c[len(prefix):])
    )
    rest = [c for c in df.columns if c not in wide]
    return df.select(*rest, F.array(*[F.col(c).cast("float") for c in wide]).alias(out))


# --------------------------------------------------------------------------- predictions and metrics
def write_predictions(preds: DataFrame, root: str) -> None:
    """Store predictions as ``<root>/predictions/pair=/interval=/model=``."""
    (preds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*SERIES, "model").parquet(f"{root}/predictions"))


def read_predictions(spark: SparkSession, root: str, pair: str | None = None, interval: str | None = None) -> DataFrame:
    """Predictions of every model, the model name taken from the folder."""
    df = spark.read.parquet(f"{root}/predictions")
    for name, wanted in (("pair", pair), ("interval", interval)):
        if wanted is not None:
            df = df.filter(F.col(name) == wanted)
    return df


def metrics_documents(summary: DataFrame, folds: DataFrame, conformal: DataFrame | None = None) -> DataFrame:
    """One nested document per (series, model): ``summary`` struct and ``folds`` array."""
    key = [*SERIES, "model"]
    inner = [c for c in folds.columns if c not in key]
    packed = folds.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*inner))).alias("folds"))
    docs = summary.select(*key, F.struct(*summary.columns).alias("summary")).join(packed, key)
    if conformal is not None:
        extra = [c for c in conformal.columns if c not in key]
        rows = conformal.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*extra))).alias("conformal_folds"))
        docs = docs.join(rows, key, "left")
    return docs


def write_metrics(docs: DataFrame, root: str) -> None:
    """Store metrics documents as JSON below ``<root>/metrics/pair=/interval=/model=``."""
    (docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*SERIES, "model").json(f"{root}/metrics"))


def read_metrics(spark: SparkSession, root: str, multi_line: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Re-read metrics documents (``multi_line`` for pretty-printed files of other writers)."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(f"{root}/metrics")


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    """The flattened ``summary`` of every stored metrics document."""
    return read_metrics(spark, root).select("summary.*")


def write_summary_csv(df: DataFrame, path: str, cols: Sequence[str], sort: Sequence) -> None:
    """Write selected columns of the (small) summary table as one sorted CSV with a header."""
    df.select(*cols).orderBy(*sort).coalesce(1).write.mode("overwrite").csv(path, header=True)
