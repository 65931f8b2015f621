"""Row selection: dedupe, merge, range scans, latest-N, lookups, evenly spaced picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.operators.series import with_position
from barframe.schema import SERIES, TS


def row_hash(df: DataFrame, leave_out: Sequence[str] = ()) -> Column:
    """Hash of a row's columns (maps as sorted entries)."""
    cols = [
        F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name)
        for f in df.schema.fields if f.name not in leave_out
    ]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("bigint")


def key_hash(df: DataFrame, key: Sequence[str], seed: int = 0) -> Column:
    """Seeded hexadecimal hash of a key, the same in any engine: md5 of its parts as text (times in microseconds) and the seed."""
    times = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    parts = [(F.unix_micros(c) if c in times else F.col(c)).cast("string") for c in key]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def dedupe(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], keep: str = "first") -> DataFrame:
    """One row per key: the first (or last) under ``order``.

    The rank filter is applied map-side before the shuffle, so many copies of one key do not travel.
    Remaining ties are settled by the other columns, which makes reruns repeatable.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    if keep == "last":  # plain column names only
        order = [F.col(c).desc_nulls_last() for c in order]
    w = Window.partitionBy(*key).orderBy(*order, row_hash(df, key))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def merge(
    existing: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str], keep: str, batch: str | None = None
) -> DataFrame:
    """Union two batches and keep one row per key; ``batch`` names a column of 1 for rows of ``new``, else 0.

    ``keep="latest"`` takes the highest ``order`` values, a tie going to ``new``; ``keep="earliest"``
    takes the lowest, a tie going to ``existing``.
    """
    both = existing.withColumn("_batch", F.lit(0)).unionByName(
        new.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    latest = keep == "latest"
    if keep not in ("latest", "earliest"):
        raise ValueError("keep must be 'latest' or 'earliest'")
    sort = [F.col(c).desc_nulls_last() if latest else F.col(c).asc_nulls_last() for c in order]
    sort.append(F.col("_batch").desc() if latest else F.col("_batch").asc())
    kept = dedupe(both, key, sort)
    return kept.withColumnRenamed("_batch", batch) if batch else kept.drop("_batch")


def spread_join(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Join a table with few rows per key to data whose keys may be hot.

    The small side is repeated once per salt and the data's key is extended by a row hash, so a key
    holding a third of the data spreads over ``salts`` tasks if Spark shuffles the join. When the
    small side's measured size is below the broadcast threshold, Spark broadcasts it instead.
    """
    salted = df.withColumn("_salt", F.pmod(row_hash(df, on), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def range_latest(df: DataFrame, start=None, end=None, limit: int = 500, ts: str = TS) -> DataFrame:
    """Rows in the closed range [start, end], then the most recent ``limit``, oldest first."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end))
    if limit:
        df = df.orderBy(F.col(ts).desc()).limit(limit)
    return df.orderBy(ts)


def top_n_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group; the limit is applied map-side before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows equal to the given key values (pushed to the scan)."""
    for name, value in keys.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def latest_common_key(a: DataFrame, b: DataFrame, ts: str = TS, by: Sequence[str] = SERIES) -> DataFrame:
    """Newest key present in both tables, per series."""
    return a.join(b, [*by, ts], "left_semi").groupBy(*by).agg(F.max(ts).alias("latest"))


def common_keys(*frames: DataFrame, key: Sequence[str] = (*SERIES, TS)) -> DataFrame:
    """Keys present in every table."""
    out = frames[0].select(*key)
    for other in frames[1:]:
        out = out.intersect(other.select(*key))
    return out


def evenly_spaced(df: DataFrame, n: int, by: Sequence[str] = SERIES, ts: str = TS) -> DataFrame:
    """``n`` rows per series at evenly spaced positions, first and last included.

    Indices are ``linspace(0, rows - 1, n)`` truncated to integers; a row is kept when an index
    falls on it, so repeated indices of a short series give one row.
    """
    positioned = with_position(df, by=by, ts=ts, pos="_p", total="_n")
    if n <= 1:
        return positioned.filter(F.col("_p") == 0).drop("_p", "_n")
    step = (F.col("_n") - 1) / F.lit(float(n - 1))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * step))
    return positioned.filter(F.array_contains(wanted, F.col("_p"))).drop("_p", "_n")
