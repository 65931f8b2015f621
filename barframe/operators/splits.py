"""Chronological splits as projections on (row, n): no join, no shuffle of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def auto_folds(df: DataFrame, n_folds: int = 6, train_frac: float = 0.5, n: str = "n") -> DataFrame:
    """Add ``initial`` (first training size), ``test`` (fold size) and ``n_folds`` from the series length."""
    initial = F.floor(F.col(n) * F.lit(float(train_frac))).cast("long")
    test = F.greatest(F.lit(1), F.expr(f"({n} - initial) div {n_folds}")).cast("long")
    return df.withColumn("initial", initial).withColumn("test", test).withColumn("n_folds", F.lit(n_folds).cast("long"))


def fold_count(initial: Column, test: Column, step: Column, n: Column, gap: int, max_folds: Column | int | None) -> Column:
    """Folds whose whole test window fits: the last one is lost when the gap pushes it past the end."""
    fits = F.floor((n - initial - gap - test) / step) + 1
    fits = F.greatest(F.lit(0), F.when(initial + gap + test <= n, fits).otherwise(0))
    return (fits if max_folds is None else F.least(fits, max_folds if isinstance(max_folds, Column) else F.lit(max_folds))).cast("long")


def walk_forward(
    df: DataFrame,
    initial: Column | int,
    test: Column | int,
    step: Column | int | None = None,
    gap: int = 1,
    max_folds: Column | int | None = None,
    row: str = "row",
    n: str = "n",
) -> DataFrame:
    """Test-row assignment of expanding walk-forward folds.

    Fold ``k`` trains on rows ``[0, initial + k step)`` and tests the ``test`` rows after a gap. Adds
    ``fold`` and ``train_end``; rows outside every test window are dropped, rows in several (step
    smaller than test) repeat. The folds of a row follow from arithmetic on its position.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    initial, test = as_col(initial), as_col(test)
    step = test if step is None else as_col(step)
    folds = fold_count(initial, test, step, F.col(n), gap, max_folds)
    offset = F.col(row) - initial - gap
    last = F.least(F.floor(offset / step), folds - 1)
    first = F.greatest(F.lit(0), F.floor((offset - test) / step) + 1)
    hits = F.when((offset >= 0) & (last >= first), F.sequence(first.cast("long"), last.cast("long")))
    return df.withColumn("fold", F.explode(hits)).withColumn("train_end", (initial + F.col("fold") * step).cast("long"))


def fold_table(df: DataFrame, by: list[str], gap: int = 1, max_folds: int | None = None, n: str = "n") -> DataFrame:
    """One row per (series, fold) with its boundaries, from rows carrying ``n``, ``initial``, ``test``."""
    sizes = df.groupBy(*by).agg(*[F.max(c).alias(c) for c in (n, "initial", "test")])
    count = fold_count(F.col("initial"), F.col("test"), F.col("test"), F.col(n), gap, max_folds)
    folds = sizes.withColumn("_f", count).filter(F.col("_f") > 0)
    folds = folds.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("_f") - 1))).drop("_f")
    train_end = F.col("initial") + F.col("fold") * F.col("test")
    return folds.select(
        *by, "fold", train_end.alias("train_end"), (train_end + gap).alias("test_start"),
        (train_end + gap + F.col("test")).alias("test_end"),
    )


def phase_splits(df: DataFrame, n_phases: int = 3, holdout: float = 0.1, row: str = "row", n: str = "n") -> DataFrame:
    """Cut each series into ``n_phases`` equal phases; the tail of each is its holdout.

    Adds ``phase`` and ``is_holdout``. Edges are ``k n / n_phases`` truncated to integers.
    """
    edges = [F.floor(F.col(n) * F.lit(float(k)) / F.lit(float(n_phases))) for k in range(n_phases + 1)]
    phase = sum(((F.col(row) >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    lo = F.element_at(F.array(*edges[:-1]), phase + 1)
    hi = F.element_at(F.array(*edges[1:]), phase + 1)
    cut = lo + F.floor((hi - lo) * F.lit(1 - holdout))
    return df.withColumns({"phase": phase.cast("int"), "is_holdout": F.col(row) >= cut})


def tail_split(df: DataFrame, frac: float = 0.1, row: str = "row", n: str | Column = "n") -> DataFrame:
    """Flag the last ``int(n frac)`` rows of each series as ``is_tail``."""
    size = F.col(n) if isinstance(n, str) else n
    return df.withColumn("is_tail", F.col(row) >= size - F.floor(size * F.lit(float(frac))))


def calibration_size(n_train: Column, frac: float = 0.2) -> Column:
    """Rows held back for calibration: ``min(max(64, int(n frac)), n div 2)``."""
    return F.least(F.greatest(F.lit(64), F.floor(n_train * F.lit(float(frac)))), F.floor(n_train / 2)).cast("long")


def anchor_split(df: DataFrame, frac: float = 0.9, row: str = "row", n: str = "n") -> DataFrame:
    """Flag rows after the anchor cut (first ``frac`` of the series) as ``held_out``."""
    return df.withColumn("held_out", F.col(row) >= F.floor(F.col(n) * F.lit(float(frac))))
