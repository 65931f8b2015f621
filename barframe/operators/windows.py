"""Fixed-length windows of bars: collected arrays, feature sequences, patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.operators.series import BLOCK_ROWS, over_rows
from barframe.schema import SERIES


def collect_windows(
    df: DataFrame, cols: Sequence[str] = ("open", "high", "low", "close"), length: int = 64, name: str = "window",
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """The last ``length`` rows of ``cols`` at each row, as an array of structs; full windows only."""

    def build(f):
        win = f.rows(length - 1)
        return {name: F.collect_list(F.struct(*cols)).over(win)}

    return over_rows(df, build, before=length - 1, block=block).filter(F.size(name) == length)


def sequence_windows(
    df: DataFrame, cols: Sequence[str], length: int = 64, pad: bool = False, name: str = "sequence",
    block: int = BLOCK_ROWS, by: Sequence[str] = SERIES, pos: str = "pos",
) -> DataFrame:
    """``length`` x features matrix ending at each row; the row's label is the window's label.

    Short windows at the head are dropped, or zero-filled from the left with ``pad`` (zero is the
    training mean once inputs are standardised).
    """
    inputs = F.array(*[F.col(c).cast("double") for c in cols])
    out = over_rows(
        df, lambda f: {name: F.collect_list(inputs).over(f.rows(length - 1))}, before=length - 1, block=block, by=by, pos=pos
    )
    if not pad:
        return out.filter(F.size(name) == length)
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), len(cols)), F.lit(length) - F.size(name))
    return out.withColumn(name, F.concat(zeros, F.col(name)))


def patch_windows(df: DataFrame, patch: int = 8, col: str = "sequence", name: str = "patches") -> DataFrame:
    """Cut each sequence into patches of ``patch`` rows, each flattened; the oldest rows that do not
    fill a patch are left out."""
    whole = F.size(col) - F.size(col) % patch
    trimmed = F.slice(F.col(col), F.size(col) - whole + 1, whole)
    count = F.floor(whole / patch).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.flatten(F.slice(trimmed, i * patch + 1, F.lit(patch)))
    )
    empty = F.array().cast("array<array<double>>")
    return df.withColumn(name, F.when(count > 0, pieces).otherwise(empty))
