"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SALTS = 64


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text: maximal runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, SPACES), "")


def n_words(text: Column) -> Column:
    """Number of words, without building them: positions where a word begins."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), ""))


def null_key(name: str) -> Column:
    """A join key that keeps null apart from every string."""
    return F.when(F.col(name).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(name)))


def salted_join(df: DataFrame, small: DataFrame, on: Sequence[str], salt: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key, where a key may hold a third of the rows.

    Spark broadcasts the table if its measured size allows; otherwise the key's rows spread over ``SALTS`` tasks by a
    hash of the ``salt`` columns.
    """
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
