"""Vector and window Column functions (arrays of numbers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also when used inside array lambdas."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Unit vector; a vector with norm below 1e-12 stays as it is."""
    divisor = lambda size: F.when(size < 1e-12, F.lit(1.0)).otherwise(size)
    return let(divisor(norm(a)), lambda d: F.transform(a, lambda x: x.cast("double") / d))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    return dot(l2_normalise(a), l2_normalise(b))


def minmax(a: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    """Scale to [lo, hi]; a flat array becomes zeros."""
    bounds = F.struct(a.alias("a"), F.array_min(a).alias("low"), F.array_max(a).alias("high"))

    def scale(b: Column) -> Column:
        width = F.nullif(b["high"] - b["low"], F.lit(0.0))
        return F.transform(b["a"], lambda x: F.coalesce((x - b["low"]) / width * (hi - lo) + lo, F.lit(0.0)))

    return let(bounds, scale)


def gramian(a: Column) -> tuple[Column, Column]:
    """Gramian summation and difference fields of a series, as arrays of rows.

    With x = cos u and y = cos v: cos(u + v) = xy - sqrt(1-x^2) sqrt(1-y^2) and
    sin(u - v) = sqrt(1-x^2) y - x sqrt(1-y^2), so no inverse cosine is needed.
    """
    scaled = F.transform(minmax(a), lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    points = F.transform(scaled, lambda x: F.struct(x.alias("c"), F.sqrt(F.greatest(F.lit(0.0), 1 - x * x)).alias("s")))

    def grid(cell: Callable[[Column, Column], Column]) -> Column:
        return let(points, lambda ps: F.transform(ps, lambda p: F.transform(ps, lambda q: cell(p, q))))

    return (
        grid(lambda p, q: p["c"] * q["c"] - p["s"] * q["s"]),
        grid(lambda p, q: p["s"] * q["c"] - p["c"] * q["s"]),
    )


def quantile_edges(a: Column, bins: int = 8) -> Column:
    """Inner edges of ``bins`` linear-interpolated quantile bins."""

    def edges(ordered: Column) -> Column:
        def edge(i: Column) -> Column:
            at = (F.size(ordered) - 1) * i / F.lit(float(bins))
            low = F.floor(at).cast("int")
            x, y = F.element_at(ordered, low + 1), F.element_at(ordered, F.least(low + 2, F.size(ordered)))
            return x + (y - x) * (at - low)

        return F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), edge)

    return let(F.array_sort(a), edges)


def quantile_bins(a: Column, bins: int = 8) -> Column:
    """Bin of each value: the number of inner edges at or below it."""
    held = F.struct(a.alias("a"), quantile_edges(a, bins).alias("e"))
    return let(held, lambda h: F.transform(h["a"], lambda x: F.size(F.filter(h["e"], lambda e: e <= x))))


def resample(a: Column, size: int) -> Column:
    """Linear resampling to ``size`` points; an array of that size is unchanged."""
    last = F.size(a) - 1

    def point(i: Column) -> Column:
        at = i * last / F.lit(float(max(1, size - 1)))
        low = F.floor(at).cast("int")
        x = F.element_at(a, low + 1)
        y = F.element_at(a, F.least(low + 2, F.size(a)))
        return x + (y - x) * (at - low)

    return F.when(F.size(a) == size, a).otherwise(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), point))
