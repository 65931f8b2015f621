"""Ordered series at scale: positions, row frames, running totals, exponential averages.

A window over ``partitionBy(pair, interval)`` puts a whole series into one task, and one series may
hold a third of all rows. The functions here cut every series into blocks of bounded size instead:

* ``with_position`` numbers rows by counting per time slot and prefix-summing the slot counts;
* ``over_rows`` evaluates ROWS frames per position block, copying only the few neighbouring rows
  ("halo") a frame reaches into;
* ``running`` carries sums, products, minima and maxima from block to block;
* ``ema`` evaluates recursive averages with the finite memory they have in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barframe.schema import SERIES, TS, interval_ms

BLOCK_ROWS = 8192
SLOT_ROWS = 65_536
_SUB = 256  # rows per sub-block of an exponential average
_FORGET = math.log(2.0**80)


# --------------------------------------------------------------------------- prefix over blocks
_COMBINE: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "product": (F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * b),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def block_prefix(
    blocks: DataFrame, by: Sequence[str], block: str, ops: dict[str, str], totals: dict[str, str] | None = None
) -> DataFrame:
    """Add, for each column in ``ops``, its combination over all earlier blocks (``<col>_before``).

    ``blocks`` holds one small row per block of thousands of rows, so even a series of 10^11 rows
    comes to a few million rows here, which one task streams through in order. ``totals`` adds
    series-wide sums: ``{new column: summed column}``.
    """
    series = Window.partitionBy(*by)
    earlier = series.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    neutral = {"sum": F.lit(0), "product": F.lit(1.0)}
    before = {}
    for c, op in ops.items():
        value = _COMBINE[op][0](F.col(c)).over(earlier)
        before[f"{c}_before"] = F.coalesce(value, neutral[op]) if op in neutral else value
    for new, c in (totals or {}).items():
        before[new] = F.sum(c).over(series)
    return blocks.withColumns(before)


# --------------------------------------------------------------------------- positions
def _span_ms(df: DataFrame, span_ms: int | None, rows: int) -> Column:
    if span_ms is not None:
        return F.lit(span_ms)
    if "interval" in df.columns:
        return F.coalesce(interval_ms(F.col("interval")), F.lit(3_600_000)) * rows
    return F.lit(3_600_000 * rows)


def with_position(
    df: DataFrame,
    by: Sequence[str] = SERIES,
    ts: str = TS,
    pos: str = "pos",
    total: str | None = "n_rows",
    order: Sequence[str] = (),
    span_ms: int | None = None,
    rows: int = SLOT_ROWS,
) -> DataFrame:
    """Number each series' rows from 0 in time order and attach the series length.

    Rows are numbered inside time slots (``rows`` bars long unless ``span_ms`` is given) and shifted
    by the count of all earlier slots. Work per task is one slot, however long the series. ``order``
    breaks ties between rows of the same time. Having position *and* length on the row makes
    walk-forward folds, phases and tail splits plain projections.
    """
    by = list(by)
    slotted = df.withColumn("_slot", F.floor(F.unix_millis(F.col(ts)) / _span_ms(df, span_ms, rows)))
    counts = slotted.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_c"))
    offsets = block_prefix(counts, by, "_slot", {"_c": "sum"}, {total: "_c"} if total else None).drop("_c")
    local = Window.partitionBy(*by, "_slot").orderBy(ts, *order)
    numbered = slotted.withColumn("_r", F.row_number().over(local))
    out = numbered.join(offsets, [*by, "_slot"])
    return out.withColumn(pos, (F.col("_r") - 1 + F.col("_c_before")).cast("long")).drop("_slot", "_r", "_c_before")


# --------------------------------------------------------------------------- row frames
class Frame:
    """The window of one position block; hands out row frames and exponential averages."""

    def __init__(self, by: Sequence[str], pos: str):
        self.by, self.pos = list(by), pos
        self.order: WindowSpec = Window.partitionBy(*self.by, "_blk").orderBy("_sub", pos)
        self.sub: WindowSpec = Window.partitionBy(*self.by, "_blk", "_sub").orderBy(pos)
        self.subs: WindowSpec = Window.partitionBy(*self.by, "_blk").orderBy("_sub")

    def rows(self, before: int, after: int = 0) -> WindowSpec:
        return self.order.rowsBetween(-before, after)

    def full(self, width: int, value: Column) -> Column:
        """``value`` only where the last ``width`` rows exist."""
        return F.when(F.count(F.lit(1)).over(self.rows(width - 1)) == width, value)

    def lag(self, col: str | Column, k: int = 1) -> Column:
        return F.lag(col, k).over(self.order)

    def lead(self, col: str | Column, k: int = 1) -> Column:
        return F.lead(col, k).over(self.order)


def over_rows(
    df: DataFrame,
    build: Callable[[Frame], dict[str, Column]] | Sequence[Callable[[Frame], dict[str, Column]]],
    before: int = 0,
    after: int = 0,
    by: Sequence[str] = SERIES,
    pos: str = "pos",
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns computed over ROWS frames reaching ``before`` rows back and ``after`` ahead.

    One shuffle by (series, block of ``block`` positions). Each block also receives copies of the
    neighbouring rows its frames reach into, so results equal those of one window over the series.
    ``build`` may be a list of steps; later steps can use columns of earlier ones.
    """
    by = list(by)
    block = max(block, before, after, 1)
    steps = [build] if callable(build) else list(build)
    own = F.floor(F.col(pos) / block)
    inside = F.col(pos) % block
    targets = [own]
    if before:
        targets.append(F.when(inside >= block - before, own + 1))
    if after:
        targets.append(F.when(inside < after, own - 1))
    if len(targets) == 1:
        copied = df.withColumn("_blk", own)
    else:
        copied = df.withColumn("_blk", F.explode(F.array_compact(F.array(*targets))))
    copied = copied.withColumn("_sub", F.floor(F.col(pos) / _SUB))
    frame = Frame(by, pos)
    for step in steps:
        copied = copied.withColumns(step(frame))
    return copied.filter(F.col("_blk") == own).drop("_blk", "_sub")


# --------------------------------------------------------------------------- rolling statistics
def _chain(widths: Sequence[int]) -> list[tuple[int, list[int]]]:
    """Widths in build order, each with the earlier widths it is put together from (1 = the value itself)."""
    have, out = [1], []
    for target in sorted(set(widths)):
        while target > 8 * have[-1]:
            out.append((have[-1] * 5, [have[-1]] * 5))
            have.append(have[-1] * 5)
        parts, rest = [], target
        for w in reversed(have):
            parts += [w] * (rest // w)
            rest %= w
        if target > 1:
            out.append((target, parts))
            have.append(target)
    return out


class Rolling:
    """Mean, spread and extremes of one column over full windows of several widths.

    A window is put together from smaller, already computed ones with ``lag`` (20 = 10 + 10 rows
    back), so a row costs a few steps instead of a pass over its window. Squared deviations are pooled
    from the parts and the distances of their means: a flat window has a spread of exactly 0. A null in a window makes the result null.
    """

    def __init__(self, name: str, x: str, widths: Sequence[int], extremes: bool = False, spread: bool = True):
        self.name, self.x, self.extremes, self.spread = name, x, extremes, spread
        self.steps = [self._step(w, parts) for w, parts in _chain(widths)]

    def _col(self, kind: str, w: int) -> str:
        return self.x if w == 1 and kind != "q" else f"_{self.name}_{kind}{w}"

    def _step(self, width: int, parts: list[int]) -> Callable[[Frame], dict[str, Column]]:
        def build(f: Frame) -> dict[str, Column]:
            offsets = [sum(parts[:i]) for i in range(len(parts))]

            def each(kind: str) -> list[Column]:
                return [F.col(self._col(kind, w)) if o == 0 else f.lag(self._col(kind, w), o) for w, o in zip(parts, offsets)]

            means = each("m")
            share = [w / width for w in parts]
            out = {f"_{self.name}_m{width}": sum((m * s for m, s in zip(means[1:], share[1:])), means[0] * share[0])}
            if self.spread:
                # sum of squared deviations = those inside the parts + pairwise distances of the part means
                inner = [] if max(parts) == 1 else [c for c, w in zip(each("q"), parts) if w > 1]
                gaps = [
                    (means[i] - means[j]) * (means[i] - means[j]) * (parts[i] * parts[j] / width)
                    for i in range(len(parts)) for j in range(i + 1, len(parts))
                ]
                terms = inner + gaps
                out[f"_{self.name}_q{width}"] = sum(terms[1:], terms[0])
            if self.extremes:
                for kind, pick in (("lo", F.least), ("hi", F.greatest)):
                    ends = each(kind)
                    complete = ends[0].isNotNull()
                    for end in ends[1:]:
                        complete = complete & end.isNotNull()
                    out[f"_{self.name}_{kind}{width}"] = F.when(complete, pick(*ends))
            return out

        return build

    def mean(self, w: int) -> Column:
        return F.col(self._col("m", w))

    def low(self, w: int) -> Column:
        return F.col(self._col("lo", w))

    def high(self, w: int) -> Column:
        return F.col(self._col("hi", w))

    def std(self, w: int, ddof: int = 0) -> Column:
        return F.sqrt(F.col(self._col("q", w)) / float(w - ddof))


# --------------------------------------------------------------------------- exponential averages
def ema_memory(alpha: float) -> int:
    """Rows after which ``(1 - alpha)^rows`` falls below 2^-80, i.e. out of double precision."""
    if alpha >= 1.0:
        return 1
    return math.ceil(_FORGET / -math.log1p(-alpha))


def _sub_weighted(frame: Frame, x: Column, alpha: float) -> tuple[Column, Column]:
    """(local average inside the sub-block, weight of the state entering it) at each row."""
    q = 1.0 - alpha
    k = F.col(frame.pos) % _SUB
    first = x.isNotNull() & F.lag(x, 1).over(frame.order).isNull()
    gain = F.when(first, x).otherwise(x * alpha)
    weighted = F.sum(gain * F.pow(F.lit(q), -k.cast("double"))).over(
        frame.sub.rowsBetween(Window.unboundedPreceding, 0)
    )
    return weighted * F.pow(F.lit(q), k.cast("double")), F.pow(F.lit(q), (k + 1).cast("double"))


def ema_steps(name: str, x: str, alpha: float, min_periods: int = 0) -> list[Callable[[Frame], dict[str, Column]]]:
    """Steps for ``over_rows`` computing ``y0 = x0; y = a x + (1-a) y[-1]`` over column ``x``.

    The average inside a sub-block of 256 positions is a prefix sum of ``x`` scaled by powers of
    ``1-a``; the state entering it is the decayed sum of the averages at the ends of the sub-blocks
    before, reached with RANGE frames on the sub-block number. Nulls may stand at the head of the
    series only. Everything runs on the one sort of ``over_rows``; ``before`` must be at least
    ``ema_memory(alpha)``, beyond which a state's weight is below 2^-80 and cannot change a double.
    """
    if alpha >= 1.0:
        return [lambda frame: {name: F.col(x)}]
    q = 1.0 - alpha
    if -math.log(q) * _SUB > 700.0:
        raise ValueError(f"alpha {alpha} decays too fast for sub-blocks of {_SUB} rows")
    reach = max(1, math.ceil(ema_memory(alpha) / _SUB))

    def local(frame: Frame) -> dict[str, Column]:
        average, weight = _sub_weighted(frame, F.col(x), alpha)
        return {f"_{name}_loc": average, f"_{name}_w": weight}

    def carried(frame: Frame) -> dict[str, Column]:
        end = F.when(F.col(frame.pos) % _SUB == _SUB - 1, F.col(f"_{name}_loc"))
        state = F.lit(0.0)
        for j in range(1, reach + 1):
            back = F.sum(end).over(frame.subs.rangeBetween(-j, -j))
            state = state + F.coalesce(back, F.lit(0.0)) * (q ** (_SUB * (j - 1)))
        value = F.coalesce(F.col(f"_{name}_loc"), F.lit(0.0)) + F.col(f"_{name}_w") * state
        seen = F.col(x).isNotNull()
        if min_periods > 1:
            seen = F.count(x).over(frame.rows(min_periods - 1)) >= min_periods
        return {name: F.when(seen, value)}

    return [local, carried]


def with_ema(
    df: DataFrame,
    col: str,
    alpha: float | None = None,
    span: float | None = None,
    min_periods: int = 0,
    name: str | None = None,
    by: Sequence[str] = SERIES,
    pos: str = "pos",
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Recursive exponential average of ``col`` (give ``alpha`` or ``span``)."""
    if (alpha is None) == (span is None):
        raise ValueError("give either alpha or span")
    alpha = alpha if alpha is not None else 2.0 / (span + 1.0)
    name = name or f"ema_{col}"
    out = over_rows(df, ema_steps(name, col, alpha, min_periods), before=ema_memory(alpha), by=by, pos=pos, block=block)
    return out.drop(f"_{name}_loc", f"_{name}_w")


# --------------------------------------------------------------------------- running totals
def running(
    df: DataFrame,
    outputs: dict[str, tuple[str, Column]],
    by: Sequence[str] = SERIES,
    pos: str = "pos",
    block: int = BLOCK_ROWS,
    exclusive: bool = False,
) -> DataFrame:
    """Cumulative ``sum`` / ``product`` / ``min`` / ``max`` from the series start to each row.

    ``outputs`` maps new column -> (operation, value). Running values inside each block are combined
    with the value carried from all earlier blocks. ``exclusive`` leaves the current row out.
    """
    by = list(by)
    values = {f"_v{i}": value for i, (_, value) in enumerate(outputs.values())}
    ops = {f"_v{i}": op for i, (op, _) in enumerate(outputs.values())}
    base = df.withColumns({**values, "_blk": F.floor(F.col(pos) / block)})
    totals = base.groupBy(*by, "_blk").agg(*[_COMBINE[op][0](F.col(v)).alias(v) for v, op in ops.items()])
    carry = block_prefix(totals, by, "_blk", ops).drop(*ops)
    end = -1 if exclusive else 0
    w = Window.partitionBy(*by, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, end)
    local = base.withColumns({f"_l{v}": _COMBINE[op][0](F.col(v)).over(w) for v, op in ops.items()})
    joined = local.join(carry, [*by, "_blk"])
    result = {}
    for (name, (op, _)), v in zip(outputs.items(), ops):
        before, here = F.col(f"{v}_before"), F.col(f"_l{v}")
        if op == "sum":
            result[name] = before + F.coalesce(here, F.lit(0))
        elif op == "product":
            result[name] = before * F.coalesce(here, F.lit(1.0))
        else:
            result[name] = _COMBINE[op][1](before, here)
    return joined.withColumns(result).drop("_blk", *ops, *[f"_l{v}" for v in ops], *[f"{v}_before" for v in ops])
