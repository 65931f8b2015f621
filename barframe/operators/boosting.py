"""Gradient-boosted trees of all series and folds at once, on binned inputs.

A level of all trees is one histogram: sums of gradients and Hessians per (series, fold, node, input, bin). A series and
fold of up to ``in_task`` rows grows its trees in one task, all such groups in parallel in one job; larger ones share
a job per level, in which tasks sum their rows' histograms. Both make the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.operators.tables import spread_join
from barframe.schema import SERIES
from barframe.session import materialise

KEY = [*SERIES, "fold"]
BLOCK = 1 << 18  # rows scored together
STORED = 25  # rounds after which rows of large groups store their margins
TOGETHER = 64  # large groups that advance together; their trees are what the driver holds
MODEL_SQL = "pair string, interval string, fold long, base double, feats array<int>, cuts array<int>, values array<double>"
_U = np.uint64


@dataclass(frozen=True)
class Boosting:
    rounds: int = 400
    depth: int = 5
    rate: float = 0.05
    subsample: float = 0.8  # share of rows in a round, by a hash
    columns: float = 0.8  # share of inputs in a round
    l2: float = 1.0
    least: float = 1.0  # sum of Hessians in a child
    bins: int = 64
    seed: int = 0

    @property
    def nodes(self) -> int:
        return (2 << self.depth) - 1


def _rows_of(rows: np.ndarray, t: int, o: Boosting) -> np.ndarray:
    x = rows.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15) + _U((t + 1) * 0xC2B2AE3D27D4EB4F + o.seed & (1 << 64) - 1)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return (x ^ (x >> _U(32))) < _U(min(int(o.subsample * 2.0**64), (1 << 64) - 1))


def _inputs_of(t: int, dim: int, o: Boosting) -> np.ndarray:
    return np.sort(np.random.default_rng([o.seed, t]).permutation(dim)[: max(1, int(o.columns * dim))])


def _gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 0.5 * (1.0 + np.tanh(0.5 * margin))
    return p - y, np.maximum(p * (1.0 - p), 1e-16)


def _histogram(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, n_nodes: int, o: Boosting) -> np.ndarray:
    """(node, input, bin, 2): sums of g and h."""
    width = bins.shape[1]
    cell = ((node[:, None] * width + np.arange(width)) * o.bins + bins).ravel()
    shape = (n_nodes, width, o.bins)
    sums = [np.bincount(cell, np.repeat(v, width), n_nodes * width * o.bins).reshape(shape) for v in (g, h)]
    return np.stack(sums, axis=-1)


class _Trees:
    """Trees as complete heaps: input and last bin to the left of each node (input -1: a leaf), value of each node."""

    def __init__(self, o: Boosting, rounds: int):
        self.feats = np.full((rounds, o.nodes), -1, np.int32)
        self.cuts = np.zeros((rounds, o.nodes), np.int32)
        self.values = np.zeros((rounds, o.nodes))

    def split(self, t: int, level: int, hist: np.ndarray, inputs: np.ndarray, o: Boosting) -> bool:
        """Splits the nodes of a level where that pays; ties go to the first input and bin."""
        total = hist[:, 0].sum(axis=1)
        left = np.cumsum(hist, axis=2)[:, :, :-1]
        right = total[:, None, None] - left

        def score(s: np.ndarray) -> np.ndarray:
            return s[..., 0] ** 2 / (s[..., 1] + o.l2)

        gain = score(left) + score(right) - score(total)[:, None, None]
        fits = (left[..., 1] >= o.least) & (right[..., 1] >= o.least)
        gain = np.where(fits, np.round(gain, 8), -1.0).reshape(len(hist), -1)  # rounded: sums in another order tie as well
        best = gain.argmax(axis=1)
        first = (1 << level) - 1
        if level == 0:
            self.values[t, 0] = -total[0, 0] / (total[0, 1] + o.l2)
        for k in np.flatnonzero(gain[np.arange(len(best)), best] > 0).tolist():
            f, b = divmod(int(best[k]), o.bins - 1)
            at = first + k
            self.feats[t, at], self.cuts[t, at] = inputs[f], b
            for child, s in ((2 * at + 1, left[k, f, b]), (2 * at + 2, right[k, f, b])):
                self.values[t, child] = -s[0] / (s[1] + o.l2)
        return bool((self.feats[t, first : first + len(hist)] >= 0).any())

    def step(self, t: int, node: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Nodes one level down; those at a leaf stay."""
        feat = self.feats[t][node]
        go = bins[np.arange(len(node)), np.maximum(feat, 0)] > self.cuts[t][node]
        return np.where(feat >= 0, 2 * node + 1 + go, node)

    def margin(self, bins: np.ndarray, rounds: range, o: Boosting) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in rounds:
            node = np.zeros(len(bins), np.int64)
            for _ in range(o.depth):
                node = self.step(t, node, bins)
            out += o.rate * self.values[t][node]
        return out


def _base(y: np.ndarray) -> float:
    rate = min(max(float(np.mean(y)), 1e-6), 1 - 1e-6)
    return float(np.log(rate / (1 - rate)))


def fit_rows(bins: np.ndarray, y: np.ndarray, rows: np.ndarray, o: Boosting) -> tuple[float, _Trees]:
    """(base margin, trees) of one group held in memory."""
    base, trees = _base(y), _Trees(o, o.rounds)
    margin = np.full(len(y), base)
    for t in range(o.rounds):
        g, h = _gradients(margin, y)
        used, inputs = np.flatnonzero(_rows_of(rows, t, o)), _inputs_of(t, bins.shape[1], o)
        some, node = bins[np.ix_(used, inputs)].astype(np.int64), np.zeros(len(y), np.int64)
        for level in range(o.depth):
            first = (1 << level) - 1
            live = np.flatnonzero(node[used] >= first)
            at = used[live]
            hist = _histogram(some[live], node[at] - first, g[at], h[at], 1 << level, o)
            if not trees.split(t, level, hist, inputs, o):
                break
            node = trees.step(t, node, bins)
        margin += o.rate * trees.values[t][node]
    return base, trees


# --------------------------------------------------------------------------- groups
def edges(train: DataFrame, dim: int, o: Boosting) -> DataFrame:
    """Borders of the bins, ``edges`` (one list per input), from the quantiles of each group's training rows."""
    levels = F.array(*[F.lit(k / o.bins) for k in range(1, o.bins)])
    found = train.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_train"), *[F.percentile_approx(F.col("x")[i], levels, F.lit(10_000)).alias(f"q{i}") for i in range(dim)])
    return found.select(*KEY, "n_train", F.array(*[F.array_sort(F.array_distinct(f"q{i}")) for i in range(dim)]).alias("edges"))


def _binned(x: pa.Array, borders: Sequence[Sequence[float]]) -> np.ndarray:
    x = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(borders))
    return np.stack([np.searchsorted(np.array(b, float), x[:, i]) for i, b in enumerate(borders)], axis=1).astype(np.uint8)


def _key_of(table: pa.Table) -> list:
    return [table.column(c)[0].as_py() for c in KEY]


def _fit_group(o: Boosting):
    def run(rows: pa.Table, borders: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        base, trees = fit_rows(_binned(rows.column("x"), borders.column("edges")[0].as_py()), rows.column("y").to_numpy().astype(float), rows.column("row").to_numpy(), o)
        return _models([(_key_of(rows), base, trees)])

    return run


def _models(fitted: list) -> pa.Table:
    columns = [[k[i] for k, _, _ in fitted] for i in range(3)] + [[b for _, b, _ in fitted]]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.float64()]
    lists = [pa.array([getattr(t, c).ravel() for _, _, t in fitted], pa.list_(k)) for c, k in (("feats", pa.int32()), ("cuts", pa.int32()), ("values", pa.float64()))]
    return pa.table([*[pa.array(c, k) for c, k in zip(columns, kinds)], *lists], [*KEY, "base", "feats", "cuts", "values"])


def _bin_group(rows: pa.Table, borders: pa.Table) -> pa.Table:
    if not rows.num_rows or not borders.num_rows:
        return pa.table([pa.array([], f) for f in (pa.int32(), pa.int64(), pa.float64(), pa.binary())], ["gid", "row", "y", "bins"])
    bins = _binned(rows.column("x"), borders.column("edges")[0].as_py())
    gid = pa.array([borders.column("gid")[0].as_py()] * len(bins), pa.int32())
    return pa.table([gid, rows.column("row"), rows.column("y").cast(pa.float64()), pa.array([b.tobytes() for b in bins], pa.binary())], ["gid", "row", "y", "bins"])


def _arrays(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, ...]:
    gid, row, y, margin = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
    return gid, row, y, np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, dim), margin


def _sum_level(shared, t: int, level: int, since: int, dim: int, o: Boosting):
    """Histograms of the level over a task's rows, the rows' margins taken from where they were stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sums, inputs = shared.value, {}, _inputs_of(t, dim, o)
        for b in batches:
            if not b.num_rows:
                continue
            gids, rows, y, bins, margins = _arrays(b, dim)
            for gid in np.unique(gids).tolist():
                at = np.flatnonzero((gids == gid) & _rows_of(rows, t, o))
                trees, own = forest[gid], bins[at]
                g, h = _gradients(margins[at] + trees.margin(own, range(since, t), o), y[at])
                node = np.zeros(len(at), np.int64)
                for _ in range(level):
                    node = trees.step(t, node, own)
                first = (1 << level) - 1
                live = np.flatnonzero(node >= first)
                hist = _histogram(own[np.ix_(live, inputs)].astype(np.int64), node[live] - first, g[live], h[live], 1 << level, o)
                sums[gid] = sums[gid] + hist if gid in sums else hist
        for gid, hist in sums.items():
            flat = hist.reshape(-1, 2)
            cell = np.flatnonzero(flat.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), gid, np.int32)), pa.array(cell), pa.array(flat[cell, 0]), pa.array(flat[cell, 1])], ["gid", "cell", "g", "h"])

    return run


def _store_margins(shared, rounds: range, dim: int, o: Boosting):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gids, _, _, bins, margins = _arrays(b, dim)
            out = margins.copy()
            for gid in np.unique(gids).tolist():
                at = np.flatnonzero(gids == gid)
                out[at] += shared.value[gid].margin(bins[at], rounds, o)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], ["gid", "row", "y", "bins", "margin"])

    return run


def _fit_large(train: DataFrame, borders: DataFrame, keys: list, dim: int, o: Boosting) -> list:
    """Trees of groups beyond a task, level by level together: [(key, base, trees)]."""
    spark, fitted = train.sparkSession, []
    schema = "gid int, row long, y double, bins binary"
    for lo in range(0, len(keys), TOGETHER):
        some = keys[lo : lo + TOGETHER]
        named = spark.createDataFrame([(*k, g) for g, k in enumerate(some)], "pair string, interval string, fold long, gid int")
        blocks = F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_train") / BLOCK))
        own = borders.join(F.broadcast(named), KEY).withColumn("blk", F.explode(blocks))
        spread = F.pmod(F.xxhash64(*KEY, "row"), F.floor(F.col("n_train") / BLOCK) + 1)
        parts = spread_join(train, own.select(*KEY, "n_train").distinct(), KEY).withColumn("blk", spread).drop("n_train")
        data = materialise(parts.groupBy(*KEY, "blk").cogroup(own.groupBy(*KEY, "blk")).applyInArrow(_bin_group, schema), "binned")
        rates = data.groupBy("gid").agg(F.avg("y").alias("rate")).collect()
        bases = {r.gid: _base(np.array([r.rate])) for r in rates}
        forest = {g: _Trees(o, o.rounds) for g in bases}
        start = F.element_at(F.create_map(*[F.lit(v) for g, b in bases.items() for v in (g, b)]), F.col("gid"))
        data, since = data.withColumn("margin", start), 0
        for t in range(o.rounds):
            if t - since == STORED:
                shared = spark.sparkContext.broadcast(forest)
                data = materialise(data.mapInArrow(_store_margins(shared, range(since, t), dim, o), f"{schema}, margin double"), "margins")
                since = t
            going = set(forest)
            for level in range(o.depth):
                shared = spark.sparkContext.broadcast(forest)
                width = len(_inputs_of(t, dim, o))
                cells = data.mapInArrow(_sum_level(shared, t, level, since, dim, o), "gid int, cell long, g double, h double")
                found = cells.groupBy("gid", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # TOGETHER * nodes * inputs * bins
                shared.unpersist()
                for gid, part in found.groupby("gid"):
                    hist = np.zeros(((1 << level) * width * o.bins, 2))
                    hist[part["cell"].to_numpy()] = part[["g", "h"]].to_numpy()
                    if gid in going and not forest[gid].split(t, level, hist.reshape(1 << level, width, o.bins, 2), _inputs_of(t, dim, o), o):
                        going.discard(gid)
                if not going:
                    break
        fitted += [(list(k), bases[g], forest[g]) for g, k in enumerate(some) if g in bases]
    return fitted


def fit(train: DataFrame, dim: int, o: Boosting = Boosting(), in_task: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(models, borders) of every (pair, interval, fold) in ``train`` (these and ``row, y, x array<double>`` of ``dim`` inputs)."""
    borders = materialise(edges(train, dim, o), "borders")
    small = borders.filter(F.col("n_train") <= in_task)
    rows = spread_join(train, small.select(*KEY), KEY)
    models = rows.groupBy(*KEY).cogroup(small.drop("n_train").groupBy(*KEY)).applyInArrow(_fit_group(o), MODEL_SQL)
    keys = [tuple(r) for r in borders.filter(F.col("n_train") > in_task).select(*KEY).orderBy(*KEY).collect()]  # each has more than in_task rows
    if keys:
        large = _models(_fit_large(train, borders.filter(F.col("n_train") > in_task), keys, dim, o))
        models = models.unionByName(train.sparkSession.createDataFrame(large, MODEL_SQL))
    return materialise(models, "trees"), borders


def score(rows: DataFrame, models: DataFrame, borders: DataFrame, keep: Sequence[str], o: Boosting = Boosting()) -> DataFrame:
    """``keep`` columns of ``rows`` (with the key and ``x``) and ``prob``; a block of rows meets its group's trees in a task."""
    many = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    sizes = rows.groupBy(*KEY).agg(many.alias("n_blk"))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c not in ("x", *KEY)]), F.col("n_blk")).cast("int")
    dealt = spread_join(rows, sizes, KEY).withColumn("blk", spread).drop("n_blk")
    held = models.join(borders.drop("n_train"), KEY).join(sizes, KEY).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1))).drop("n_blk")
    schema = dealt.select(*keep).withColumn("prob", F.lit(0.0)).schema

    def meet(some: pa.Table, model: pa.Table) -> pa.Table:
        out = some.select(list(keep))
        if not some.num_rows or not model.num_rows:
            return out.slice(0, 0).append_column("prob", pa.array([], pa.float64()))
        m, trees = model.to_pylist()[0], _Trees(o, o.rounds)
        for c in ("feats", "cuts", "values"):
            setattr(trees, c, np.array(m[c]).reshape(o.rounds, o.nodes))
        margin = m["base"] + trees.margin(_binned(some.column("x"), m["edges"]), range(o.rounds), o)
        return out.append_column("prob", pa.array(1.0 / (1.0 + np.exp(-margin))))

    return dealt.groupBy(*KEY, "blk").cogroup(held.groupBy(*KEY, "blk")).applyInArrow(meet, schema)
