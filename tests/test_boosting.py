"""Boosted trees by histograms: one task, many tasks and a plain version make the same trees."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barframe.operators import boosting as B
from barframe.operators import models as M
from barframe.schema import SERIES, TS

SMALL = B.Boosting(rounds=6, depth=3, rate=0.3, bins=16, seed=3)


def data(n, seed, dim=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)), 2)
    x[:, -1] = 1.0  # an input without borders to split at
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-2 * x[:, 0] * (x[:, 1] > 0) + x[:, 2]))).astype(int)
    return x, y


def plain(bins, y, rows, o):
    """(margins, trees) by walking over nodes, inputs and bins one after the other."""
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    margin, trees = np.full(len(y), np.log(rate / (1 - rate))), []
    for t in range(o.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        used = B._rows_of(rows, t, o)
        inputs = B._inputs_of(t, bins.shape[1], o)

        def grow(at, depth):
            inside = at & used
            node = {"value": -g[inside].sum() / (h[inside].sum() + o.l2)}
            best = None
            for f in inputs if depth < o.depth else ():
                for b in range(o.bins - 1):
                    left = inside & (bins[:, f] <= b)
                    right = inside & ~left
                    hl, hr = h[left].sum(), h[right].sum()
                    if hl < o.least or hr < o.least:
                        continue
                    score = [a[k].sum() ** 2 / (c[k].sum() + o.l2) for k in (left, right, inside) for a, c in [(g, h)]]
                    gain = round(score[0] + score[1] - score[2], 8)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, b)
            if best:
                _, f, b = best
                node |= {"split": (int(f), b), "left": grow(at & (bins[:, f] <= b), depth + 1), "right": grow(at & (bins[:, f] > b), depth + 1)}
            else:
                margin[at] += o.rate * node["value"]
            return node

        trees.append(grow(np.ones(len(y), bool), 0))
    return margin, trees


def same(node, trees, t, at=0):
    assert trees.values[t, at] == pytest.approx(node["value"], rel=1e-9, abs=1e-12)
    if "split" not in node:
        assert trees.feats[t, at] == -1
        return
    assert (trees.feats[t, at], trees.cuts[t, at]) == node["split"]
    same(node["left"], trees, t, 2 * at + 1)
    same(node["right"], trees, t, 2 * at + 2)


def test_trees_equal_the_plain_version():
    x, y = data(400, 1)
    bins = np.stack([np.searchsorted(np.unique(np.quantile(x[:, i], np.arange(1, 16) / 16)), x[:, i]) for i in range(5)], axis=1).astype(np.uint8)
    rows = np.arange(400) * 7
    base, trees = B.fit_rows(bins, y.astype(float), rows, SMALL)
    margin, wanted = plain(bins, y, rows, SMALL)
    for t, node in enumerate(wanted):
        same(node, trees, t)
    np.testing.assert_allclose(base + trees.margin(bins, range(SMALL.rounds), SMALL), margin, rtol=1e-9)
    assert any(trees.feats[t].max() >= 0 for t in range(SMALL.rounds))


def frame(spark, sizes):
    rows = []
    for k, (pair, n) in enumerate(sizes):
        x, y = data(n, k)
        rows += [(pair, "1h", datetime(2024, 1, 1) + timedelta(hours=i), i, n, n // 2, max(1, (n - n // 2) // 3), 3, int(y[i]), 0.0, *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, f"pair string, interval string, {TS} timestamp, row long, n long, initial long, test long, n_folds long, y long, next_ret double, a double, b double, c double, d double, e double").repartition(5)


def test_groups_beyond_a_task_get_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(B, "STORED", 2)
    monkeypatch.setattr(B, "BLOCK", 64)
    monkeypatch.setattr(B, "TOGETHER", 3)
    ds = frame(spark, [("A", 300), ("B", 120), ("C", 90)])

    def probabilities(in_task):
        preds = M.boosted_trees(ds, list("abcde"), options=SMALL, in_task=in_task)
        return {(r["pair"], r["fold"], r[TS]): r["y_prob"] for r in preds.collect()}

    one, many, mixed = probabilities(10_000), probabilities(0), probabilities(100)
    assert one.keys() == many.keys() == mixed.keys() and len({k[:2] for k in one}) >= 6
    for k, v in one.items():
        assert many[k] == pytest.approx(v, rel=1e-9) and mixed[k] == pytest.approx(v, rel=1e-9)


def test_trees_learn_and_one_class_gives_its_rate(spark):
    ds = frame(spark, [("A", 3000)])
    preds = M.boosted_trees(ds, list("abcde"), options=B.Boosting(rounds=60)).toPandas()
    loss = -np.log(np.where(preds.y_true == 1, preds.y_prob, 1 - preds.y_prob)).mean()
    assert (preds.y_true == preds.y_pred).mean() > 0.65 and loss < 0.62
    flat = M.boosted_trees(ds.withColumn("y", F.lit(1).cast("long")), list("abcde"), options=SMALL, max_folds=1).toPandas()
    assert (flat.y_prob > 0.999).all() and flat.fold.max() == 0
    assert M.boosted_trees(ds.limit(0), list("abcde"), options=SMALL).count() == 0
    assert preds.groupby(list(SERIES)).size().iloc[0] == len(preds.drop_duplicates([TS]))
