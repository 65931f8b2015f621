"""Contour-integrated principal components and whitening against dense solvers and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barframe.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component string"


def spectrum(kind, d=48):
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    if kind == "random":
        a = rng.standard_normal((d, 2 * d))
        return a @ a.T / d
    values = {
        "equal": np.ones(d), "clustered": np.r_[np.full(10, 3.0), np.full(20, 1 + 1e-12), np.linspace(0.1, 0.5, d - 30)],
        "wide": 10.0 ** -np.linspace(0, 9, d), "few": np.r_[np.arange(7, 0, -1.0), np.zeros(d - 7)], "pairs": np.repeat(np.arange(d // 2, 0, -1.0), 2),
    }[kind]
    out = turn @ np.diag(values) @ turn.T
    return (out + out.T) / 2


@pytest.mark.parametrize("kind", ["random", "equal", "clustered", "wide", "few", "pairs"])
def test_intervals_hold_all_large_eigenvalues(kind):
    cov = spectrum(kind)
    found = whitening.intervals(cov, 32)
    parts = [whitening.feast(cov, *i) for i in found]
    values = np.sort(np.concatenate([v for v, _ in parts]))[::-1]
    vectors = np.hstack([v for _, v in parts])
    exact = np.linalg.eigvalsh(cov)[::-1]
    assert len(values) >= 32 and all(a[0] >= b[1] for a, b in zip(found, found[1:]))
    assert np.abs(values[:32] - exact[:32]).max() < 1e-13 * exact[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-8


@pytest.mark.parametrize("values", [np.r_[700.0, np.linspace(75, 55, 63)], np.r_[1e6, 700, np.linspace(70, 60, 200)]])
def test_an_eigenvalue_far_above_many_close_ones(values):
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))[0]
    cov = turn @ np.diag(values) @ turn.T
    cov = (cov + cov.T) / 2
    found = np.sort(np.concatenate([whitening.feast(cov, *i)[0] for i in whitening.intervals(cov, 32)]))[::-1]
    assert np.abs(found[:32] - values[:32]).max() < 1e-13 * values[0]


def test_inertia_counts():
    cov = spectrum("random")
    exact = np.linalg.eigvalsh(cov)
    shifts = np.r_[exact - 1e-9, exact + 1e-9, -1, 100]
    assert (whitening.count_above(*whitening.tridiagonal(cov), shifts) == (exact[None] > shifts[:, None]).sum(axis=1)).all()


def test_a_missed_eigenvalue_is_noticed():
    with pytest.raises(ArithmeticError):
        whitening.feast(np.diag([5.0, 4.0, 1.0]), 3.5, 6.0, 3)


def plain(rows, k):
    """{row: (deviation, whitened per component)}, explained: from exact integers and a dense solver."""
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[j] for x in xs) for j in range(d)]
    exact = [[n * x[j] - sums[j] for j in range(d)] for x in xs]
    centred = np.array([[float(e) / n for e in r] for r in exact])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [sum(e * e for e in r) for r in exact], centred @ vectors / np.sqrt(values), values / np.trace(cov)


def compare(found, ids, rows, k):
    deviation, white, explained = plain(rows, k)
    got = {(r.vec_id, r.component): r for r in found}
    assert len(found) == len(rows) * len(explained) and {r.n for r in found} == {len(rows)}
    for c in range(len(explained)):
        ours = np.array([got[i, c + 1].whitened for i in ids])
        assert min(np.abs(ours - white[:, c]).max(), np.abs(ours + white[:, c]).max()) < 1e-6
        assert abs(got[ids[0], c + 1].explained / explained[c] - 1) < 1e-9
    assert [got[i, 1].deviation for i in ids] == [x if x < 2**63 else None for x in deviation]
    assert {r.identity_error for r in found}.pop() < 1e-6


def test_whole_result_and_edges(spark):
    rng = np.random.default_rng(2)
    rows = (rng.standard_normal((150, 6)) * [9, 5, 3, 2, 1, 0.5] + 2).tolist()
    rows[7] = rows[8]
    good = [(k, v, 1, "x") for k, v in enumerate(rows)]
    bad = [(1000, None, 1, "x"), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "x"), (1002, [float("nan")] * 6, 1, "x"), (1003, [float("inf")] + [0.0] * 5, 1, "x")]
    bad += [(1004, [], 1, "x"), (1005, [1.0, 2.0], 1, "x"), (1006, [1e300] * 6, 1, "x")]
    docs = spark.createDataFrame(good + bad, SCHEMA).repartition(4)
    compare(whitening.whiten(docs, 4).collect(), list(range(150)), rows, 4)
    compare(whitening.whiten(docs, 32).collect(), list(range(150)), rows, 6)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = (rng.standard_normal((40, 3)) * [2.0**48, 2.0**20, 3]).tolist()
    docs = spark.createDataFrame([(k, v, 0, "") for k, v in enumerate(rows)], SCHEMA)
    found = whitening.whiten(docs, 1).collect()
    deviation = plain(rows, 1)[0]
    assert {r.vec_id: r.deviation for r in found} == {k: x if x < 2**63 else None for k, x in enumerate(deviation)}


def test_no_vectors_equal_vectors_and_null_ids(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (1, [1.0, 2.0], 0, "")], SCHEMA)
    assert whitening.whiten(docs).count() == 0
    assert whitening.whiten(docs.filter(F.lit(False))).count() == 0
    docs = spark.createDataFrame([(None, [1.0, 2.0], 0, ""), (None, [3.0, 2.0], 0, ""), (3, [5.0, 7.0], 0, "")], SCHEMA)
    found = whitening.whiten(docs, 1).collect()
    assert sorted(str(r.vec_id) for r in found) == ["3", "None", "None"]
    assert sum(r.whitened**2 for r in found) == pytest.approx(3)
