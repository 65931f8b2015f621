"""Market regimes: a Gaussian hidden Markov model per series, fitted and decoded block by block.

A series is cut into blocks of rows. Blocks meet in small messages only: for every block the tasks
return a K x K matrix (from the state before the block to the state at its end); chaining those few
matrices gives each block its entry and exit, and a second pass finishes inside the blocks. So one
very long series is decoded exactly without ever being in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.operators.features import regime_inputs
from barframe.operators.series import with_position
from barframe.operators.tables import spread_join
from barframe.schema import SERIES, TS
from barframe.session import materialise

REGIME_BLOCK = 65_536
_FLOOR = 1e-12


@dataclass
class Hmm:
    """Parameters of one series' model, states in ascending order of mean return."""

    start: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    fit_rows: int
    converged: bool = False

    def log_density(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.mean[None]
        return -0.5 * (np.log(2 * np.pi * self.var)[None] + d * d / self.var[None]).sum(axis=2)


# --------------------------------------------------------------------------- one block, its rows cut into pieces that advance together
def _steps(x: np.ndarray, m: Hmm, first: bool, log: bool) -> tuple[np.ndarray, float]:
    """Step matrices of a block's rows as (pieces, length, K, K), and the sum of the row maxima taken out.

    Row t's matrix leads from the state before it to its own, weighted by its density. A series' first row leads from
    anywhere to the start distribution. The block is padded with steps that change nothing. About sqrt(n) pieces of
    sqrt(n) rows advance together, so a pass takes sqrt(n) array operations.
    """
    density = m.log_density(x)
    top = density.max(axis=1, keepdims=True)
    density = density - top
    n, k = density.shape
    length = max(1, math.isqrt(n))
    pieces = -(-n // length)
    tiny = np.log(np.maximum(m.trans, 1e-300))
    out = np.empty((pieces * length, k, k))
    out[:n] = tiny[None] + density[:, None, :]
    if first:
        out[0] = np.log(np.maximum(m.start, 1e-300)) + density[0]
    out[n:] = np.where(np.eye(k) > 0, 0.0, -np.inf)
    return (out if log else np.exp(out)).reshape(pieces, length, k, k), float(top.sum())


def _best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best-path product of log matrices: rows of ``a`` with columns of ``b``."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def _message(steps: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of the whole block, matrices of its pieces), scaled."""
    pieces = steps[:, 0]
    for t in range(1, steps.shape[1]):
        pieces = _best(pieces, steps[:, t]) if best else pieces @ steps[:, t]
        top = pieces.max(axis=(1, 2), keepdims=True)
        pieces = pieces - top if best else pieces / top
    whole = pieces[0]
    for piece in pieces[1:]:
        whole = _best(whole, piece) if best else whole @ piece
        whole = whole - whole.max() if best else whole / whole.max()
    return whole, pieces


def _forward(steps: np.ndarray, pieces: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state weights after every row, scales), from the weights before the block."""
    entries = [entry / entry.sum()]
    for piece in pieces[:-1]:
        a = entries[-1] @ piece
        entries.append(a / a.sum())
    a = np.array(entries)
    alpha, scale = np.empty(steps.shape[:3]), np.empty(steps.shape[:2])
    for t in range(steps.shape[1]):
        a = (a[:, None, :] @ steps[:, t])[:, 0]
        scale[:, t] = a.sum(axis=1)
        a = a / scale[:, t, None]
        alpha[:, t] = a
    return alpha, scale


def _backward(steps: np.ndarray, pieces: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Weights of what follows every row, given those after the block."""
    leaves = [leave / leave.sum()]
    for piece in pieces[:0:-1]:
        b = piece @ leaves[-1]
        leaves.append(b / b.sum())
    b = np.array(leaves[::-1])
    beta = np.empty(steps.shape[:3])
    for t in range(steps.shape[1] - 1, -1, -1):
        beta[:, t] = b
        b = (steps[:, t] @ b[:, :, None])[:, :, 0]
        b = b / b.sum(axis=1, keepdims=True)
    return beta


def _expect(x: np.ndarray, m: Hmm, first: bool = True, entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Sufficient statistics of one block, given the state weights before it and the weights of what follows."""
    n, k = len(x), len(m.start)
    entry = np.full(k, 1.0 / k) if entry is None else entry / entry.sum()
    steps, top = _steps(x, m, first, False)
    _, pieces = _message(steps, False)
    alpha, scale = _forward(steps, pieces, entry)
    beta = _backward(steps, pieces, np.ones(k) if leave is None else leave)
    alpha, beta, flat = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n], steps.reshape(-1, k, k)[:n]
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    moves = np.concatenate([entry[None], alpha[:-1]])[:, :, None] * flat * beta[:, None, :]
    moves /= moves.sum(axis=(1, 2), keepdims=True)
    return {
        "start": post[0] if first else np.zeros(k), "trans": moves[int(first):].sum(axis=0), "weight": post.sum(axis=0),
        "first": post.T @ x, "second": post.T @ (x * x), "loglik": np.array([np.log(scale.ravel()[:n]).sum() + top]),
    }


def _maximise(s: dict[str, np.ndarray], m: Hmm) -> Hmm:
    weight = np.maximum(s["weight"], _FLOOR)[:, None]
    mean = s["first"] / weight
    var = np.maximum(s["second"] / weight - mean * mean, _FLOOR)
    start = s["start"] / s["start"].sum()
    rows = s["trans"].sum(axis=1, keepdims=True)
    trans = np.where(rows > 0, s["trans"] / np.where(rows > 0, rows, 1.0), m.trans)
    return Hmm(start, trans, mean, var, m.fit_rows)


def _sorted(m: Hmm) -> Hmm:
    order = np.argsort(m.mean[:, 0], kind="stable")
    return Hmm(m.start[order], m.trans[np.ix_(order, order)], m.mean[order], m.var[order], m.fit_rows, m.converged)


def _fit_one(x: np.ndarray, m: Hmm, n_iter: int, tol: float) -> tuple[Hmm, list[float]]:
    """Expectation-maximisation of a series that is one block."""
    history: list[float] = []
    for _ in range(n_iter):
        stats = _expect(x, m)
        history.append(float(stats["loglik"][0]))
        if len(history) > 1 and history[-1] - history[-2] < tol:
            m.converged = True
            break
        m = _maximise(stats, m)
    return m, history


# --------------------------------------------------------------------------- starting point
def _starting_points(rows: DataFrame, k: int) -> dict[tuple[str, str], Hmm]:
    """Per series: states at the groups between the return quantiles of all fitting rows, sticky transitions.

    A group that equal returns leave empty starts at the mean of all rows. A series with fewer rows than states has no model.
    """
    levels = [(i + 1) / k for i in range(k - 1)]
    cuts = rows.groupBy(*SERIES).agg(F.percentile_approx("log_return", levels, 1 << 14).alias("_cuts"))
    grouped = spread_join(rows, cuts, SERIES).withColumn("_g", F.size(F.filter("_cuts", lambda c: c < F.col("log_return"))))
    sums = grouped.groupBy(*SERIES, "_g").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s_{c}") for c in _INPUTS], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in _INPUTS],
    )
    found: dict[tuple[str, str], list] = {}
    for r in sums.collect():  # k rows per series
        found.setdefault((r["pair"], r["interval"]), []).append(r)
    models = {}
    for series, groups in found.items():
        filled = np.array([r["_g"] for r in groups])
        n, s, q = np.zeros((k, 1)), np.zeros((k, len(_INPUTS))), np.zeros((k, len(_INPUTS)))
        n[filled, 0] = [r["n"] for r in groups]
        s[filled], q[filled] = ([[r[f"{kind}_{c}"] for c in _INPUTS] for r in groups] for kind in "sq")
        if n.sum() < k:
            continue
        total = [x.sum(axis=0) / n.sum() for x in (s, q)]
        fit_rows = int(n.sum())
        s, q, n = np.where(n > 0, s, total[0]), np.where(n > 0, q, total[1]), np.maximum(n, 1.0)
        mean = s / n
        spread = np.maximum(total[1] - total[0] * total[0], 0.0)
        var = np.maximum(q / n - mean * mean, _FLOOR) + 0.1 * spread + _FLOOR
        trans = np.full((k, k), 0.1 / max(1, k - 1))
        np.fill_diagonal(trans, 0.9)
        models[series] = Hmm(np.full(k, 1.0 / k), trans, mean, var, fit_rows)
    return models


# --------------------------------------------------------------------------- blocks of long series
_INPUTS = ("log_return", "vol")
_EDGES = "pair string, interval string, _blk long, entry array<double>, leave array<double>"


def _values(g: pd.DataFrame) -> np.ndarray:
    return g.sort_values("pos")[list(_INPUTS)].to_numpy()


def _messages(rows: DataFrame, models: dict[tuple[str, str], Hmm], best: bool) -> DataFrame:
    """The K x K matrix of every block."""

    def message(key, g: pd.DataFrame) -> pd.DataFrame:
        steps, _ = _steps(_values(g), models[(key[0], key[1])], key[2] == 0, best)
        return pd.DataFrame([[key[0], key[1], key[2], _message(steps, best)[0].ravel()]], columns=["pair", "interval", "_blk", "m"])

    return rows.groupBy(*SERIES, "_blk").applyInPandas(message, "pair string, interval string, _blk long, m array<double>")


def _edges(messages: DataFrame, k: int) -> DataFrame:
    """State weights before every block and weights of what follows it: one small row per block meets per series."""

    def chained(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_blk")
        mats = [np.array(v).reshape(k, k) for v in g["m"]]
        entry, leave = [np.full(k, 1.0 / k)], [np.ones(k)]
        for m in mats[:-1]:
            a = entry[-1] @ m
            entry.append(a / a.sum())
        for m in mats[:0:-1]:
            b = m @ leave[-1]
            leave.append(b / b.sum())
        return g[["pair", "interval", "_blk"]].assign(entry=entry, leave=leave[::-1])

    return messages.groupBy(*SERIES).applyInPandas(chained, _EDGES)


def _fit_blocks(rows: DataFrame, models: dict[tuple[str, str], Hmm], n_iter: int, tol: float) -> dict[tuple[str, str], Hmm]:
    """The same expectation-maximisation for series of several blocks.

    Per step every block sends its matrix, gets back the weights before and after it, and returns its statistics, which
    include the transition into it; Spark adds them up. The result is that of one block up to rounding.
    """
    models, last, active = dict(models), {}, set(models)
    k = len(next(iter(models.values())).start)
    schema = "pair string, interval string, name string, i int, value double"
    for _ in range(n_iter):
        if not active:
            break
        current = {s: models[s] for s in active}
        own = rows.filter(F.concat_ws("|", *SERIES).isin(["|".join(s) for s in active]))

        def statistics(key, g: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
            stats = _expect(_values(g), current[(key[0], key[1])], key[2] == 0, np.array(e["entry"].iloc[0]), np.array(e["leave"].iloc[0]))  # noqa: B023
            flat = [(key[0], key[1], name, i, v) for name, a in stats.items() for i, v in enumerate(a.ravel())]
            return pd.DataFrame(flat, columns=["pair", "interval", "name", "i", "value"])

        edges = _edges(_messages(own, current, False), k)
        parts = own.groupBy(*SERIES, "_blk").cogroup(edges.groupBy(*SERIES, "_blk")).applyInPandas(statistics, schema)
        gathered: dict[tuple[str, str], dict[str, dict[int, float]]] = {}
        for r in parts.groupBy(*SERIES, "name", "i").agg(F.sum("value").alias("value")).collect():  # about 30 numbers per series
            gathered.setdefault((r["pair"], r["interval"]), {}).setdefault(r["name"], {})[r["i"]] = r["value"]
        for series, named in gathered.items():
            flat = {name: np.array([v[i] for i in range(len(v))]) for name, v in named.items()}
            stats = {name: a.reshape(k, -1) if name in ("trans", "first", "second") else a for name, a in flat.items()}
            loglik = float(stats["loglik"][0])
            if series in last and loglik - last[series] < tol:
                models[series].converged = True
                active.discard(series)
                continue
            last[series] = loglik
            models[series] = _maximise(stats, models[series])
    return models


def fit_regimes(
    inputs: DataFrame, n_states: int = 3, vol_window: int = 24, train_frac: float = 0.5, n_iter: int = 200,
    tol: float = 1e-4, block: int = REGIME_BLOCK,
) -> dict[tuple[str, str], Hmm]:
    """Fit one model per series on its first ``max(8 vol_window, int(train_frac n))`` rows.

    ``inputs`` needs ``pos, n_rows, log_return, vol``. Series of one block are fitted side by side in one job, longer ones
    block by block with the same steps, so ``block`` changes the work per task and not the model. States are numbered by
    ascending mean return; ``converged`` tells whether the likelihood settled within ``n_iter`` steps.
    """
    wanted = F.least(F.col("n_rows"), F.greatest(F.lit(8 * vol_window), F.floor(F.col("n_rows") * F.lit(float(train_frac)))))
    rows = inputs.withColumn("_fit", wanted).filter(F.col("pos") < F.col("_fit"))
    points = _starting_points(rows, n_states)
    params = "pair string, interval string, start array<double>, trans array<double>, mean array<double>, var array<double>, converged boolean"

    def fit(key, g: pd.DataFrame) -> pd.DataFrame:
        columns = ["pair", "interval", "start", "trans", "mean", "var", "converged"]
        point = points.get((key[0], key[1]))
        if point is None:
            return pd.DataFrame(columns=columns)
        m, _ = _fit_one(_values(g), point, n_iter, tol)
        return pd.DataFrame([[key[0], key[1], m.start, m.trans.ravel(), m.mean.ravel(), m.var.ravel(), m.converged]], columns=columns)

    models = {}
    for r in rows.filter(F.col("_fit") <= block).groupBy(*SERIES).applyInPandas(fit, params).collect():  # one row per series
        point = points[(r["pair"], r["interval"])]
        trans, mean, var = (np.array(r[c]).reshape(n_states, -1) for c in ("trans", "mean", "var"))
        models[(r["pair"], r["interval"])] = Hmm(np.array(r["start"]), trans, mean, var, point.fit_rows, r["converged"])
    long = {s: m for s, m in points.items() if m.fit_rows > block}
    if long:
        blocks = rows.filter(F.col("_fit") > block).withColumn("_blk", F.floor(F.col("pos") / block))
        models.update(_fit_blocks(blocks, long, n_iter, tol))
    return {series: _sorted(m) for series, m in models.items()}


# --------------------------------------------------------------------------- decoding
def _ends(messages: DataFrame, k: int) -> DataFrame:
    """States before and at the end of every block on the best path."""

    def chained(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_blk")
        mats = [np.array(v).reshape(k, k) for v in g["m"]]
        scores = [np.zeros(k)]
        for m in mats:
            step = (scores[-1][:, None] + m).max(axis=0)
            scores.append(step - step.max())
        states = [int(np.argmax(scores[-1]))]
        for score, m in zip(scores[-2::-1], mats[::-1]):
            states.append(int(np.argmax(score + m[:, states[-1]])))
        states = states[::-1]
        one = np.eye(k)
        return g[["pair", "interval", "_blk"]].assign(entry=[one[s] for s in states[:-1]], leave=[one[s] for s in states[1:]])

    return messages.groupBy(*SERIES).applyInPandas(chained, _EDGES)


def _decode(x: np.ndarray, m: Hmm, first: bool, entry: int, leave: int) -> np.ndarray:
    """Best path through a block with known states before and at the end."""
    steps, _ = _steps(x, m, first, True)
    _, pieces = _message(steps, True)
    k = len(m.start)
    scores = [np.where(np.arange(k) == entry, 0.0, -np.inf)]
    for piece in pieces:
        step = (scores[-1][:, None] + piece).max(axis=0)
        scores.append(step - step.max())
    ends = [leave]
    for score, piece in zip(scores[-2:0:-1], pieces[:0:-1]):
        ends.append(int(np.argmax(score + piece[:, ends[-1]])))
    state, score = np.array(ends[::-1]), np.array(scores[:-1])
    back = np.empty(steps.shape[:3], dtype=np.int8)
    for t in range(steps.shape[1]):
        step = score[:, :, None] + steps[:, t]
        back[:, t] = step.argmax(axis=1)
        score = step.max(axis=1)
        score = score - score.max(axis=1, keepdims=True)
    path = np.empty(steps.shape[:2], dtype=np.int64)
    every = np.arange(len(path))
    for t in range(steps.shape[1] - 1, -1, -1):
        path[:, t] = state
        state = back[every, t, state]
    return path.ravel()[: len(x)]


def _filter(x: np.ndarray, m: Hmm, first: bool, entry: np.ndarray) -> np.ndarray:
    """Likeliest state given rows up to each one only."""
    steps, _ = _steps(x, m, first, False)
    alpha, _ = _forward(steps, _message(steps, False)[1], entry)
    return alpha.reshape(-1, alpha.shape[2])[: len(x)].argmax(axis=1)


def decode_regimes(inputs: DataFrame, models: dict[tuple[str, str], Hmm], mode: str = "viterbi", block: int = REGIME_BLOCK) -> DataFrame:
    """Label every row of ``inputs``: the most likely path (``viterbi``, uses the whole series) or the
    likeliest state given the past only (``filtered``, safe to use as a feature). Rows of series without a model get null."""
    if mode not in ("viterbi", "filtered"):
        raise ValueError("mode must be 'viterbi' or 'filtered'")
    schema = f"pair string, interval string, {TS} timestamp, regime smallint"
    every = inputs.select(*SERIES, TS)
    if not models:
        return every.withColumn("regime", F.lit(None).cast("smallint"))
    k = len(next(iter(models.values())).start)
    best = mode == "viterbi"
    fitted = inputs.sparkSession.createDataFrame([s for s in models], "pair string, interval string")
    known = spread_join(inputs, fitted, SERIES)
    rows = known.select(*SERIES, TS, "pos", *_INPUTS).withColumn("_blk", F.floor(F.col("pos") / block))
    messages = _messages(rows, models, best)
    edges = _ends(messages, k) if best else _edges(messages, k)

    def label(key, g: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        m, g = models[(key[0], key[1])], g.sort_values("pos")
        entry, leave, first = np.array(e["entry"].iloc[0]), np.array(e["leave"].iloc[0]), key[2] == 0
        x = g[list(_INPUTS)].to_numpy()
        states = _decode(x, m, first, int(entry.argmax()), int(leave.argmax())) if best else _filter(x, m, first, entry)
        return pd.DataFrame({"pair": key[0], "interval": key[1], TS: g[TS], "regime": states.astype("int16")})

    labelled = rows.groupBy(*SERIES, "_blk").cogroup(edges.groupBy(*SERIES, "_blk")).applyInPandas(label, schema)
    others = every.join(fitted, list(SERIES), "left_anti").withColumn("regime", F.lit(None).cast("smallint"))
    return labelled.unionByName(others)


def model_table(spark, models: dict[tuple[str, str], Hmm]) -> DataFrame:
    """``pair, interval, state, mean_return, mean_vol, fit_rows, converged`` of the fitted models: a row per series and state."""
    rows = [
        (*series, i, *map(float, m.mean[i]), m.fit_rows, bool(m.converged)) for series, m in models.items() for i in range(len(m.start))
    ]
    return spark.createDataFrame(rows, "pair string, interval string, state int, mean_return double, mean_vol double, fit_rows long, converged boolean")


def fitted_regimes(
    bars: DataFrame, n_states: int = 3, vol_window: int = 24, train_frac: float = 0.5, mode: str = "viterbi",
    n_iter: int = 200, tol: float = 1e-4, block: int = REGIME_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(``label_regimes``, ``model_table`` of the models behind the labels)."""
    positioned = with_position(bars.select(*SERIES, TS, "close"), total=None)
    usable = regime_inputs(positioned, vol_window).drop("pos", "close")
    inputs = materialise(with_position(usable), "regime-inputs")  # read by fitting and by both decoding passes
    models = fit_regimes(inputs, n_states, vol_window, train_frac, n_iter, tol, block)
    return decode_regimes(inputs, models, mode, block), model_table(bars.sparkSession, models)


def label_regimes(
    bars: DataFrame, n_states: int = 3, vol_window: int = 24, train_frac: float = 0.5, mode: str = "viterbi",
    n_iter: int = 200, tol: float = 1e-4, block: int = REGIME_BLOCK,
) -> DataFrame:
    """Regime of every bar after warm-up: ``pair, interval, open_time, regime`` (0 = lowest mean return of the model)."""
    return fitted_regimes(bars, n_states, vol_window, train_frac, mode, n_iter, tol, block)[0]
