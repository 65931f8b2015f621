from collections import Counter
from datetime import datetime, timedelta
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barframe.functions import vectors as V
from barframe.operators import encode, regimes, retrieval
from barframe.operators.series import with_position
from barframe.operators.windows import collect_windows, patch_windows, sequence_windows
from barframe.schema import TS
from tests.helpers import random_bars
from workload import retrieval as retrieval_queries  # noqa: F401  (registers the queries)
from workload.registry import QUERIES

T0 = datetime(2024, 1, 1)


def corpus(spark, n=240, dim=8, copies=80):
    """Random vectors of which a third are copies of one, plus a zero vector."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    x[:copies] = x[0]
    x[-1] = 0.0
    rows = [("A", "1h", T0 + timedelta(hours=i), [float(v) for v in x[i]], int(i % 3 if i % 10 else 2)) for i in range(n)]
    return spark.createDataFrame(rows, f"pair string, interval string, {TS} timestamp, embedding array<double>, regime smallint"), x


def brute(x, regime, q, k, same, history):
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit[q], 12)
    ok = np.ones(len(x), bool)
    if same:
        ok &= regime == regime[q]
    if history:
        ok &= np.arange(len(x)) < q
    ids = np.flatnonzero(ok)
    return list(ids[np.lexsort((ids, -sims[ids]))][:k])


@pytest.mark.parametrize("batch", [10_000, 50])
@pytest.mark.parametrize("same,history", [(True, False), (False, True)])
def test_topk_equals_brute_force(spark, batch, same, history):
    df, x = corpus(spark)
    regime = np.array([i % 3 if i % 10 else 2 for i in range(len(x))])
    got = retrieval.similar_bars(df, df, 7, same_regime=same, history_only=history, tile=batch).toPandas()
    for q in range(0, len(x), 17):
        mine = got[got["query_time"] == T0 + timedelta(hours=q)].sort_values("rank")
        ids = [int((t - T0) / timedelta(hours=1)) for t in mine[TS]]
        assert ids == brute(x, regime, q, 7, same, history), q


def test_series_meet_only_themselves(spark):
    df, _ = corpus(spark, 60, copies=0)
    two = df.unionByName(df.withColumn("pair", F.lit("B")).withColumn("embedding", F.transform("embedding", lambda v: -v)))
    out = retrieval.similar_bars(two, two, 3, same_regime=False, tile=16)
    alone = retrieval.similar_bars(df, df, 3, same_regime=False)
    assert out.filter("pair = 'A'").exceptAll(alone).count() == 0 and out.count() == 2 * alone.count()
    blocks = retrieval._tiled(two.withColumn("_us", F.unix_micros(TS)), spark.createDataFrame([("A", "1h", 4, 4), ("B", "1h", 2, 1)], "pair string, interval string, n_q int, n_c int"), ["pair", "interval"], "_q", "_c")
    assert blocks.select("pair", "_q", "_c").distinct().count() == 4 * 4 + 2 * 1


def test_small_tiles_do_not_multiply_what_travels(spark, monkeypatch):
    df, x = corpus(spark)
    seen, tiled = [], retrieval._tiled
    monkeypatch.setattr(retrieval, "_tiled", lambda rows, sizes, *more: (seen.append(sizes.first()), tiled(rows, sizes, *more))[1])
    got = retrieval.similar_bars(df, df, 40, same_regime=False, tile=4).toPandas()
    assert [(r.n_q, r.n_c) for r in seen] == [(retrieval.MEETINGS, retrieval.MEETINGS)] * 2
    for q in (0, 5, 100, 239):
        rows = got[got["query_time"] == T0 + timedelta(hours=q)].sort_values("rank")
        assert [int((t - T0).total_seconds() // 3600) for t in rows[TS]] == brute(x, None, q, 40, False, False)


def test_exclusion_is_strict(spark):
    df, _ = corpus(spark)
    out = retrieval.similar_bars(df, df, 200, same_regime=False, exclude_seconds=3600).toPandas()
    gap = (out[TS] - out["query_time"]).abs()
    assert gap.min() == timedelta(hours=1)  # the next bar stays, only the bar itself goes


def clustered(spark, n=1200, groups=24, dim=16):
    """Vectors around a few directions, in two series of unequal length."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(groups, dim))
    vectors = (centres[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dim))).astype(np.float32)
    rows = [("A" if k % 4 else "B", "1h", T0 + timedelta(hours=k), k % 3, v.tolist()) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"pair string, interval string, {TS} timestamp, regime int, embedding array<float>")


def test_index_finds_neighbours_with_few_comparisons(spark, tmp_path):
    df = clustered(spark)
    retrieval.store_index(df, str(tmp_path), seed=1)
    leaders, lists = retrieval.read_index(spark, str(tmp_path))
    assert {r["pair"]: r["count"] for r in leaders.groupBy("pair").count().collect()} == {"A": 30, "B": 18}
    assert lists.count() == df.count() and lists.select("pair", TS).distinct().count() == df.count()
    probes = retrieval.probe_lists(df, leaders, 4)
    assert probes.count() == 4 * df.count()
    # under filters the nearest bars left may lie further away, early bars' in any list
    for recall, options in ((0.9, {"same_regime": False}), (0.8, {"same_regime": True, "exclude_seconds": 7200, "history_only": True})):
        exact = retrieval.similar_bars(df, df, 5, **options)
        near = retrieval.approximate_topk(df, lists, probes, 5, tile=64, **options)
        key = ["pair", "query_time", TS]
        assert exact.join(near, key, "left_semi").count() >= recall * exact.count()
        assert near.groupBy("pair", "query_time").count().agg({"count": "max"}).first()[0] <= 5
        kept = near.select(*key).join(lists.select("pair", TS, "leader"), ["pair", TS])
        assert kept.join(probes, ["pair", "query_time", "leader"], "left_anti").count() == 0
    cost = retrieval.search_cost(probes, lists).agg({"compared": "sum", "all_pairs": "sum"}).first()
    assert cost["sum(compared)"] < 0.35 * cost["sum(all_pairs)"] and cost["sum(all_pairs)"] == 900 * 900 + 300 * 300


def test_all_lists_probed_is_exact_and_blocks_do_not_matter(spark):
    df = clustered(spark, 200)
    leaders = retrieval.choose_leaders(df, most=6)
    lists = retrieval.build_index(df, leaders)
    probes = retrieval.probe_lists(df, leaders, 0.999)
    exact = retrieval.similar_bars(df, df, 4, same_regime=False).drop("regime_name").collect()
    for tile in (7, 2048):
        near = retrieval.approximate_topk(df, lists, probes, 4, same_regime=False, tile=tile).drop("regime_name").collect()
        assert sorted(map(tuple, near)) == sorted(map(tuple, exact))
    empty = df.limit(0)
    assert retrieval.build_index(empty, retrieval.choose_leaders(empty)).count() == 0


def test_blocks_are_bounded_by_what_their_queries_take(spark, monkeypatch):
    df, x = corpus(spark)
    seen, tiled = [], retrieval._tiled
    monkeypatch.setattr(retrieval, "_tiled", lambda rows, sizes, *more: (seen.append(sizes.first()), tiled(rows, sizes, *more))[1])
    monkeypatch.setattr(retrieval, "ENTRIES", 1500)
    got = retrieval.similar_bars(df, df, 40, same_regime=False, tile=1).toPandas()
    assert [(r.n_q, r.n_c) for r in seen] == [(-(-240 * (8 + 3 * 40) // 1500), retrieval.MEETINGS)] * 2  # 40 places of three numbers
    for q in (0, 5, 239):
        rows = got[got["query_time"] == T0 + timedelta(hours=q)].sort_values("rank")
        assert [int((t - T0).total_seconds() // 3600) for t in rows[TS]] == brute(x, None, q, 40, False, False)


def test_packed_probes_say_the_same_in_a_row_per_query(spark):
    df = clustered(spark, 700)
    df = df.unionByName(df.filter(F.hour(TS) % 5 == 0)).cache()  # some bars come twice
    leaders = retrieval.choose_leaders(df, seed=2).cache()
    lists = retrieval.build_index(df, leaders).cache()
    rows = retrieval.probe_lists(df, leaders, 0.4).cache()
    packed = retrieval.probe_lists(df, leaders, 0.4, packed=True).cache()
    assert packed.count() == df.select("pair", TS).distinct().count()
    number = {(r["pair"], r[TS]): r["number"] for r in leaders.collect()}
    many = {r["pair"]: r["n_leaders"] for r in leaders.collect()}
    expected = Counter((r["pair"], r["query_time"], number[r["pair"], r["leader"]]) for r in rows.collect())
    got = Counter()
    for r in packed.collect():
        assert len(r["lists"]) == -(-len({v for k, v in number.items() if k[0] == r["pair"]}) // 64)  # what travels: a bit per list
        chosen = [64 * w + b for w, bits in enumerate(r["lists"]) for b in range(64) if bits >> b & 1] + r["again"]
        assert len(chosen) == -(-many[r["pair"]] * 2 // 5)
        got.update((r["pair"], r["query_time"], n) for n in chosen)
    assert got == expected and max(got.values()) > 1
    assert sorted(retrieval.search_cost(packed, lists).collect()) == sorted(retrieval.search_cost(rows, lists).collect())
    near = [sorted(map(tuple, retrieval.approximate_topk(df, lists, p, 6, same_regime=False, tile=64).drop("regime_name").collect())) for p in (packed, rows)]
    assert near[0] == near[1] and len(near[0]) == 6 * packed.count()


@pytest.mark.parametrize("pairs", [0, 1 << 19])
@pytest.mark.parametrize("history,exclude", [(False, 0), (True, 0), (False, 30)])
def test_neighbours_closer_than_single_precision_are_ranked_exactly(monkeypatch, pairs, history, exclude):
    monkeypatch.setattr(retrieval, "_PAIRS", pairs)
    monkeypatch.setattr(retrieval, "_STEP", (64, 100))
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(20, 12)), 50, axis=0) + 1e-4 * rng.normal(size=(1000, 12))
    x[::7] = x[0]
    order = rng.permutation(1000)
    block = retrieval._Block(pa.table({"_us": order, "regime": pa.nulls(1000, pa.int64()), "embedding": pa.array(list(x[order]), pa.list_(pa.float64()))}))
    best = retrieval._Best(block, 6, False, exclude, history)
    for part in np.array_split(np.arange(1000), 3):
        best.meet(np.arange(1000), block, part)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 1000, 13):
        sims = np.round(unit @ unit[q], 12)
        ids = np.flatnonzero((np.arange(1000) < q if history else True) & (abs(np.arange(1000) - q) >= exclude))
        assert list(best.at[q][best.sim[q] > -np.inf]) == list(ids[np.lexsort((ids, -sims[ids]))][:6]), q


def test_tied_votes_count_as_down(spark):
    df, _ = corpus(spark, 60, copies=0)
    labels = df.select("pair", "interval", TS, (F.hour(TS) % 2).alias("next_dir"))
    votes = retrieval.retrieval_votes(df, labels, k=4, test_frac=0.5, max_test=None)
    assert votes.count() == 60
    assert votes.filter("n_matches < 3 AND hit IS NOT NULL").count() == 0


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(5)
    state = np.repeat([0, 1, 2, 1, 0, 2], 150)
    ret = rng.normal([-0.02, 0.0, 0.02], [0.02, 0.003, 0.01])[0] + rng.normal(np.array([-0.02, 0.0, 0.02])[state], np.array([0.02, 0.003, 0.01])[state])
    pdf = pd.DataFrame({"pair": "A", "interval": "1h", TS: pd.date_range(T0, periods=900, freq="h"), "log_return": ret, "vol": np.array([0.02, 0.003, 0.01])[state] * rng.uniform(0.9, 1.1, 900)})
    return with_position(spark.createDataFrame(pdf)).cache(), state


@pytest.mark.parametrize("mode", ["viterbi", "filtered"])
def test_decoding_in_blocks_equals_one_block(inputs, mode):
    df, state = inputs
    models = regimes.fit_regimes(df, train_frac=1.0)
    whole = regimes.decode_regimes(df, models, mode).orderBy(TS).toPandas()
    for block in (64, 7):
        cut = regimes.decode_regimes(df, models, mode, block=block).orderBy(TS).toPandas()
        assert (whole["regime"] == cut["regime"]).all()
    assert (whole["regime"].to_numpy() == state).mean() > 0.95


def plain_likelihood(x, m):
    """Scaled forward pass, row by row."""
    total, a = 0.0, None
    for row in m.log_density(x):
        b = np.exp(row)
        a = m.start * b if a is None else (a @ m.trans) * b
        total += np.log(a.sum())
        a = a / a.sum()
    return total


def test_em_improves_and_orders_states(inputs):
    df, _ = inputs
    x = df.orderBy("pos").toPandas()[["log_return", "vol"]].to_numpy()
    point = regimes._starting_points(df, 3)[("A", "1h")]
    assert regimes._expect(x, point)["loglik"][0] == pytest.approx(plain_likelihood(x, point), rel=1e-9)
    _, history = regimes._fit_one(x, point, 40, 1e-6)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    fitted = regimes.fit_regimes(df)[("A", "1h")]
    assert list(np.argsort(fitted.mean[:, 0])) == [0, 1, 2] and fitted.converged


def test_blocks_do_not_change_the_fit(inputs):
    df, _ = inputs
    whole = regimes.fit_regimes(df, train_frac=1.0, n_iter=6)[("A", "1h")]
    for block in (64, 350):
        cut = regimes.fit_regimes(df, train_frac=1.0, n_iter=6, block=block)[("A", "1h")]
        for name in ("start", "trans", "mean", "var"):
            np.testing.assert_allclose(getattr(cut, name), getattr(whole, name), rtol=1e-7, atol=1e-12)


def test_series_too_short_for_a_model_get_no_label(spark):
    rows = [("A", "1h", T0 + timedelta(hours=i), 0.01 * i, 0.1) for i in range(2)]
    df = with_position(spark.createDataFrame(rows, f"pair string, interval string, {TS} timestamp, log_return double, vol double"))
    assert [r["regime"] for r in regimes.decode_regimes(df, regimes.fit_regimes(df)).collect()] == [None, None]


@pytest.mark.parametrize("step", [86_400, 3_600])
def test_regime_query_on_copies_in_steps(spark, tmp_path, step):
    """Six copies of the events a day apart, where states have close means, or an hour apart, where most returns are zero."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    copies = events.withColumn("i", F.explode(F.array(*map(F.lit, range(6)))))
    copies = copies.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("i") * (step * 1_000_000))).drop("i")
    copies.coalesce(4).write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["m18_regimes_viterbi"](spark, str(tmp_path)).collect()
    assert [(r.known, r.ascending, r.share) for r in rows] == [(True, True, 1.0)] * 5


def test_gaf_query_compares_images_with_their_fields(spark):
    rows = QUERIES["f20_encode_gaf"](spark, "/root/testdata/sf0.001").limit(50).collect()
    assert rows and all(r.summation and r.difference and r.stochastic for r in rows)


def test_encoders(spark):
    bars = with_position(spark.createDataFrame(random_bars(100, gaps=0)))
    windows = collect_windows(bars, length=64).cache()
    assert windows.count() == 37
    closes = np.array([b["close"] for b in windows.orderBy(TS).first()["window"]])
    scaled = (closes - closes.min()) / (closes.max() - closes.min()) * 2 - 1
    phi = np.arccos(scaled.clip(-1, 1))
    planes = encode.encode_windows(windows, "gaf").orderBy(TS).first()["image"]
    np.testing.assert_allclose(np.array(planes[0]).reshape(64, 64), np.cos(phi[:, None] + phi[None]), atol=1e-5)
    np.testing.assert_allclose(np.array(planes[1]).reshape(64, 64), np.sin(phi[:, None] - phi[None]), atol=1e-5)
    moves = encode.markov_transitions(windows.select(TS, F.col("window.close").alias("c")), "c", [TS])
    assert moves.groupBy(TS, "bin").agg(F.sum("p").alias("p")).filter("abs(p - 1) > 1e-9").count() == 0
    image = np.frombuffer(encode.encode_windows(windows, "candle").first()["image"], np.uint8).reshape(3, 64, 64)
    colours = {tuple(c) for c in image.reshape(3, -1).T}
    assert colours <= {encode.BACKGROUND, encode.UP, encode.DOWN} and len(colours) > 1
    assert encode.rasters(np.full((2, 64, 4), 3.0)).shape == (2, 3, 64, 64)
    with pytest.raises(ValueError):
        encode.rasters(np.ones((1, 65, 4)))
    # two candles on eight pixels: rising 1 to 3 in 0..4, then falling 3 to 2 in 2..4, one after the other
    image = encode.rasters(np.array([[[1.0, 4, 0, 3], [3, 4, 2, 2]]]), hw=8)[0].transpose(1, 2, 0)
    drawn = ["".join({encode.UP: "u", encode.DOWN: "d"}.get(tuple(int(v) for v in px), ".") for px in row) for row in image]
    assert drawn == ["..u...d.", "..u...d.", ".uuu.ddd", ".uuu.ddd", ".uuu.ddd", ".uuu....", "..u.....", "..u....."]
    emb = encode.embed_windows(windows, dim=16)
    assert emb.filter(F.abs(V.norm(F.col("embedding")) - 1) > 1e-5).count() == 0


def test_sequences_and_patches(spark):
    bars = with_position(spark.createDataFrame(random_bars(40, gaps=0)))
    assert sequence_windows(bars, ["close", "volume"], 10).count() == 31
    padded = sequence_windows(bars, ["close", "volume"], 10, pad=True)
    first = padded.orderBy(TS).first()["sequence"]
    assert len(first) == 10 and first[0] == [0.0, 0.0] and first[9][0] > 0
    patch = patch_windows(padded, 4).orderBy(TS).first()
    assert len(patch["patches"]) == 2 and patch["patches"][1] == [v for row in patch["sequence"][6:10] for v in row]
    short = patch_windows(padded, 16).first()
    assert short["patches"] == []


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    row = df.select(V.l2_normalise(F.col("a")).alias("u"), V.l2_normalise(F.col("z")).alias("z"), V.cosine(F.col("a"), F.col("z")).alias("c"), V.minmax(F.col("z")).alias("m")).first()
    assert row["u"] == [0.6, 0.8] and row["z"] == [0.0, 0.0] and row["c"] == 0.0 and row["m"] == [0.0, 0.0]
