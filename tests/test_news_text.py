from datetime import datetime, timedelta
import json

import numpy as np
from pyspark.sql import functions as F

from barframe.functions import text as X
from barframe.operators import news as N
from barframe.schema import TS

T0 = datetime(2024, 3, 1, 12)


def article(spark, *rows):
    data = [(i, T0 + timedelta(seconds=s), tickers, json.dumps({"ensemble": score, "confidence": abs(score)})) for i, s, tickers, score in rows]
    return spark.createDataFrame(data, "id string, published_at timestamp, tickers array<string>, sentiment string")


def bar(spark, pair="BTCUSDT", at=T0):
    return spark.createDataFrame([(pair, "1h", at)], f"pair string, interval string, {TS} timestamp")


def window(spark, news, **options):
    return N.aggregate_news_for_bars(news, bar(spark), **options).collect()[0]


def test_window_is_closed_open(spark):
    day = 86_400
    news = article(spark, ("at", 0, ["BTC"], 0.9), ("edge", -day, ["BTC"], 0.2), ("old", -day - 1, ["BTC"], -0.9), ("in", -1, ["BTC"], 0.4))
    row = window(spark, news)
    assert row["sent_count"] == 2 and abs(row["sent_mean"] - 0.3) < 1e-12 and row["sent_last"] == 0.4


def test_macro_tickers_ties_and_empty(spark):
    news = article(spark, ("a", -60, [], 0.5), ("b", -60, None, -0.5), ("c", -60, ["ETH"], 1.0), ("d", -3600, ["BTC", "ETH"], 0.1))
    row = window(spark, news)
    assert row["sent_count"] == 3 and row["sent_last"] == -0.5  # same instant: the higher id is the later one
    assert window(spark, news, include_macro=False)["sent_count"] == 1
    lone = window(spark, news, include_macro=False)
    assert lone["sent_std"] == 0.0 and lone["sent_min"] == lone["sent_max"] == 0.1
    empty = N.aggregate_news_for_bars(news, bar(spark, at=T0 + timedelta(days=9))).collect()[0]
    assert empty["sent_count"] == 0 and empty["sent_mean"] == 0.0
    right = N.aggregate_news_for_bars(news, bar(spark))
    assert N.check_no_future_news(right, news).count() == 0
    assert N.check_no_future_news(right.withColumn("sent_count", F.col("sent_count") + 1), news).count() == 1


def test_malformed_sentiment_is_left_out(spark):
    news = article(spark, ("a", -60, ["BTC"], 0.5)).union(
        spark.createDataFrame([("x", T0 - timedelta(seconds=5), ["BTC"], "{bad"), ("y", T0 - timedelta(seconds=5), ["BTC"], None)], "id string, published_at timestamp, tickers array<string>, sentiment string")
    )
    assert window(spark, news)["sent_count"] == 1


def test_tickers_ids_and_scores(spark):
    df = spark.createDataFrame([("Bitcoin, ETH and solana!", None), ("ethics, solid btcs", "xRp RIPPLE")], "a string, b string")
    got = [r["t"] for r in df.select(X.extract_tickers(F.col("a"), F.col("b")).alias("t")).collect()]
    assert got == [["BTC", "ETH", "SOL"], ["XRP"]]
    texts = spark.createDataFrame([("Title.", " body . "), (" T ", None), (None, "s")], "t string, s string")
    assert [r["x"] for r in texts.select(X.scoring_text(F.col("t"), F.col("s")).alias("x")).collect()] == ["Title.. body", "T", "s"]
    clip = spark.sql("SELECT array(named_struct('label','bullish','score',0.9D), named_struct('label','Positive','score',0.8D), named_struct('label','?','score',9D)) AS c")
    assert clip.select(X.signed_score(F.col("c")).alias("s")).collect()[0]["s"] == 1.0


def test_html_text(spark):
    html = "<p>Hello <b>big</b>\n world</p><script>var t='</p>';</script><!-- no --><li>a&amp;b</li>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    assert [r["h"] for r in X.strip_html(df, "h").collect()] == ["Hello big world a&b", "", ""]


def test_scoring_leaves_scored_rows(spark):
    rows = spark.createDataFrame([("rally profit", "", None), ("crash", "", '{"ensemble":0.3}'), ("  ", "", "")], "title string, summary string, sentiment string")
    out = [json.loads(r["sentiment"]) for r in N.score_news(rows).collect()]
    assert out[0]["ensemble"] == 1.0 and out[1] == {"ensemble": 0.3} and out[2]["confidence"] == 0.0


def test_news_window_on_quarter_hour_bars(spark):
    """Bars of fifteen minutes take the articles of the 24 hours before each, hourly bars in the same table too."""
    times = [T0 + timedelta(minutes=15 * k) for k in range(200)]
    bars = spark.createDataFrame([("A", "15m", t) for t in times] + [("A", "1h", t) for t in times[::4]], "pair string, interval string, open_time timestamp")
    at = [T0 + timedelta(minutes=7 * k) for k in range(300)]
    rows = [(str(k), t, ["A"], json.dumps({"ensemble": 0.5, "confidence": 0.1, "cryptobert": 0.0, "finbert": 0.0})) for k, t in enumerate(at)]
    news = spark.createDataFrame(rows, "id string, published_at timestamp, tickers array<string>, sentiment string")
    for r in N.aggregate_news_for_bars(news, bars, tickers={"A": ["A"]}).collect():
        assert r["sent_count"] == sum(r["open_time"] - timedelta(hours=24) <= t < r["open_time"] for t in at)


def test_windows_equal_direct_sums_across_segments(spark):
    """Random news and bars on both sides of the epoch, spans that do and don't divide the blocks."""
    rng = np.random.default_rng(4)
    zero = datetime(1970, 1, 1)
    at = [zero + timedelta(seconds=int(x)) for x in rng.integers(-400_000, 400_000, 300)]
    scores = rng.uniform(-1, 1, 300).round(6)
    rows = [(f"{k:03}", t, ["A"] if k % 5 else None, json.dumps({"ensemble": s, "confidence": abs(s)})) for k, (t, s) in enumerate(zip(at, scores))]
    news = spark.createDataFrame(rows, "id string, published_at timestamp, tickers array<string>, sentiment string")
    times = [zero + timedelta(hours=int(h)) for h in rng.integers(-150, 150, 80)]
    bars = spark.createDataFrame([("A", "1h", t) for t in {*times}] + [("B", "4h", times[0])], f"pair string, interval string, {TS} timestamp")
    for hours, grid in ((24, 3_600_000), (7, 1_800_000), (1, 3_600_000)):
        found = N.aggregate_news_for_bars(news, bars, hours * 3_600_000, tickers={"A": ["A"], "B": ["B"]}, grid_ms=grid, with_last_at=True).collect()
        assert len(found) == len({*times}) + 1
        for r in found:
            inside = [(t, f"{k:03}", s) for k, (t, s) in enumerate(zip(at, scores)) if r[TS] - timedelta(hours=hours) <= t < r[TS] and (r["pair"] == "A" or k % 5 == 0)]
            values = np.array([s for _, _, s in inside])
            assert r["sent_count"] == len(inside)
            if len(inside):
                want = [values.mean(), values.std(), values.min(), values.max(), max(inside)[2], abs(values).mean()]
                got = [r[c] for c in ("sent_mean", "sent_std", "sent_min", "sent_max", "sent_last", "sent_conf_mean")]
                np.testing.assert_allclose(got, want, atol=1e-9)
                assert r["sent_last_at"] == max(inside)[0]


def test_a_text_is_searched_once_per_word_list(spark):
    rows = [(1, "Gain", "up-rally, gains crash"), (2, "x", "RECORD loss\nban upset"), (3, "", ""), (4, None, "strong2strong")]
    df = spark.createDataFrame(rows, "id long, title string, summary string").withColumn("sentiment", F.lit(None).cast("string"))
    scored = N.score_news(df)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and "split(" not in plan
    found = {r.id: (r.s.cryptobert, r.s.finbert) for r in scored.select("id", X.decode_sentiment(F.col("sentiment")).alias("s")).collect()}
    third = 1 / 3
    assert {k: (round(a, 9), round(b, 9)) for k, (a, b) in found.items()} == {1: (round(third, 9), 1.0), 2: (0.0, -1.0), 3: (0.0, 0.0), 4: (0.0, 1.0)}
