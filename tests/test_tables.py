from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barframe.operators import checks, tables
from barframe.operators.splits import auto_folds, walk_forward
from barframe.schema import SERIES, TS
from barframe.session import scratch_path
from barframe.sources import candles, sinks
from barframe.sources.news import read_news
from tests.helpers import random_bars


def full(spark, pdf, hours=1):
    df = candles.normalise_candles(spark.createDataFrame(pdf))
    return df.withColumn("ingested_at", F.timestamp_millis(F.unix_millis(TS) + hours * 3_600_000))


def test_candle_upsert_is_idempotent_and_latest_wins(spark):
    root = scratch_path(spark, "t")
    with pytest.raises(FileNotFoundError):
        candles.read_ohlcv(spark, root)
    first, second = full(spark, random_bars(900, gaps=0)), full(spark, random_bars(900, gaps=0).assign(close=7.0))
    stale = full(spark, random_bars(900, gaps=0).assign(close=1.0), hours=0)
    for batch in (first, second, stale, stale):
        sinks.upsert_ohlcv(batch, root)
    stored = candles.read_ohlcv(spark, root, "A", "1h")
    assert stored.count() == 900 and stored.filter("close = 7.0").count() == 900
    one_month = second.filter(F.month(TS) == 2).withColumn("close", F.lit(9.0)).withColumn("ingested_at", F.col("ingested_at") + F.expr("INTERVAL 1 DAY"))
    sinks.upsert_ohlcv(one_month, root)
    assert candles.read_ohlcv(spark, root).filter("close = 9.0").count() == one_month.count()
    assert candles.read_ohlcv(spark, root).count() == 900
    with pytest.raises(FileNotFoundError):
        candles.read_ohlcv(spark, root, "missing", "1h")
    with pytest.raises(FileNotFoundError, match="label_regimes"):
        sinks.read_keyed(spark, root, "regimes")


def test_empty_news_store_reads_empty(spark):
    assert read_news(spark, scratch_path(spark, "none")).count() == 0


def test_wide_embeddings(spark):
    wide = spark.createDataFrame([(1, 0.5, 1.5, 2.5)], "k int, e0 double, e1 double, e2 double")
    assert sinks.wide_to_array(wide).collect()[0]["embedding"] == [0.5, 1.5, 2.5]


def test_dedupe_hot_key(spark):
    df = spark.range(30_000).select((F.col("id") % 3 == 0).cast("int").alias("hot"), "id")
    df = df.select(F.when(F.col("hot") == 1, F.lit(-1)).otherwise(F.col("id")).alias("key"), "id")
    out = tables.dedupe(df, ["key"], [F.col("id").desc()])
    assert out.count() == 20_001 and out.filter("key = -1").collect()[0]["id"] == 29_997


def test_checks(spark):
    t = datetime(2024, 1, 1)
    news = spark.createDataFrame([("a", t, t), ("b", t + timedelta(hours=1), t)], "id string, published_at timestamp, ingested_at timestamp")
    with pytest.raises(ValueError, match="1 articles"):
        checks.check_publication_order(news)
    assert checks.check_publication_order(checks.clamp_published(news)) == 2
    assert checks.check_bar_order(full(spark, random_bars(50))).count() == 0
    assert checks.check_bar_order(full(spark, random_bars(50), hours=-1)).count() == 1


def test_last_fold_vanishes_on_exact_division(spark):
    rows = spark.range(120).select(F.lit("A").alias("pair"), F.col("id").alias("row"), F.lit(120).cast("long").alias("n"))
    tested = walk_forward(auto_folds(rows), F.col("initial"), F.col("test"), max_folds=6)
    got = {r["fold"]: r for r in tested.groupBy("fold").agg(F.min("row").alias("lo"), F.count("*").alias("c"), F.max("train_end").alias("e")).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]  # 60 + 6 x 10 fills all rows, the gap pushes the sixth fold out
    assert all(r["lo"] == r["e"] + 1 and r["c"] == 10 for r in got.values())


def test_spread_join_matches_plain_join(spark):
    data = spark.range(1000).select((F.col("id") % 5).alias("k"), "id")
    small = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert tables.spread_join(data, small, ["k"]).count() == 800
    assert tables.spread_join(data, small, ["k"], "left").filter("v IS NULL").count() == 200


def test_message_edge_cases(spark):
    lines = ['{"data":{"k":{"s":"X","i":"1h","t":0,"T":1,"o":"1","h":"2","l":"0","c":"1","v":"4"}}}', "oops", '{"data":{}}', '{"k":null}', "[]", '{"k":{"s":"X","i":"1h","t":3600000,"o":"1","h":"2","l":"0","c":"1","v":"4","V":"1","q":"9","n":3,"Q":"2","x":true}}']
    out = candles.parse_kline_messages(spark.createDataFrame([(x,) for x in lines], "value string"), "value").orderBy(TS).collect()
    assert len(out) == 2
    assert (out[0]["taker_buy_base"], out[0]["quote_volume"], out[0]["trades"], out[0]["is_closed"]) == (2.0, 0.0, 0, False)
    assert (out[1]["taker_buy_base"], out[1]["quote_volume"], out[1]["trades"], out[1]["is_closed"]) == (1.0, 9.0, 3, True)


def test_top_n_and_evenly_spaced(spark):
    df = full(spark, random_bars(100, gaps=0))
    assert tables.top_n_per(df, list(SERIES), [F.col(TS).desc()], 3).count() == 3
    assert tables.evenly_spaced(df, 5).count() == 5
    assert tables.evenly_spaced(df, 500).count() == 100


def test_scratch_is_recorded_and_removed(spark):
    from barframe.session import exists, materialise, recorded_scratch, remove

    with recorded_scratch([]) as paths:
        materialise(spark.range(3), "kept")
    materialise(spark.range(3), "unrecorded")
    assert len(paths) == 1 and exists(spark, paths[0])
    remove(spark, paths[0])
    assert not exists(spark, paths[0])


def test_upsert_opens_only_the_touched_folders(spark):
    from barframe.session import scratch_path
    from barframe.sources import sinks
    from barframe.sources.candles import normalise_candles, read_ohlcv
    from tests.helpers import random_bars

    root = scratch_path(spark, "pruned")
    bars = normalise_candles(spark.createDataFrame(random_bars(1600, 3, gaps=0))).withColumn("ingested_at", F.current_timestamp())
    sinks.upsert_ohlcv(bars, root)
    stored = spark.read.parquet(f"{root}/ohlcv")
    touched = spark.createDataFrame([("A", "1h", "2020-02")], "pair string, interval string, month string")
    plan = sinks._pruned(stored, touched, ["pair", "interval", "month"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1].split("]")[0] and "2020-02" in plan
    sinks.upsert_ohlcv(bars.filter(F.month("open_time") == 2).withColumn("close", F.lit(1.0)), root)
    months = {r["m"]: r["c"] for r in read_ohlcv(spark, root).groupBy(F.month("open_time").alias("m")).agg(F.max("close").alias("c")).collect()}
    assert len(months) == 3 and months[2] == 1.0 and months[1] > 1.0
    assert read_ohlcv(spark, root, start="2020-02-10", end="2020-02-20").count() == 241


def test_null_partitions_keep_their_stored_rows(spark):
    """Three upserts of articles without a date or source, then the same for candles and vectors."""
    root, day = scratch_path(spark, "t"), datetime(2024, 3, 1)

    def articles(*rows):
        return spark.createDataFrame(
            [(u, s, u, u, "", d, day, [], {}, None) for u, s, d in rows],
            "id string, source string, title string, url string, summary string, published_at timestamp, ingested_at timestamp, "
            "tickers array<string>, raw_sentiment map<string,bigint>, sentiment string",
        )

    def stored():
        return sorted((r.url, r.source, r.date) for r in spark.read.parquet(f"{root}/news").collect())

    sinks.upsert_news(articles(("a", "x", None), ("b", "x", None), ("c", "x", day)), root)
    sinks.upsert_news(articles(("d", "x", None), ("a", "x", None)), root)
    assert [u for u, _, _ in stored()] == ["a", "b", "c", "d"]
    sinks.upsert_news(articles(("e", "x", None), ("f", "x", day), ("g", None, None), ("h", "", day)), root)
    sinks.upsert_news(articles(("i", None, None), ("j", "", day), ("k", "y", day)), root)
    assert [u for u, _, _ in stored()] == list("abcdefghijk")
    assert {d for u, _, d in stored() if u in "abdegi"} == {None}

    vectors = spark.createDataFrame([("A", "1h", None, [1.0]), ("A", "1h", day, [2.0])], "pair string, interval string, open_time timestamp, embedding array<float>")
    sinks.upsert_embeddings(vectors, root)
    sinks.upsert_embeddings(vectors.withColumn("interval", F.lit("4h")).filter("open_time IS NULL"), root)
    sinks.upsert_embeddings(vectors.withColumn("pair", F.lit(None).cast("string")), root)
    sinks.upsert_embeddings(vectors.filter("open_time IS NULL").withColumn("embedding", F.array(F.lit(5.0).cast("float"))), root)
    found = spark.read.parquet(f"{root}/embeddings").collect()
    assert len(found) == 5 and sum(r.embedding == [5.0] for r in found) == 1
    bars = full(spark, random_bars(50, gaps=0)).withColumn("open_time", F.when(F.hour("open_time") > 0, F.col("open_time")))
    sinks.upsert_ohlcv(bars, root)
    before = spark.read.parquet(f"{root}/ohlcv").count()
    sinks.upsert_ohlcv(bars.filter("open_time IS NULL").withColumn("pair", F.lit("Z")), root)
    sinks.upsert_ohlcv(bars.filter("open_time IS NULL"), root)
    assert spark.read.parquet(f"{root}/ohlcv").count() == before + 1


def test_high_water_reads_the_newest_month_only(spark):
    root = scratch_path(spark, "t")
    with pytest.raises(FileNotFoundError):
        candles.stored_high_water(spark, root)
    bars = full(spark, random_bars(3000, gaps=0))
    old = bars.filter(F.month(TS) == 1).withColumn("pair", F.lit("gone"))
    sinks.upsert_ohlcv(bars.unionByName(old).unionByName(bars.withColumn("interval", F.lit("12"))), root)
    marks = candles.stored_high_water(spark, root)
    wanted = {tuple(r) for r in candles.latest_open_time(candles.read_ohlcv(spark, root)).collect()}
    assert {tuple(r) for r in marks.collect()} == wanted and len(wanted) == 3
    months = sorted({f.parent.name for f in Path(root, "ohlcv", "pair=A").rglob("*.parquet")})
    assert len(months) > 3
    for file in Path(root, "ohlcv").rglob("*.parquet"):  # whoever opens an older month fails
        if file.parent.name != ("month=2020-01" if "pair=gone" in str(file) else months[-1]):
            file.write_bytes(b"not parquet")
    assert {tuple(r) for r in candles.stored_high_water(spark, root).collect()} == wanted
    assert [r["pair"] for r in candles.stored_high_water(spark, root, "gone").collect()] == ["gone"]
    assert candles.stored_high_water(spark, root, "none").count() == 0
