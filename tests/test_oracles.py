"""Registered queries against DuckDB on the smallest tables; ORACLES=all runs every one."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = [
    "x05_bars_from_events", "s05_parse_kline_messages", "s07_candle_upsert", "s12_backfill_plan", "p09_feature_frame",
    "a02_a03_a04_fold_metrics", "a07_dm_statistic_h3", "j01_a01_news_window", "m12_conformal_threshold",
    "r03_similar_bars_grid", "g04_equity_curve", "g06_snapshot", "x06_x09_stream_features", "x08_stream_positions",
    "f17_markov_transitions", "t08_evenly_spaced",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ORACLES") == "all" else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def rows(df):
    def norm(x):
        if pd.isna(x):
            return "null"
        return str(x) if isinstance(x, str) else repr(float(x))

    return sorted(tuple(norm(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    theirs = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
