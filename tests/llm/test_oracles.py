"""Registered queries against their DuckDB equivalents on the smallest tables."""

import pytest

from barframe.llm.queries import ORACLES, QUERIES
from tests.test_oracles import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):  # noqa: F811
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
