"""Corpus queries against their SQL on sf0.001."""

import pytest

from riskloom.llm.queries import SQL, Q
from tools.oracle_check import frame_key

from ..conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = Q[name](spark, SF_SMALL).toPandas(), duck.execute(SQL[name]).df()
    assert len(got) and frame_key(got) == frame_key(want)


def test_every_operator_has_one_query():
    assert sorted(n.split("_")[0] for n in Q) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])
