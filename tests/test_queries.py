"""Every registered query of the graph engine against its SQL in another engine."""

from __future__ import annotations

import pytest
from helpers import duck, multiset, plan

from tempograph.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert multiset(df.collect(), df.columns) == multiset(want.fetchall(), want.columns)


def test_every_query_has_sql_or_a_recall_test():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"vector_index_nearest"}


def test_a_replay_parses_each_file_once(spark, sf_dir):
    p = plan(catalog.replayed(spark, sf_dir).edges_all)
    assert "ArrowEvalPython" not in p and "BatchEvalPythonUDTF" not in p and "ArrowEvalPythonUDTF" not in p


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["node_id", "hop"]
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
