"""Every registered query against its checking SQL, on the smallest test folder."""

import sys

import pytest

import __spark_entry__ as entry_module
from bizlake.catalog import load
from check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_checking_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_sql(spark, con, key):
    good, text = compare(spark, con, SF, QUERIES[key], ORACLES[key])
    assert good, text


def test_entry_holds_the_whole_catalog():
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("hidden", ["bizlake.llm", "zstandard"])
def test_entry_works_without_the_text_operators(monkeypatch, hidden):
    for name in [m for m in sys.modules if m.startswith(("bizlake.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, hidden, None)
    assert set(entry_module.queries()) == set(QUERIES) and set(entry_module.oracle_sql()) == set(ORACLES)


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "cohort" in df.columns
