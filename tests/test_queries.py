"""Every registered query against its SQL statement on the smallest data, and the driver contract."""

import os

import pytest
from oracle import compare, duck

from tractloom.catalog import load

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = load()
# model studies need more rows than the smallest data has; they run at the next size
STUDIES = [n for n, q in REGISTRY.items() if not q.sql and n.startswith("m")]


@pytest.fixture(scope="module")
def con():
    return duck(DIRECTORY)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_matches_sql(spark, con, name):
    q = REGISTRY[name]
    problems = compare(q.build(spark, DIRECTORY), q.sql, con)
    assert [p for p in problems if p != "empty result"] == []


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if not q.sql and n not in STUDIES])
def test_gives_rows(spark, name):
    assert not REGISTRY[name].build(spark, DIRECTORY).isEmpty()


@pytest.mark.parametrize("name", ["m03_boosted_walk_forward", "m15_permutation_importance", "m22_tree_attribution"])
def test_study_gives_rows(spark, name):
    assert not REGISTRY[name].build(spark, "/root/testdata/sf0.01").isEmpty()


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) < set(e.queries())
    assert len(e.queries()) > 150
