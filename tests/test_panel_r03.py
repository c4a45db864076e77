"""The panel is built where its fact lies: groupings, windows and joins by place move no row of it."""

import random

import pytest
from pyspark.sql import functions as F

from tractloom.operators import cohorts, concentration
from tractloom.session import joined_in_parts, stored_by


def moves(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows_of(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(12), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, *range(1995, 2003)]), 1 + rng.randrange(4), 1, 0) for _ in range(n)]


SCHEMA = "tract_fips long, lender_id long, year int, n_loans long, count_lt_100 long, count_100_250 long"


def test_features_of_a_dealt_fact_move_no_row(spark, no_broadcast):
    fact = spark.createDataFrame(rows_of(1, 300), SCHEMA).where("year is not null").dropDuplicates(["tract_fips", "lender_id", "year"])
    dealt = stored_by(fact, "fact", "tract_fips", 5)
    churn, shares = concentration.entity_churn(dealt), concentration.concentration(dealt)
    assert not moves(churn)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    with joined_in_parts(spark):
        assert not moves(shares)
        both = churn.join(shares, ["tract_fips", "year"], "left")
        assert not moves(both)
        got = sorted(both.collect(), key=str)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    plain = concentration.entity_churn(fact).join(concentration.concentration(fact), ["tract_fips", "year"], "left")
    assert got == sorted(plain.collect(), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_churn_of_repeated_and_null_rows(spark, seed):
    rows = rows_of(seed, 250)
    seen = {(t, y): {e for u, e, z, *_ in rows if (u, z) == (t, y)} for t, _, y, *_ in rows if y is not None}
    want = {}
    for (t, y), now in seen.items():
        out = [len(now)]
        for lag in (1, 3):
            before = seen.get((t, y - lag), set())
            out += [len(now - before), len(before - now), len(now ^ before), len(now & before) / len(before) if before else None]
        want[t, y] = tuple(out)
    got = {(r[0], r[1]): tuple(r)[2:] for r in concentration.entity_churn(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_rows_stay_where_they_are_beside_their_cohort(spark, no_broadcast):
    rows = [(i, 1995 + i % 2, None if i % 7 == 0 else i % 3, float(i % 11), float(i * i % 17)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, year int, rural int, lenders double, y double")
    for out in (cohorts.residualize(df, ["year", "rural"], ["y"], "lenders"), cohorts.service_desert(df, ["year", "rural"], "lenders")):
        assert any("BroadcastHashJoin" in line for line in out._jdf.queryExecution().executedPlan().toString().splitlines())
        assert out.count() == 400 and out.agg(F.count_distinct("id")).first()[0] == 400
