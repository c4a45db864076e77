"""The stored models are fitted on the published settings, none cut short."""

import datetime
import random
from dataclasses import replace

from tractloom.catalog import load
from tractloom.operators import learning as L


def write_tables(spark, folder, places=60):
    """Loans of a few places in 1993 to 2001: two to five lenders a place and year."""
    rng = random.Random(5)
    orders, loans = [], []
    for place in range(1, places + 1):
        for year in range(1993, 2002):
            orders.append((len(orders) + 1, place, datetime.date(year, 3, 1)))
            loans += [(len(orders), lender, rng.uniform(1000, 90000)) for lender in rng.sample(range(1, 9), rng.randrange(2, 6))]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate date"),
        "lineitem": (loans, "l_orderkey long, l_suppkey long, l_extendedprice double"),
        "nation": ([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
        "customer": ([(p, p % 2, ["HOUSEHOLD", "BUILDING"][p % 3 == 0], float(p)) for p in range(1, places + 1)],
                     "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_stored_models_use_the_published_settings(spark, tmp_path, monkeypatch):
    """at most 40 rounds a fit were grown. The settings of each fit are noted; short fits stand in for the rest of the query."""
    write_tables(spark, str(tmp_path))
    given, real = [], L.fit_prepared

    def short(inputs, settings):
        given.append(settings)
        return real(inputs, replace(settings, rounds=2, depth=2, patience=1, first_rounds=2))

    monkeypatch.setattr(L, "fit_prepared", short)
    rows = load()["m21_stored_models"].build(spark, str(tmp_path)).collect()
    assert given == [L.Settings()] * 4 and L.Settings().rounds == 400
    assert len({(r["tract_fips"], r["model"], r["horizon"]) for r in rows}) == len(rows) == 60 * 4
