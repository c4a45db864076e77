"""Units of work that die half-way, late rows, kept lookups and churn that reads only what it needs."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tractloom.operators.concentration import entity_churn
from tractloom.streaming import incremental as S
from tractloom.streaming.units import Units


def test_a_unit_counts_only_with_its_record(spark, tmp_path):
    units = Units(spark, str(tmp_path / "t"))
    assert units.records() == [] and units.read("rows", "x int").count() == 0
    one, two = (spark.createDataFrame([(i,)], "x int") for i in (1, 2))
    units.write("a", {"rows": one})
    two.write.parquet(f"{units.path}/data/b-dead/rows")
    assert [r[0] for r in units.read("rows", "x int").collect()] == [1]
    units.write("a", {"rows": two}, {"note": 1})
    assert [r[0] for r in units.read("rows", "x int").collect()] == [2]
    units.write("b", {"rows": one})
    units.write("c", {"rows": one})
    units.compact("b-merged", {"rows": ("x int", lambda df: df.agg(F.sum("x").cast("int").alias("x")))})
    assert [r.unit for r in units.records()] == ["b-merged", "c"]
    assert sorted(r[0] for r in units.read("rows", "x int").collect()) == [1, 3]


def test_a_batch_killed_between_its_parts_is_replayed_exactly(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 5) for i in range(100)], "id long, k long")
    landing = S.landed_in_turn(rows, [F.col("k") == i for i in range(5)])
    units, calls = Units(spark, str(tmp_path / "t")), []

    def handle(df, batch_id):
        calls.append(batch_id)
        parts = {"rows": df, "sums": df.groupBy("k").agg(F.sum("id").alias("s"))}
        if calls.count(2) == 1 and batch_id == 2:  # dies after one of two parts
            parts["sums"] = parts["sums"].select(F.raise_error(F.lit("disk gone")).alias("k"))
        units.write(S.batch_name(batch_id), parts)

    def run():
        S.run_available(S.read_stream(spark, landing, "*.parquet", files_per_batch=1), str(tmp_path / "c"), handle)

    with pytest.raises(StreamingQueryException):
        run()
    assert units.read("rows", "id long, k long").count() == 40
    run()
    run()
    assert calls == [0, 1, 2, 2, 3, 4]
    assert sorted(r[0] for r in units.read("rows", "id long, k long").collect()) == list(range(100))
    assert units.read("sums", "k long, s long").agg(F.sum("s")).first()[0] == sum(range(100))


APPLICATION = "ts timestamp, tract_fips long, action int, lender string, amount double, race string, ethnicity string, batch int"


def test_late_rows_are_set_aside(spark, tmp_path):
    def at(day):
        return dt.datetime(2024, 1, day, 12)

    given = [(at(10), 0), (at(3), 0), (at(8), 1), (at(4), 1), (at(20), 1), (at(12), 2), (at(15), 2), (None, 2), (at(20), 3), (at(16), 3)]
    rows = spark.createDataFrame([(t, 1, 1, "L1", 5.0, "White", "", b) for t, b in given], APPLICATION)
    landing = S.landed_in_turn(rows, [F.col("batch") == i for i in range(4)])
    stream = S.read_stream(spark, landing, "*.parquet", files_per_batch=1)
    current, late = S.application_stream(stream, str(tmp_path / "s"), delay_days=5, compact_after=2)
    # days before the 5th are late for batch 1, days before the 15th for the later ones
    assert sorted(r["ts"].day for r in late.collect()) == [4, 12]
    kept = {r["period"] and r["period"].day: (r["n_applications"], r["sum_amount"], r["n_distinct_lenders"]) for r in current.collect()}
    assert kept == {3: (1, 5.0, 1), 8: (1, 5.0, 1), 10: (1, 5.0, 1), 15: (1, 5.0, 1), 16: (1, 5.0, 1), 20: (2, 10.0, 1), None: (1, 5.0, 1)}
    assert len(Units(spark, f"{tmp_path}/s/applications").records()) < 4


def test_lookups_are_resolved_once(spark, tmp_path):
    cache, asked = S.LookupCache(spark, str(tmp_path / "c"), "key", "key string, lat double", compact_after=2), []

    def resolve(pending):
        asked.append(sorted(r["key"] for r in pending.collect()))
        return pending.select("key", F.when(F.col("key") != "bad", F.length("key").cast("double")).alias("lat"))

    for keys in (["a", "bb", "a", None], ["bb", "bad"], ["bad", "a"], ["ccc"], ["dddd", "a", "ccc"]):
        got = cache.answer(spark.createDataFrame([(k,) for k in keys], "key string"), resolve).collect()
        assert sorted((str(r["key"]), r["lat"]) for r in got) == sorted((str(k), None if k in (None, "bad") else float(len(k))) for k in keys)
    assert asked == [["a", "bb"], ["bad"], ["ccc"], ["dddd"]]
    assert sorted(r["key"] for r in cache.known().collect()) == ["a", "bad", "bb", "ccc", "dddd"]
    assert len(cache.units.records()) < 4
    # two runs at once: the answer of the first unit stands
    cache.units.write("run-000000000000", {"answers": spark.createDataFrame([("a", 9.0, "run-000000000000")], "key string, lat double, unit string")})
    assert cache.known().where("key = 'a'").count() == 1


def test_churn_reads_only_the_periods_it_needs(spark, tmp_path):
    rows = spark.createDataFrame([(p, f"e{i}", y) for y in range(9) for p in (1, 2) for i in range(6) if (i * y + p) % 3], "place long, entity string, year int")
    landing = S.landed_in_turn(rows, [F.col("year") == y for y in (*range(8), 8)])
    stream = S.read_stream(spark, landing, "*.parquet", files_per_batch=1)
    got = S.churn_stream(stream, str(tmp_path / "s"), "place", "entity", "year", (1, 3))
    want = entity_churn(rows, "place", "entity", "year", (1, 3))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    read = [r.info["folders"] for r in Units(spark, f"{tmp_path}/s/churn").records()]
    assert len(read) == 9 and max(read[5:]) == read[5]  # as many folders in the last batch as in the middle
