"""Readers on small files in the sources' own formats."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from tractloom.operators import learning, serving
from tractloom.sources import disclosure, drift, roster, sinks, tables


def fixed(length, **fields):
    line = [" "] * length
    for start, text in fields.values():
        line[start:start + len(text)] = text
    return "".join(line)


@pytest.fixture()
def tree(tmp_path):
    d6 = lambda tract, ind="Y", lender="0000000012": fixed(48, p=(0, "D6-0"), r=(5, lender), a=(15, "3"), y=(16, "2020"), s=(20, "17"), c=(22, "031"), t=(30, tract), i=(47, ind))
    d1 = fixed(145, p=(0, "D1-1"), r=(5, "0000000012"), a=(15, "3"), s=(22, "17"), c=(24, "031"), l=(42, "040"), m=(45, "         2        20         x        10         1         5"))
    for year in ("2019", "2020"):
        (tmp_path / year / "discl").mkdir(parents=True)
        (tmp_path / year / "trans").mkdir()
        lines = [d6("0101.00"), d6("0101.00"), d6("   1.02"), d6("NA     "), d6("0103.00", "N"), d6("0104.00")[:40], d1, d1.replace("040", "060"), d1[:120]]
        (tmp_path / year / "discl" / "a.DAT").write_bytes("\r\n".join(lines).encode("latin-1"))
        (tmp_path / year / "discl" / "notes.pdf").write_text("x")
        name = fixed(122, r=(0, "0000000012"), a=(10, "3"), y=(11, year), n=(15, "BANCO \xd1U\xd1OA \"A\""), c=(85, "CHICAGO"), s=(110, "IL"), z=(112, "60601"))
        (tmp_path / year / "trans" / "t.txt").write_bytes((name + "\n" + name[:100]).encode("latin-1"))
    (tmp_path / "other").mkdir()
    return tmp_path


def test_disclosure(spark, tree):
    lines = disclosure.read_lines(spark, f"{tree}/*/discl/*.DAT")
    presence = disclosure.parse_presence(lines)
    got = {(r["tract_fips"], r["lender_id"], r["year"]) for r in presence.collect()}
    assert got == {(t, "3_0000000012", y) for t in ("17031010100", "17031000102") for y in (2019, 2020)}
    totals = disclosure.parse_totals(lines).where("year = 2020").collect()
    assert len(totals) == 1 and (totals[0]["count_lt_100"], totals[0]["amount_lt_100"], totals[0]["count_100_250"], totals[0]["count_250_1m"]) == (2, 20.0, 0, 1)
    profile = {r["record_type"]: (r["n"], r["min_length"], r["max_length"]) for r in drift.record_profile(lines.where("year = 2020"), []).collect()}
    assert profile["D6-0"] == (6, 40, 48) and profile["D1-1"] == (3, 120, 145)


def test_transmittal_keeps_latin_letters(spark, tree):
    r = disclosure.parse_transmittal(disclosure.read_lines(spark, f"{tree}/2020/trans/*.txt")).collect()
    assert len(r) == 1 and r[0]["name"] == 'BANCO \xd1U\xd1OA "A"' and r[0]["zip"] == "60601" and r[0]["activity_year"] == 2020


def test_discovery(spark, tree):
    got = {(r["path"].rsplit("/", 1)[1], r["year"]) for r in disclosure.discover(spark, str(tree), "discl").collect()}
    assert got == {("a.DAT", 2019), ("a.DAT", 2020)}
    assert [r["year"] for r in disclosure.discover(spark, str(tree), "trans", [2020]).collect()] == [2020]


def test_branch_files_may_order_columns_differently(spark, tmp_path):
    (tmp_path / "sod_2019.csv").write_text("YEAR,UNINUMBR,CERT,RSSDID,STCNTYBR,DEPSUMBR,SIMS_LATITUDE,SIMS_LONGITUDE\n2019,1,10,,1001,\"1,500\",40.0,-90.0\n2019,2,11,,1001,5,99.0,-90.0\n")
    (tmp_path / "sod_2020.csv").write_text("CERT,UNINUMBR,SIMS_LONGITUDE,SIMS_LATITUDE,STCNTYBR\n10,1,-90.0,17.0,1001\n,3,,,1001\n")
    files = [f"{tmp_path}/sod_2019.csv", f"{tmp_path}/sod_2020.csv"]
    got = {(r["branch_id"], r["year"], r["county_fips"], r["deposits"], r["lat"]) for r in tables.read_branches(spark, *files).collect()}
    assert got == {("1", 2019, "01001", 1500.0, 40.0), ("1", 2020, "01001", 0.0, 17.0)}
    assert tables.read_market_branches(spark, *files).count() == 3


def test_header_json(spark, tmp_path):
    d = tmp_path / "acs5_2020"
    d.mkdir()
    (d / "state_17.json").write_text(json.dumps([["B01003_001E", "B19013_001E", "state", "county", "tract"], ["120", "-666666666", "17", "31", "101"], ["5", "10", "17", "31", "bad"]]))
    (d / "state_18.json").write_text("[]")
    got = tables.survey_estimates(tables.read_header_json(spark, f"{tmp_path}/*/*.json")).collect()
    assert [(r["tract_fips"], r["vintage"], r["population"], r["median_hh_income"]) for r in got] == [("17031000101", 2020, 120.0, None)]


def test_loan_families(spark, tmp_path):
    (tmp_path / "foia-7a.csv").write_text("borrstate,borrzip,approvaldate,grossapproval,sbaguaranteedapproval,bankname\nil,60601-1,2020-01-02,\"$1,000\",750,First\nIL,6060,01/02/2008,5,5,Old\nILL,60601,2020-01-01,1,1,x\n")
    (tmp_path / "foia-504.csv").write_text("cdc_name,borrstate,borrzip,asofdate,approvaldate,grossapproval\nCdc,IL,501,2021-05-05,,oops\n")
    got = {tuple(r) for r in tables.read_loans(spark, f"{tmp_path}/foia-7a*.csv", f"{tmp_path}/foia-504*.csv").collect()}
    assert got == {("IL", "60601", 2020, "7a", "First", 1000.0, 750.0), ("IL", "00501", 2021, "504", "Cdc", 0.0, 0.0)}


def test_crosswalk_files(spark, tmp_path):
    old = ["0"] * 27
    old[3], old[12], old[25] = "1001020100", "01001020200", "40.5"
    (tmp_path / "old.txt").write_text("\n".join([",".join(old), ",".join(old[:20]), ",".join(old).replace("40.5", "0")]))
    assert [tuple(r) for r in tables.read_old_crosswalk(spark, f"{tmp_path}/old.txt").collect()] == [("01001020100", "01001020200", 0.405)]
    head = "OID|GEOID_TRACT_20|c|d|e|f|g|h|GEOID_TRACT_10|j|k|l|m|n|AREALAND_PART|p"
    new = ["x"] * 16
    new[1], new[8], new[10], new[14] = "17031010100", "17031010200", "200", "50"
    (tmp_path / "new.txt").write_text("﻿" + head + "\n" + "|".join(new) + "\n" + "|".join(new).replace("200|", "0|") + "\n")
    assert [tuple(r) for r in tables.read_new_crosswalk(spark, f"{tmp_path}/new.txt").collect()] == [("17031010200", "17031010100", 0.25)]


def test_ragged_roster(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Minority institutions,,\n,,\nCertificate Number,Name,City\n12.0,First,Here\n,Total,\n12,First again,Here\n34,Second,There\n")
    got = {(r["id"], r["cells"][1]) for r in roster.ragged_sheet(roster.read_sheet_csv(spark, f"{tmp_path}/m.csv"), ["file"], "line", "cells").collect()}
    assert got == {("12", "First"), ("34", "Second")}


def test_sheet_cells_with_commas_and_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('1,"First Bank, N.A.",City\n2,"The ""Old"" Bank", Town\n')
    got = [r["cells"] for r in roster.read_sheet_csv(spark, f"{tmp_path}/q.csv").orderBy("line").collect()]
    assert got[:2] == [["1", "First Bank, N.A.", "City"], ["2", 'The "Old" Bank', "Town"]]


def test_headers_with_a_pipe(spark, tmp_path):
    (tmp_path / "zip_2020.txt").write_text("GEOID|NAME\n1|2\n")
    assert drift.headers(spark, f"{tmp_path}/zip_2020.txt", sep="|").first()["columns"] == ["geoid", "name"]


def test_headers_with_quoted_separators(spark, tmp_path):
    (tmp_path / "loans_2021.csv").write_text('\ufeff"Name, legal",Amount,"He said ""no""", "State",""\n"a, b",1,2,3,4\n', encoding="utf-8")
    got = drift.headers(spark, f"{tmp_path}/loans_2021.csv").first()
    assert got["columns"] == ["name, legal", "amount", 'he said "no"', "state", ""] and got["n_rows"] == 1


def test_schema_drift(spark, tmp_path):
    (tmp_path / "sod_2019.csv").write_text("A,B,Old\n1,2,3\n1,2,3\n")
    (tmp_path / "sod_2020.csv").write_text("A,B,New\n1,2,3\n")
    got = {r["year"]: (r["added"], r["removed"], r["n_rows"]) for r in drift.schema_drift(drift.headers(spark, f"{tmp_path}/*.csv")).collect()}
    assert got == {2019: (["old"], ["new"], 2), 2020: ([], [], 1)}


def test_records_leave_out_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, None), ("b", float("nan"), None), ("c", None, 2.0)], "k string, x double, y double")
    sinks.write_json(sinks.keyed_records(df, "k", ["x", "y"]), f"{tmp_path}/r", gzip=True)
    rows = [json.loads(line) for f in (tmp_path / "r").glob("*.gz") for line in gzip.open(f, "rt")]
    assert {r["k"]: json.loads(r["record"]) for r in rows} == {"a": {"x": 1.2346}, "c": {"y": 2.0}}


def test_geojson_attributes(spark):
    text = json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0.0, 1.0], [2.0, 3.0]]]}, "properties": {"GEOID": g}} for g in ("01", "02")]})
    attributes = spark.createDataFrame([("01", 0.5)], "tract string, risk double")
    got = sinks.attach_properties(spark.createDataFrame([(text,)], "value string"), attributes, "tract", "GEOID").collect()
    assert len(got) == 1 and json.loads(got[0]["value"])["properties"] == {"tract": "01", "risk": 0.5}


def test_geometries_of_any_depth(spark):
    """Several parts, holes, lines, heights and collections keep their coordinates and have a box."""
    shapes = {
        "1": {"type": "MultiPolygon", "coordinates": [[[[0.125, 1], [4, 1], [4, 5], [0.125, 1]], [[1, 2], [2, 2], [2, 3], [1, 2]]], [[[-10.5, 7], [-9, 7], [-9, 8e0], [-10.5, 7]]]]},
        "2": {"type": "LineString", "coordinates": [[1e-7, 2, 300.0], [3, -4, 500.0]]},
        "3": {"type": "Point", "coordinates": [5.25, 6]},
        "4": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "LineString", "coordinates": [[3, 4], [0, 9]]}]},
        "5": {"type": "Polygon", "coordinates": []},
    }
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": {"GEOID": k, "n": 1}} for k, g in shapes.items()]})
    one = json.dumps({"type": "Feature", "geometry": None, "properties": {"GEOID": "6"}})
    given = spark.createDataFrame([(text,), (one,), ("not json",)], "value string")
    attributes = spark.createDataFrame([(i, i / 2) for i in range(1, 7)], "tract int, risk double")
    out = sinks.attach_properties(given, attributes, "tract", "GEOID")
    got = {r["tract"]: json.loads(r["value"]) for r in out.collect()}
    assert {str(k): v.get("geometry") for k, v in got.items()} == shapes | {"6": None}
    assert got[1]["properties"] == {"tract": 1, "risk": 0.5}
    boxes = sinks.parsed_features(out).select(F.element_at("f.properties", "tract").alias("k"), serving.geometry_bounds("f.geometry").alias("b")).collect()
    assert {r["k"]: r["b"] and tuple(r["b"]) for r in boxes} == {
        "1": (-10.5, 1.0, 4.0, 8.0), "2": (1e-7, -4.0, 3.0, 2.0), "3": (5.25, 6.0, 5.25, 6.0), "4": (0.0, 2.0, 3.0, 9.0), "5": None, "6": None}


def test_feature_lists(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3)], "a int, b double, c string, leak int")
    assert learning.usable_features(df, ["b", "c", "a", "leak", "gone"], {"leak"}) == ["b", "a"]
    assert learning.common_columns([df, df.drop("b")]) == ["a", "c", "leak"]


def test_leaks_never_reach_features(spark):
    from tractloom.operators.feature_lists import INFLUENCEABLE, leaks_label

    leaks = ["tract_fips", "target_becomes_any_desert_h6", "is_any_desert", "n_cra_lenders", "cra_lender_presence_ratio_1yr",
             "fdic_branch_count", "fdic_total_branch_deposits_k_pctchg3yr", "becomes_is_service_desert_h3", "service_desert_score"]
    kept = ["fdic_deposit_hhi", "fdic_bank_count_pctchg3yr", "cra_lender_churn_2yr", "fdic_top_bank_share_chg1yr", "cra_county_count_hhi", "pct_poverty", *INFLUENCEABLE]
    assert all(map(leaks_label, leaks)) and not any(map(leaks_label, kept))


def test_scratch_is_removed_when_its_work_is_done(spark):
    from tractloom.session import discard, fresh_path, reads_from, recording, shared_folder, stored

    kept = fresh_path(spark, "kept")
    with recording() as mine:
        rows = stored(spark.range(10), "inner")
        with recording() as inner:
            stored(spark.range(3), "innermost")
        rows.write.parquet(kept)
    assert len(mine.paths) == len(inner.paths) == 1
    written = spark.read.parquet(kept)
    assert reads_from(rows, mine) and not reads_from(written, mine) and not reads_from(rows, inner)
    names = {os.path.basename(p) for p in mine.paths + inner.paths}
    assert names <= set(os.listdir(shared_folder(spark)))
    discard(spark, mine)
    discard(spark, inner)
    assert not names & set(os.listdir(shared_folder(spark)))
    assert written.count() == 10
