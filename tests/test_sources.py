from __future__ import annotations

import pytest

from tracklane.runtime import new_path, shared_dir, store
from tracklane.sources.csv_files import convert_reference_tables, land_csv, snake_case_headers
from tracklane.sources.layers import Lake, write_observed
from tracklane.sources.schemas import LANDING_TYPES


def write_lines(path, lines):
    path.write_text("\n".join(lines) + "\n")


def test_land_csv_reads_by_name(spark, tmp_path):
    headers = ["Name", "Goodlift", "Sex", "Event", "Equipment", "Age", "AgeClass", "BodyweightKg", "WeightClassKg", "Best3SquatKg"]
    headers += ["Best3BenchKg", "Best3DeadliftKg", "TotalKg", "Place", "Wilks", "Tested", "Country", "State", "Federation"]
    headers += ["ParentFederation", "Date", "MeetCountry", "MeetName"]
    row = ["Ann Lee", "71.3", "F", "SBD", "Raw", "30.5", "24-34", "62.5", "63", "100", "60", "120", "280", "1", "300.5", "Yes"]
    row += ["AU", "QLD", "PA", "", "2020-02-01", "AU", "State Titles"]
    write_lines(tmp_path / "results.csv", [",".join(headers), ",".join(row), ",".join(["Bo", *row[1:7], "heavy", *row[8:]])])
    df = land_csv(spark, str(tmp_path / "results.csv"))
    assert set(LANDING_TYPES) <= set(df.columns) and "goodlift" in df.columns
    assert dict(df.dtypes)["total_kg"] == "double"
    ann, bo = df.orderBy("name").collect()
    assert (ann.bodyweight_kg, ann.total_kg, ann.parent_federation, ann.date) == (62.5, 280.0, None, "2020-02-01")
    assert bo.bodyweight_kg is None  # not a number


def test_land_csv_names_missing_columns(spark, tmp_path):
    write_lines(tmp_path / "bad.csv", ["Name,Sex", "a,M"])
    with pytest.raises(ValueError, match="missing columns"):
        land_csv(spark, str(tmp_path / "bad.csv"))


def test_snake_case_headers(spark):
    df = spark.createDataFrame([(1, 2)], "Best3SquatKg int, Sex int")
    assert snake_case_headers(df).columns == ["best3_squat_kg", "sex"]


def test_reference_tables(spark, tmp_path):
    source = tmp_path / "csv"
    source.mkdir()
    write_lines(source / "meet-type.csv", ["meet_type,meet_type_id", "local,1", "state,2", "nationals,3", "world,4"])
    write_lines(source / "notes.txt", ["not a table"])
    written = convert_reference_tables(spark, str(source), str(tmp_path / "out"))
    assert list(written) == ["meet-type"]
    got = {tuple(r) for r in spark.read.parquet(written["meet-type"]).collect()}
    assert got == {("local", 1), ("state", 2), ("nationals", 3), ("world", 4)}


def test_lake_overwrites_and_counts(spark, tmp_path):
    lake = Lake(str(tmp_path))
    first = spark.createDataFrame([("a", 1), ("b", None), (None, None)], "k string, v int")
    assert lake.write(first, "raw", "t", cluster_by=["k"]) == {"rows": 3, "nulls_k": 1, "nulls_v": 2}
    assert lake.write(first.limit(1), "raw", "t")["rows"] == 1
    assert lake.read(spark, "raw", "t").count() == 1
    with pytest.raises(ValueError, match="unknown layer"):
        lake.path("gold", "t")


def test_observed_counts_need_no_second_pass(spark, tmp_path):
    seen = write_observed(spark.range(5).selectExpr("id", "IF(id > 2, NULL, id) AS v"), str(tmp_path / "o"))
    assert seen == {"rows": 5, "nulls_id": 0, "nulls_v": 2}


def test_store_writes_under_the_shared_folder(spark):
    df = store(spark.range(3), "numbers")
    assert df.count() == 3
    assert shared_dir(spark) in df.inputFiles()[0]
    assert new_path(spark, "x") != new_path(spark, "x")


def test_readers_see_whole_versions(spark, tmp_path):
    from tracklane.sources.layers import KEEP, CommitConflictError, PublishedTable

    lake, one = Lake(str(tmp_path)), spark.range(3)
    lake.write(one, "raw", "t")
    old = lake.read(spark, "raw", "t")
    lake.write(spark.range(5), "raw", "t")
    assert old.count() == 3 and lake.read(spark, "raw", "t").count() == 5  # a version that is being read stays
    lake.append(one, "raw", "t")
    assert lake.read(spark, "raw", "t").count() == 8
    assert lake.rollback(spark, "raw", "t") == 4 and lake.read(spark, "raw", "t").count() == 5

    published = PublishedTable(spark, lake.path("raw", "t"))
    with pytest.raises(CommitConflictError):
        published._commit(4, published.folders(4))
    with pytest.raises(Exception, match="midway"):
        lake.write(spark.range(9).selectExpr("IF(id = 5, raise_error('midway'), id) AS id"), "raw", "t")
    assert lake.read(spark, "raw", "t").count() == 5 and published.versions()[-1] == 4
    for n in range(4):
        lake.write(spark.range(n), "raw", "t")
    assert len(published.versions()) == KEEP and len([p for p in (tmp_path / "raw" / "t").iterdir() if p.name.startswith("data-")]) == KEEP
    one.write.parquet(str(tmp_path / "raw" / "plain"))
    assert lake.read(spark, "raw", "plain").count() == 3
    with pytest.raises(ValueError, match="no version before"):
        PublishedTable(spark, str(tmp_path / "raw" / "none")).rollback()


TOP = ['"OPL Format v1","by mail:","a@b",', ",,,", '"Federation","Date",,"MeetName"', '"USAPL","2024-03-09",,"Team Champs, at the Fort"', ",,,"]
HEAD = '"Place","Name","Sex","Division","BodyweightKg","Event"'


def test_sectioned_files(spark, tmp_path):
    from tracklane.operators.clean import numeric_place
    from tracklane.sources.csv_files import read_sectioned

    body = [f'"DQ","Person ""{k}""","F","Women\'s, Raw",,"SBD"' for k in range(86)]
    write_lines(tmp_path / "a.opl.csv", [*TOP, HEAD, *body, '"DQ","broken', "1,2,3", ",,,,,"])
    write_lines(tmp_path / "b.opl.csv", ["Place,Name,Sex,Event,Extra", "1,Bo,M,SBD,x"])
    write_lines(tmp_path / "c.opl.csv", ["no,table"])
    rows, rejects = read_sectioned(spark, str(tmp_path))
    found = {r.line: r for r in rows.filter("file LIKE '%/a.opl.csv'").collect()}
    assert len(found) == 86 and min(found) == 7
    first = found[7]
    assert (first.place, first.name, first.division, first.bodyweight_kg) == ("DQ", 'Person "0"', "Women's, Raw", None)
    assert (first.federation, first.date, first.meet_name, first.extra) == ("USAPL", "2024-03-09", "Team Champs, at the Fort", None)
    assert numeric_place(rows.filter("file LIKE '%/a.opl.csv'")).count() == 0
    (bo,) = rows.filter("file LIKE '%/b.opl.csv'").collect()
    assert (bo.name, bo.extra, bo.federation, bo.line) == ("Bo", "x", None, 2)
    bad = {(r.file.rsplit("/", 1)[1], r.line): r.reason for r in rejects.collect()}
    assert bad == {("a.opl.csv", 93): "quotes", ("a.opl.csv", 94): "cells", ("c.opl.csv", 1): "no header"}

    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # lines keep their numbers in split files
    try:
        split, _ = read_sectioned(spark, str(tmp_path), columns=["place", "name", "meet_name"])
        assert {(r.line, r.name) for r in split.collect()} >= {(r.line, r.name) for r in found.values()}
        assert split.columns == ["file", "line", "place", "name", "meet_name"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_reference_folder_with_a_result_file(spark, tmp_path):
    from tracklane.sources.schemas import REFERENCE

    source = tmp_path / "csv"
    source.mkdir()
    write_lines(source / "meet-type.csv", ["meet_type,meet_type_id", "local,1"])
    write_lines(source / "fort.opl.csv", [*TOP, HEAD, '"1","Ann","F","Raw","60","SBD"', "short"])
    written = convert_reference_tables(spark, str(source), str(tmp_path / "out"), REFERENCE)
    assert set(written) == {"meet-type", "fort.opl", "fort.opl-rejects"}
    assert dict(spark.read.parquet(written["meet-type"]).dtypes)["meet_type_id"] == "int"
    assert spark.read.parquet(written["fort.opl"]).first().federation == "USAPL"
    assert spark.read.parquet(written["fort.opl-rejects"]).count() == 1
