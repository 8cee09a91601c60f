"""Readers and writers on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from streetworth.functions import columns as C
from streetworth.sources import readers, writers


def test_csv_header_is_checked_and_its_mark_dropped(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿zone,n\na,3\nb,-999\n".encode())
    rows = readers.read_csv_checked(spark, str(tmp_path / "a.csv"), ["zone", "n"])
    assert sorted(map(tuple, rows.collect())) == [("a", "3"), ("b", "-999")]
    with pytest.raises(ValueError):
        readers.read_csv_checked(spark, str(tmp_path / "a.csv"), ["zone", "missing"])


def test_json_records_and_features(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"id": "a", "n": 1}, {"id": "b"}]}))
    assert sorted(map(tuple, readers.read_records(spark, str(tmp_path / "r.json"), "id: string, n: bigint").collect())) == [("a", 1), ("b", None)]
    feature = {"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}}
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    row = readers.read_features(spark, str(tmp_path / "g.json"), "name: string").first()
    assert (row.name, row.geometry_type, json.loads(row.coordinates)) == ("x", "Point", [1.5, 2])
    (tmp_path / "bad.json").write_text('{"type": "Feature", "features": []}')
    with pytest.raises(Exception, match="FeatureCollection"):
        readers.read_features(spark, str(tmp_path / "bad.json"), "name: string").collect()


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("stops.txt", "﻿stop_id,stop_name\nhub,Hub\nquay,\n")
    rows = readers.read_zipped_csv(spark, str(tmp_path / "feed.zip"), "stops.txt", ["stop_id", "stop_name", "parent_station"])
    assert sorted(tuple(r)[1:] for r in rows.collect()) == [("hub", "Hub", None), ("quay", "", None)]
    with pytest.raises(Exception, match="no trips"):
        readers.read_zipped_csv(spark, str(tmp_path / "feed.zip"), "trips.txt", ["trip_id"]).collect()


def test_workbook(spark, tmp_path):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<row r="1"><c r="A1" t="inlineStr"><is><t>Counts</t></is></c></row><row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="AB3" t="s"><v>2</v></c></row>'
    cells += '<row r="4"><c r="A4"><v>45292</v></c><c r="B4"><v>10</v></c><c r="AB4"><v>7</v></c></row><row r="5"><c r="A5"><v>45293</v></c><c r="B5"><v>20</v></c></row>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>Time</t></si><si><t>Bridge</t></si><si><r><t>Quay </t></r><r><t>Street</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {m}><sheetData>{cells}</sheetData></worksheet>")
    spark.dataSource.register(readers.Workbook)
    found = spark.read.format("workbook").option("paths", str(tmp_path / "w.xlsx")).load()
    series = readers.counter_series(found).select("site", F.col("day").cast("string"), "count")
    assert sorted(map(tuple, series.collect())) == [("Bridge", "2024-01-01", 10.0), ("Bridge", "2024-01-02", 20.0), ("Quay Street", "2024-01-01", 7.0)]


def test_counts_are_required(spark):
    assert readers.require_count(spark.range(3), expected=3, least=2).count() == 3
    for bad in ({"expected": 4}, {"least": 4}):
        with pytest.raises(ValueError):
            readers.require_count(spark.range(3), **bad)


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "=1+1", 1.0, None), ("b", "plain", 1.0, None), ("c", "-x", 2.0, "k")], "id string, note string, score double, extra string")
    writers.write_ledger(rows, str(tmp_path / "ledger"), ["id"])
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 3
    writers.write_guarded_csv(rows, str(tmp_path / "csv"))
    assert {r.note for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"'=1+1", "plain", "'-x"}
    references, dictionary = writers.encode_compact(rows, ["score", "extra"])
    assert dictionary.count() == 2 and "score" not in references.columns
    assert sorted(map(str, writers.decode_compact(references, dictionary).select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert rows.select(writers.canonical_json(rows).alias("j")).where("id = 'a'").first().j == '{"extra":null,"id":"a","note":"=1+1","score":1.0}'
    other = rows.select("score", "note", "extra", "id")
    assert {r[0] for r in rows.select(writers.stable_id(rows)).collect()} == {r[0] for r in other.select(writers.stable_id(other)).collect()}
    writers.write_features(rows.select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")), str(tmp_path / "geo"), kind="Point")
    assert {json.loads(r.value)["properties"]["id"] for r in spark.read.text(str(tmp_path / "geo")).collect()} == {"a", "b", "c"}


def test_column_helpers(spark):
    row = spark.range(1).select(
        C.speed_kph(F.lit("30 mph;50")).alias("a"), C.speed_kph(F.lit("walk")).alias("b"), C.speed_kph(F.lit("50;30")).alias("c"), C.bearing_difference(F.lit(350.0), F.lit(10.0)).alias("d"),
        C.bearing_difference(F.lit(0.0), F.lit(100.0)).alias("e"), C.distance_decay(F.lit(17.0)).alias("f"), C.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("g"),
        C.inverse_triangular(F.lit(0.25), 2.0, 4.0, 10.0).alias("h"), C.inverse_loguniform(F.lit(0.5), 1.0, 4.0).alias("i"),
    ).first()
    assert row.a == pytest.approx(48.28032) and row.b is None and row.c == 50 and row.d == 20 and row.e == 80
    assert row.f == pytest.approx(0.36787944) and row.g == pytest.approx(111195.08, abs=0.1) and row.h == pytest.approx(4.0) and row.i == pytest.approx(2.0)
