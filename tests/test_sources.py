import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import readers, remote, sinks

SITE = {"schema_version": "1.0", "id": "zz-a", "identity": {"name": "A", "coordinates": {"lat": 1.0, "lon": 2.0}}, "indicators": [{"id": "E1", "status": "measured", "value": 42}, {"id": "E2", "status": "measured", "value": "adequate"}, {"id": "E3", "status": "measured", "value": True}]}


def test_sites_and_typed_values(spark, tmp_path):
    (tmp_path / "zz-a.json").write_text(json.dumps(SITE))
    (tmp_path / "zz-a.draft.json").write_text(json.dumps(SITE))
    df = readers.site_records(spark, str(tmp_path))
    assert [r.stem for r in df.collect()] == ["zz-a"]
    got = {r.indicator_id: (r.value_num, r.value_str, r.value_bool) for r in readers.long_indicators(df).collect()}
    assert got == {"E1": (42.0, None, None), "E2": (None, "adequate", None), "E3": (None, None, True)}


def test_one_active_version(spark, tmp_path):
    (tmp_path / "v1.json").write_text("{}")
    assert readers.active_version(spark, str(tmp_path)).count() == 1
    (tmp_path / "v2.json").write_text("{}")
    with pytest.raises(ValueError, match="exactly one"):
        readers.active_version(spark, str(tmp_path))


def test_arrays_and_tables(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps([{"id": "a", "facts": []}, {"id": "b", "facts": [{"kind": "press"}]}]))
    assert readers.watch_entries(spark, str(tmp_path / "w.json")).count() == 2
    (tmp_path / "s.csv").write_text("name,operator,lat,lon,power_mw,project_status\nA,o,1.5,2,,\nB,o,x,2,3,operational\n")
    good, bad = readers.sites_table(spark, str(tmp_path / "s.csv"))
    assert [(r.name, r.power_mw, r.project_status) for r in good.collect()] == [("A", None, "announced")] and bad.count() == 1


def test_charsets(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("nom;état\nÉvry;1\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("﻿nom;état\nÉvry;1\n".encode())
    for f, cs in (("a.csv", "cp1252"), ("b.csv", "utf-8-sig")):
        assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / f), ";", cs).collect()] == [("Évry", "1")]


def test_lines_and_features(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"url": "u", "t": "1"}\nnot json\n{"t": "2"}\n{"url": "u", "t": "3"}\n')
    assert [tuple(r) for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "url string, t string", "url").collect()] == [("u", "1")]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": "Point", "coordinates": [2.0, 1.0]}, "properties": {"name": "n"}}, {"geometry": {"type": "LineString", "coordinates": []}, "properties": {}}]}))
    r = readers.features(spark, str(tmp_path / "f.json")).first()
    assert (r.lon, r.lat, r.properties["name"]) == (2.0, 1.0, "n")


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><r><t>Al</t></r><r><t>pha</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>MW</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>12.5</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.workbook(spark, str(tmp_path / "x.xlsx"), ["Name", "MW", "None"]).collect()] == [("Alpha", "12.5", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0, None), ("a", 2.0, 3.0)], "id string, lon double, lat double")
    sinks.write_artifact(df, str(tmp_path / "o.json"), key="id")
    assert list(json.loads((tmp_path / "o.json").read_text())) == ["a", "b"] and (tmp_path / "o.json").read_text().endswith("}\n")
    first = (tmp_path / "o.json").read_bytes()
    sinks.write_artifact(df.repartition(3), str(tmp_path / "o.json"), key="id")
    assert (tmp_path / "o.json").read_bytes() == first
    assert [json.loads(r.feature)["geometry"]["coordinates"] for r in sinks.features_json(df, "lon", "lat").collect()] == [[2.0, 3.0]]
    with pytest.raises(ValueError, match="more than"):
        sinks.write_artifact(df, str(tmp_path / "p.json"), most=1)
    sinks.write_partitioned(df, str(tmp_path / "t"), ["id"])
    sinks.write_partitioned(df.where("id = 'a'").withColumn("lon", F.lit(9.0)), str(tmp_path / "t"), ["id"])
    assert sorted((r.id, r.lon) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 9.0), ("b", 1.0)]


def test_point_layer_pushes_filters(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    remote.register(spark)
    df = spark.read.format("point_layer").option("fetch", "lodestrata.sources.offline:points").load()
    assert [tuple(r) for r in df.where("label = 'b'").collect()] == [(2, 1.0, 2.0, "b")]
