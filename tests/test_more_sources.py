import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import history
from lodestrata.sources import readers, sinks, snapshots


def test_layers_keep_all_shapes(spark, tmp_path):
    f = lambda kind, c, **p: {"type": "Feature", "geometry": kind and {"type": kind, "coordinates": c}, "properties": p}
    square = [[[0, 0], [0, 1], [1, 1]]]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [f("Point", [1, 2], name="Stop the plant"), f("Polygon", square, name="zone"), f("MultiPolygon", [square]), f("LineString", [[0, 0], [5, 5]]), f(None, None, name="nowhere")]}))
    got = readers.layers(spark, str(tmp_path), {"protest": "(?i)stop", "area": "zone"}).collect()
    assert [(r["shape"], r["kind"]) for r in got] == [("Point", "protest"), ("Polygon", "area"), ("MultiPolygon", None), ("LineString", None), (None, None)]
    assert (got[0].lon, got[0].lat, got[0].ring) == (1.0, 2.0, None) and [len(r.ring) for r in got[1:4]] == [3, 3, 2] and got[3].ring[1].lat == 5.0


def test_delimited_codes_latest_and_gml(spark, tmp_path):
    (tmp_path / "c.txt").write_text("11001|Aa|Bb\n11002|Cc|\nx|Dd|Ee\n11003|Ff|Ff\n")
    assert sorted(map(tuple, readers.named_codes(spark, str(tmp_path / "c.txt"), "|", 0, [1, 2], r"^\d{5}$").collect())) == [("11001", "Aa"), ("11001", "Bb"), ("11002", "Cc"), ("11003", "Ff")]
    rows = spark.createDataFrame([("a", "2020", "1"), ("a", "2022", "x"), ("a", "2021", "3.5"), (None, "2020", "2"), ("b", None, "2")], "k string, y string, v string")
    assert {tuple(r) for r in readers.latest(rows, "k", "y", "v").collect()} == {("a", 2021, 3.5), (None, 2020, 2.0)}
    g = spark.createDataFrame([("<x:name a='1'> L&#39; eau &lt;</x:name><code>7</code>",), (None,), ("",)], "t string")
    assert [(r["name"], r["code"]) for r in readers.gml_values(g, "t", ["name", "code"]).collect()] == [("L' eau <", "7"), (None, None), (None, None)]


def test_sheets_by_name(spark, tmp_path):
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/><sheet name="Horizon" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/other.xml"/></Relationships>')
        for name, v in (("sheet1", "first"), ("other", "second")):
            z.writestr(f"xl/worksheets/{name}.xml", f'<worksheet xmlns="{ns}"><sheetData><row>{cell("A1", "h")}</row><row>{cell("A2", v)}</row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(raw.getvalue())
    assert [r.h for r in readers.workbook(spark, str(tmp_path), ["h"], "Horizon").collect()] == ["second"]
    assert [r.h for r in readers.workbook(spark, str(tmp_path), ["h"]).collect()] == ["first"]
    with pytest.raises(ValueError):
        readers.sheet_rows(raw.getvalue(), "Nowhere")


def test_snapshots_stand_in(spark, tmp_path):
    path, clock = f"file://{tmp_path}/s", [1000.0]

    def fails():
        raise OSError("down")

    with pytest.raises(snapshots.NoSnapshot):
        snapshots.snapshot(spark, path, fails, 60, now=lambda: clock[0])
    take = lambda n: lambda: spark.range(n)
    for n, at, want in ((3, 1000, (3, True)), (4, 1030, (3, True)), (5, 1100, (5, True)), (6, 1200, (6, True))):
        clock[0] = float(at)
        df, fresh = snapshots.snapshot(spark, path, take(n), 60, now=lambda: clock[0])
        assert (df.count(), fresh) == want
    clock[0] = 9000.0
    df, fresh = snapshots.snapshot(spark, path, fails, 60, now=lambda: clock[0])
    assert (df.count(), fresh) == (6, False) and len(list((tmp_path / "s").glob("data-*"))) == 2


def test_review_sheet_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([("a", "<b>&"), ("b", None)], "k string, v string")
    page = sinks.review_sheet(df, ["k", "v"], "x < y")
    assert "<td>&lt;b&gt;&amp;</td>" in page and "<td></td>" in page and "x &lt; y" in page
    with pytest.raises(ValueError):
        sinks.review_sheet(df, ["k"], "t", most=1)
    for _ in range(2):
        sinks.write_with_provenance(df, str(tmp_path / "d"), ["k"], {"source": "s", "n": 1})
    assert spark.read.json(str(tmp_path / "d/drafts")).count() == 2
    assert {(r.k, r.n_rows, r.provenance.source) for r in spark.read.json(str(tmp_path / "d/provenance")).collect()} == {("a", 1, "s"), ("b", 1, "s")}


def test_place_keys_and_first_words(spark):
    df = spark.createDataFrame([("Lyon 3e Arrondissement", "Groupe Alpha-Beta"), ("Évry", "beta alpha"), (None, None)], "m string, t string")
    got = df.select(text.place_key(F.col("m")).alias("k"), text.first_of(["alpha", "beta"], F.col("t")).alias("w")).collect()
    assert [tuple(r) for r in got] == [("lyon", "alpha"), ("evry", "alpha"), (None, None)]


def test_attributes_are_split_by_rate(spark):
    rows = [("a", d, f"v{d // 9}", f"g{d % 2}", f"h{d % 2}") for d in range(18)]
    obs = spark.createDataFrame(rows, "key string, day int, v string, g string, h string")
    assert history.split_by_rate(obs, ["g", "v", "h"]) == {"v": ["v"], "g+h": ["g", "h"]}
    assert sum(map(len, history.split_by_rate(obs.where("false"), ["g", "v"]).values())) == 2
