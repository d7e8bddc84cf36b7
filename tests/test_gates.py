import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import artifacts, gates
from lodestrata.sources import readers

SRC = {"title": "t", "url": "https://x.example/1"}


def site(**over):
    s = {
        "id": "aa-x", "identity": {"name": "X", "country": "AA", "project_status": "operational", "power_mw": 12.0, "power_mw_status": "measured", "coordinates": {"lat": 1.234, "lon": 2.345}},
        "indicators": [{"id": "E1", "status": "measured", "value": 5, "source": SRC}, {"id": "L2", "status": "measured", "value": 7, "source": SRC}],
        "score_history": [{"date": "2026-01-01", "methodology_version": "1", "grades": {"site": "B", "project_process": "C"}, "confidence": "high", "event": "first"}],
    }
    s.update(over)
    return s


def load(spark, tmp_path, s):
    (tmp_path / "aa-x.json").write_text(json.dumps(s))
    df = readers.site_records(spark, str(tmp_path))
    return df, readers.long_indicators(df)


@pytest.mark.parametrize(
    "over,gate",
    [
        ({}, None),
        ({"id": "bb"}, "id"),
        ({"indicators": [{"id": "E1", "status": "missing"}]}, "indicators"),
        ({"indicators": [{"id": "E1", "status": "measured", "value": 1}, {"id": "L2", "status": "missing"}]}, "source"),
        ({"indicators": [{"id": "E1", "status": "not_collected", "source": SRC}, {"id": "L2", "status": "missing"}]}, "source"),
        ({"indicators": [{"id": "E1", "status": "missing"}, {"id": "L2", "status": "estimated", "value": 1, "source": SRC}]}, "estimate"),
        ({"score_history": [{"date": "1"}, {"date": "2"}]}, "journal"),
    ],
)
def test_each_gate_fires_alone(spark, tmp_path, over, gate):
    sites, facts = load(spark, tmp_path, site(**over))
    assert {r.gate for r in gates.all_gates(sites, facts, ["E1", "L2"]).collect()} == ({gate} if gate else set())


def test_texts_keys_weights_orders(spark):
    t = spark.createDataFrame([(1, "It was given the grade B today"), (2, "a building B permit"), (3, None), (4, "noté C")], "k int, t string")
    assert sorted(r.entity for r in gates.letters_in_prose(t, "k", "t").collect()) == ["1", "4"]
    raw = spark.createDataFrame([(1, '{"a": [{"b": {"grade": 1}}]}'), (2, '{"a": "\\"grade\\": 1", "Grade_": 2}'), (3, None), (4, '{"grade"'), (5, '["note"]')], "k int, p string")
    assert [r.entity for r in gates.grade_like_keys(raw, "k", "p").collect()] == ["1"]
    d = spark.createDataFrame([("p", 0.5, 1), ("p", 0.5, 2), ("q", 0.4, 1), ("q", 0.3, 2)], "g string, w double, o int")
    assert [r.entity for r in gates.weights(d, "g", "w").collect()] == ["q"] and [r.entity for r in gates.monotone(d, "g", "o", "w").collect()] == ["q"]


def test_public_projection_and_journal(spark, tmp_path):
    sites, _ = load(spark, tmp_path, site())
    scores = spark.createDataFrame([("aa-x", "B", "C", "high")], "id string, site_grade string, process_grade string, confidence string")
    p = artifacts.public_points(artifacts.real_sites(sites), scores).first()
    assert (p.lat, p.lon, p.size_tier) == (1.23, 2.35, 2) or (p.lat, p.lon, p.size_tier) == (1.23, 2.34, 2)
    assert artifacts.unrecorded_changes(sites, artifacts.with_journal_fields(scores, "1")).count() == 0
    assert artifacts.unrecorded_changes(sites, artifacts.with_journal_fields(scores.withColumn("site_grade", F.lit("A")), "1")).count() == 1
    m = artifacts.masked(scores, F.lit(True), ["site_grade"], ["confidence"]).first()
    assert m.site_grade == "pending" and m.confidence is None


def test_definitions(spark):
    defs = spark.createDataFrame([("E1", "p"), ("E1", "p"), ("E2", "x")], "indicator string, pillar string")
    pillars = spark.createDataFrame([("p",)], "pillar string")
    assert sorted((r.entity, r.message) for r in gates.pillar_references(defs, pillars).collect()) == [("E1", "the indicator is defined twice"), ("E2", "the pillar is unknown")]
    rows = [("ok", ["a", "b"], {"b": 1.0, "a": 2.0}), ("rises", ["a", "b"], {"a": 1.0, "b": 2.0}), ("short", ["a"], {"a": 1.0, "b": 2.0}), ("none", None, {"a": 1.0}), ("empty", [], {}), ("nocat", ["a"], None)]
    d = spark.createDataFrame(rows, "indicator string, order array<string>, categories map<string,double>")
    assert sorted((r.entity, r.message[:10]) for r in gates.exact_order(d).collect()) == [("nocat", "the declar"), ("rises", "scores ris"), ("short", "the declar")]


def test_traces_versions_and_provenance(spark, tmp_path):
    src = {**SRC, "title": "Puissance 12.5 MW (presse locale)"}
    s = site(indicators=[{"id": "T2", "status": "measured", "value": "partial", "source": SRC}, {"id": "E1", "status": "missing"}, {"id": "E4", "status": "not_collected"}, {"id": "L2", "status": "measured", "value": 7, "source": src}, {"id": "W4", "status": "measured", "value": 1, "source": SRC}], publication={"status": "published"})
    sites, facts = load(spark, tmp_path, s)
    got = {(r.gate, r.entity) for r in gates.all_gates(sites, facts, ["E1", "E4", "L2", "T2", "W4"], version="2", published=False, project_ids=["E1"], scored_ids=["E4"]).collect()}
    assert got == {("trace", "aa-x"), ("power", "aa-x"), ("version", "aa-x"), ("verification", "aa-x")}
    assert gates.read_traces(sites, facts, ["E1"], ["E4"]).count() == 2 and gates.against_draft(sites, "1", True).count() == 0
    ok = load(spark, tmp_path, site(indicators=[{"id": "W4", "status": "measured", "value": 1, "source": SRC, "verification_source": SRC}]))[1]
    assert gates.declared_as_measured(ok).count() == 0 and gates.power_provenance(ok).count() == 0


def test_banned_terms(spark):
    t = spark.createDataFrame([(1, "A SCANDALE!"), (2, "scandaleux"), (3, None), (4, "c'est du green-washing (sic)")], "k int, t string")
    assert sorted(r.entity for r in gates.banned_terms(t, "k", "t", ["scandale", "green-washing"]).collect()) == ["1", "4"] and gates.banned_terms(t, "k", "t", []).count() == 0


def test_ids_twice(spark):
    assert [r.entity for r in gates.twice(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string"), "id").collect()] == ["a"]


def test_the_set_of_artifacts(spark, tmp_path):
    entry = {"id": "w1", "name": "W", "country": "AA", "coordinates": {"lat": 1.239, "lon": 2.349}, "facts": [{"kind": "b"}, {"kind": "a"}, {"kind": "b"}, {}]}
    (tmp_path / "in").mkdir()
    sites, facts = load(spark, tmp_path / "in", site(publication={"status": "published"}))
    (tmp_path / "w.json").write_text(json.dumps([entry, {**entry, "id": "w2", "coordinates": None, "facts": None}]))
    entries = readers.watch_entries(spark, str(tmp_path / "w.json"))
    scores = spark.createDataFrame([("aa-x", "B", 70.0, "C", "high", {"p": "A", "q": "insufficient_data"})], "id string, site_grade string, site_score double, process_grade string, confidence string, pillars map<string,string>")
    defs = spark.createDataFrame([("E1", "label", "p", "site")], "indicator_id string, label string, pillar string, block string")
    got = artifacts.build(sites, facts, defs, scores, entries)
    n = {k: df.count() for k, df in got.items()}
    assert n == {"scores": 1, "map": 1, "details": 1, "audit": 1, "watchlist": 1, "ordinary": 0, "wall": 1}
    assert got["watchlist"].first().kinds == ["a", "b"] and got["scores"].first().publication_status == "published" and got["audit"].first().seq == 0
    artifacts.write(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "details")).where("part = 'aa'").count() == 1
    own = spark.createDataFrame([("a", 50.0, True, 4, False, None, None), ("b", 51.0, True, 4, None, 1.0, 1.0), ("c", 60.0, True, 3, False, None, None), ("d", 49.0, True, 5, True, None, None), ("e", 52.0, None, 5, False, None, None), ("f", 90.0, True, 4, False, 5.0, 5.0)], "id string, score double, operating boolean, pillars int, contested boolean, lat double, lon double")
    assert [r.id for r in artifacts.ordinary(own, spark.createDataFrame([(1.04, 1.04), (None, 1.0)], "lat double, lon double")).collect()] == ["a", "f"]
