import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import records as r
from lodestrata.sources import remote, sinks


def test_hash_is_hmac(spark):
    for secret in (b"", b"k", b"x" * 64, b"y" * 200):
        got = [x[0] for x in spark.createDataFrame([("é",), ("",), (None,)], "m string").select(r.keyed_hash(F.col("m"), secret)).collect()]
        assert got == [hmac.new(secret, m.encode(), hashlib.sha256).hexdigest() for m in ("é", "")] + [None]


def test_items_are_put_in_once(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None), (3, [])], "k int, xs array<string>")
    more = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", 1), (1, "b", 3), (2, "z", 1), (9, "q", 1)], "k int, x string, o int")
    assert {x.k: x.xs for x in r.appended(df, more, "k", "xs", "x", "o").collect()} == {1: ["a", "c", "b"], 2: ["z"], 3: []}


def test_region_else_nearest(spark):
    from lodestrata.operators import nearby

    zones = spark.createDataFrame([(1, [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)])], "z bigint, ring array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0)], "id bigint, lat double, lon double")
    centres = spark.createDataFrame([(1, 1.0, 1.0), (5, 10.0, 10.0)], "id bigint, lat double, lon double")
    edges = nearby.ring_edges(zones, "z", "ring")
    assert sorted(map(tuple, r.region_or_nearest(points, edges, centres).collect())) == [(1, 1, True), (2, 5, False)]
    assert sorted(map(tuple, r.region_or_nearest(points, edges, centres.where("false")).collect())) == [(1, 1, True), (2, None, False)]


def test_states_changes_and_order(spark):
    c = "k string, eligible boolean, grade string"
    last, now = spark.createDataFrame([("a", True, "B"), ("b", True, "B"), ("c", True, None)], c), spark.createDataFrame([("a", False, "C"), ("b", True, "C"), ("c", True, None), ("d", None, None)], c)
    assert {x.k: x.event for x in r.state_changes(last, now, "k", [("eligible", "e"), ("grade", "g")], "new").collect()} == {"a": "e", "b": "g", "d": "new"}
    s = spark.createDataFrame([("x", None, "Réseau"), ("y", 1.0, "reseau"), ("z", 2.0, "other"), ("w", 3.0, None)], "k string, v double, t string")
    assert [x.k for x in r.shown(s, "v", "k", "RÉSEAU", ["t"]).collect()] == ["y", "x"] and [x.k for x in r.shown(s, "v", "k", descending=False).collect()] == ["y", "z", "w", "x"]


def test_first_mention(spark):
    texts = spark.createDataFrame([(1, "In Saint-Luzi near Paven 5 MW"), (2, "Paven without power"), (3, None), (4, "Saint Luzi sur Mer, 4 MW")], "k int, t string")
    places = spark.createDataFrame([("Paven",), ("Saint-Luzi",), ("Saint-Luzi-sur-Mer",), (None,), ("",)], "p string")
    assert {x.k: x.place for x in r.first_mention(texts, "k", "t", places, "p", "MW").collect()} == {1: "Saint-Luzi", 4: "Saint-Luzi-sur-Mer"}


def test_clauses_are_safe():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull

    assert remote.clause(EqualTo(("a",), "x' OR '1'='1")) == "a = 'x'' OR ''1''=''1'" and remote.clause(GreaterThan(("a",), 3)) == "a > 3"
    assert remote.clause(In(("a",), (1, "b"))) == "a IN (1, 'b')" and remote.clause(In(("a",), (1, None))) is None
    assert [remote.clause(f) for f in (EqualTo(("a b",), 1), EqualTo(("a", "b"), 1), EqualTo(("a",), float("nan")), EqualTo(("a",), "x\n"), IsNull(("a",)))] == [None] * 5


def test_reports_never_drop_rows(spark):
    m = spark.range(5).selectExpr("cast(id as string) as k", "id as n")
    assert sinks.coverage_report(m, "k", ["n"]).count("\n") == 7
    with pytest.raises(ValueError):
        sinks.coverage_report(m, "k", ["n"], most=4)
