import math

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.operators import nearby

RNG = np.random.default_rng(5)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, lat double, lon double")


def brute(a, b, r):
    return {(i, j) for i, x, y in a for j, u, v in b if nearby.great_circle_m(x, y, u, v) <= r}


def around(n, lat, lon, spread, first=0):
    return [(first + k, float(np.clip(lat + RNG.normal(0, spread), -90, 90)), float((lon + RNG.normal(0, spread) + 180) % 360 - 180)) for k in range(n)]


@pytest.mark.parametrize("lat,lon", [(48.0, 2.0), (0.0, 179.999), (89.99, 10.0), (-89.995, -170.0)])
def test_pairs_equal_brute_force(spark, lat, lon):
    a, b = around(60, lat, lon, 0.03), around(120, lat, lon, 0.03)
    got = {(r[0], r[1]) for r in nearby.points_within(frame(spark, a), frame(spark, b), 2000.0).collect()}
    assert got == brute(a, b, 2000.0) and got


def test_splits_and_hot_places(spark, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK_CANDIDATES", 20)
    monkeypatch.setattr(nearby, "BLOCK_QUERIES", 10)
    a = around(80, 10, 10, 0.5) + [(1000 + k, 10.0, 10.0) for k in range(40)]
    b = around(150, 10, 10, 0.5) + [(1000 + k, 10.0, 10.0) for k in range(60)]
    rows = nearby.points_within(frame(spark, a), frame(spark, b), 5000.0).collect()
    assert {(r[0], r[1]) for r in rows} == brute(a, b, 5000.0) and len(rows) == len({(r[0], r[1]) for r in rows})


def test_first_within_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK_CANDIDATES", 20)
    monkeypatch.setattr(nearby, "BLOCK_QUERIES", 10)
    a = around(80, 10, 10, 0.5) + [(1000 + k, 10.0, 10.0) for k in range(40)] + [(2000, -60.0, 10.0)]
    b = around(150, 10, 10, 0.5) + [(1000 + k, 10.0, 10.0) for k in range(60)]
    edges, want = [3000.0, 9000.0, 30000.0], {}
    for i, x, y in a:
        for j, u, v in b:
            ring = int(np.searchsorted(edges, nearby.great_circle_m(x, y, u, v)))
            if ring < 3:
                want[i] = min(want.get(i, (9, 9, 9)), (ring, j % 3, j))
    layered = frame(spark, b).selectExpr("*", "pmod(id, 3) as layer")
    rows = nearby.first_within(frame(spark, a), layered, edges).collect()
    assert {r.query_id: (r.ring, r.layer, r.candidate_id) for r in rows} == want and len(rows) == len(want) and {r[0] for r in want.values()} == {0, 1, 2}
    assert nearby.first_within(frame(spark, a), layered.where("false"), edges).count() == nearby.first_within(frame(spark, []), layered, edges).count() == 0


def test_no_block_of_escalating_match_holds_all_its_pairs(spark, monkeypatch):
    from lodestrata.plans import q_relational

    seen, real = [], nearby.great_circle_m
    monkeypatch.setattr(nearby, "MATRIX_CELLS", 5000)
    monkeypatch.setattr(nearby, "great_circle_m", lambda *x: seen.append(len(x[0])) or real(*x))
    made = {}
    for name in ("_answer", "_first"):
        if hasattr(nearby, name):  # the function that a block is given to
            f = getattr(nearby, name)
            monkeypatch.setattr(nearby, name, lambda *x, f=f: made.setdefault("run", f(*x)))
    tables = spark.range(10).selectExpr("id as c_custkey", "id as s_suppkey", "1.0 as s_acctbal")
    monkeypatch.setattr(q_relational, "table", lambda *x: tables)
    q_relational.escalating_match(spark, "")
    n = 400
    pts = pa.table({"id": np.arange(n), "lat": RNG.normal(0, 1, n), "lon": RNG.normal(0, 1, n), "layer": np.arange(n) % 3})
    assert made["run"](pts, pts).num_rows == n and sum(seen) == n * n and max(seen) <= 5000


def test_places_that_are_none(spark):
    rows = [(1, 0.0, 0.0, 1), (2, None, 1.0, 1), (3, 1.0, float("nan"), 1), (4, 91.0, 1.0, 1), (5, 1.0, -181.0, 1), (None, 1.0, 1.0, 1), (6, 1.0, 1.0, 1), (6, 2.0, 2.0, 2), (6, 2.0, 2.0, 2), (7, 0.0, 5.0, None)]
    df = spark.createDataFrame(rows, "k bigint, lat double, lon double, at int").selectExpr("*", "'x' as id")
    got = sorted((r.id, r.lat, r.lon) for r in nearby.placed(df, "k", "lat", "lon", "at").collect())
    assert got == [(6, 2.0, 2.0), (7, 0.0, 5.0)]


def test_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, 1.0, 1.0)])
    assert nearby.points_within(none, some, 10.0).count() == nearby.points_within(some, none, 10.0).count() == nearby.points_within(none, none, 10.0).count() == 0


RINGS = [(1, [(0, 0), (4, 0), (4, 4), (0, 4)]), (2, [(1, 1), (3, 1), (2, 3)]), (3, [(10, 10), (12, 10), (12, 12), (11, 10.5), (10, 12)]), (4, [(0, 0), (1, 1)]), (5, None), (None, [(0, 0), (1, 0), (1, 1)])]


def regions(spark):
    rows = [(n, None if r is None else [(float(x), float(y)) for x, y in r]) for n, r in RINGS]
    return spark.createDataFrame(rows, "zone bigint, ring array<struct<lon:double,lat:double>>")


@pytest.mark.parametrize("many", [False, True])
def test_regions(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(nearby, "TASK_EDGES", 0)
        monkeypatch.setattr(nearby, "BLOCK_QUERIES", 50)
    pts = [(k, float(RNG.uniform(-1, 13)), float(RNG.uniform(-1, 13))) for k in range(300)] + [(1000 + k, 2.0, 2.0) for k in range(200)]
    got = {(r[0], r[1]) for r in nearby.points_in_regions(frame(spark, pts), nearby.ring_edges(regions(spark), "zone", "ring")).collect()}

    def inside(lat, lon, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (x1 <= lon) != (x2 <= lon) and y1 + (lon - x1) * (y2 - y1) / (x2 - x1) > lat:
                odd = not odd
        return odd

    assert got == {(i, n) for i, lat, lon in pts for n, r in RINGS if n and r and len(r) > 2 and inside(lat, lon, r)}


def test_chord_is_the_arc():
    assert math.isclose(2 * math.asin(nearby.chord(2000.0) / 2) * nearby.EARTH_M, 2000.0, rel_tol=1e-9)
