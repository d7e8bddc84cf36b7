from datetime import datetime

from pyspark.sql import functions as F

from lodestrata.operators import history as h

GROUPS = {"method": ["v"], "grade": ["g"]}


def observed(spark, rows):
    df = spark.createDataFrame(rows, "key string, date string, v string, g string, at timestamp, day string")
    return h.observations(df, F.col("key"), h.day_of(F.col("date")), F.col("at"), {"v": h.version_text(F.col("v")), "g": h.grade_text(F.col("g"))}, ["g"])


def at(k):
    return datetime(2026, 1, 1, 0, 0, k)


def test_notations_and_versions(spark):
    rows = [
        ("a", "2026-01-01", "v0.2.0", "A ", at(1), "x"), ("a", "20260101", "0.2.0", "a", at(1), "x"), ("a", "2026/01/03", " 0.2.0", "B", at(2), "x"), ("a", "2026-01-03T00:00:00Z", "0.2.0", "A", at(3), "x"),
        ("a", "2026-01-05", "0.3.0", "A", at(4), "x"), ("a", "2026-01-06", "0.2.0", "A", at(5), "x"), ("a", "2026-01-06", None, None, at(9), "x"), ("a", None, "9", "C", at(9), "x"), ("a", "soon", "9", "C", at(9), "x"),
        (None, "2026-01-01", "1", "A", at(1), "x"), ("b", "2026-01-01", None, "A", None, "x"),
    ]
    got = sorted(map(tuple, h.as_text(h.versions(h.satellites(observed(spark, rows), GROUPS)), "k").collect()))
    assert got == [("a", "2026-01-01", "2026-01-05"), ("a", "2026-01-05", "2026-01-06"), ("a", "2026-01-06", "9999-12-31"), ("b", "2026-01-01", "9999-12-31")]


def test_days(spark):
    vals = ["2026-1-2", "2026.01.02", "20260102 10:00", "2026-02-30", "", "26-01-02", None, "202601022"]
    df = spark.createDataFrame([(v,) for v in vals], "t string").select(h.day_of(F.col("t")).cast("string"))
    assert [r[0] for r in df.collect()] == ["2026-01-02", "2026-01-02", "2026-01-02", None, None, None, None, None]


def test_appending_equals_loading_at_once(spark):
    first = [("a", "2026-01-01", "1", "A", at(1), ""), ("a", "2026-01-05", "1", "A", at(2), ""), ("b", "2026-01-01", "1", "C", at(1), "")]
    late = [("a", "2026-01-03", "1", "B", at(3), ""), ("c", "2026-01-01", "2", "A", at(3), "")]
    o1, o2 = observed(spark, first), observed(spark, late)
    s1 = h.satellites(o1, GROUPS)
    both = s1.unionByName(h.append(o1, o2, GROUPS, s1))
    want = h.satellites(observed(spark, first + late), GROUPS)
    plain = lambda df: sorted((r.satellite, r.key, str(r.day), r.hash_diff) for r in df.collect())
    assert plain(h.effective(both)) == plain(want)
    assert h.append(o1, observed(spark, []), GROUPS, s1).count() == 0


def test_empty(spark):
    assert h.versions(h.satellites(observed(spark, []), GROUPS)).count() == 0
