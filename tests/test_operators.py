import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import rules, text
from lodestrata.operators import ranking, scoring, spatial, stats, tables


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize("score,grade", [(80.0, "A"), (79.95, "A"), (79.94, "B"), (64.95, "B"), (50.0, "C"), (34.9, "E"), (0.0, "E"), (None, None)])
def test_letters_are_cut_on_the_rounded_score(spark, score, grade):
    assert one(spark, rules.letter(F.lit(score).cast("double"))) == grade


def test_rules(spark):
    assert one(spark, rules.by_steps(F.lit(50.0), [(50, 100.0), (150, 60.0), (400, 30.0)], 0.0)) == 100.0
    assert one(spark, rules.by_steps(F.lit(401.0), [(50, 100.0), (150, 60.0), (400, 30.0)], 0.0)) == 0.0
    assert one(spark, rules.between_bounds(F.lit(-5.0), 0, 50)) == 0.0 and one(spark, rules.between_bounds(F.lit(25.0), 0, 50, True)) == 50.0
    assert one(spark, rules.capped(F.lit(100.0), F.lit("announced"))) == 60.0 and one(spark, rules.capped(F.lit(100.0), F.lit("measured"))) == 100.0
    assert one(spark, rules.substantive(F.lit(None).cast("double"), F.lit("missing"), F.lit("project"))) == 0.0
    assert one(spark, rules.substantive(F.lit(None).cast("double"), F.lit("missing"), F.lit("base"))) is None
    assert one(spark, rules.by_rubric({"a": F.lit("true"), "b": rules.count_class(F.lit(3))}, {"a": {"true": 25.0}, "b": {"2_or_more": 7.0}})) == 32.0
    with pytest.raises(Exception, match="unknown category"):
        one(spark, rules.by_category(F.lit("?"), {"a": 1.0}, strict=True))


def test_site_scores(spark):
    p = {"energy": 0.25, "water": 0.20, "land": 0.20, "local": 0.20, "transparency": 0.15}
    grid = [("E1", "energy", 0.15), ("E2", "energy", 0.35), ("E3", "energy", 0.25), ("W1", "water", 0.30), ("W2", "water", 0.20), ("F1", "land", 0.20), ("L1", "local", 0.15)]
    vals = {"E1": 100.0, "E2": 70.0, "E3": 65.0, "W1": 60.0, "W2": 80.0, "F1": 100.0, "L1": None}
    rows = [("s", pil, p[pil], w, vals[i], vals[i], "base", "measured" if vals[i] is not None else "missing", 1.0) for i, pil, w in grid]
    df = spark.createDataFrame(rows, "site string, pillar string, pillar_weight double, weight double, norm double, sub double, block string, status string, tier_weight double")
    energy, water = (0.15 * 100 + 0.35 * 70 + 0.25 * 65) / 0.75, (0.30 * 60 + 0.20 * 80) / 0.5
    want = (0.25 * energy + 0.20 * water + 0.20 * 100) / 0.65
    assert scoring.two_level_mean(df, ["site"]).first().score == pytest.approx(want)
    card = scoring.scorecard(df, ["site"]).first()
    assert card.score == pytest.approx(want) and card.grade == "A"
    c = scoring.confidence(df, ["site"]).first()
    assert c.level == "high" and 0 < c.gap < 0.1


def test_hiding_data_never_helps(spark):
    base = [("s", "p", 1.0, 1.0, 90.0, 90.0), ("s", "p", 1.0, 1.0, None, 0.0), ("s", "p", 1.0, 1.0, 10.0, 10.0)]
    df = spark.createDataFrame(base, "site string, pillar string, pillar_weight double, weight double, norm double, sub double")
    assert scoring.two_level_mean(df, ["site"]).first().score == pytest.approx(100 / 3)
    assert scoring.two_level_mean(df.where("false"), ["site"]).count() == 0
    zero = df.withColumn("weight", F.lit(0.0))
    assert scoring.two_level_mean(zero, ["site"]).first().score is None


def test_merge_is_idempotent(spark):
    base = spark.createDataFrame([(1, "confirmed", "t1"), (2, "unsubscribed", "t2")], "id int, status string, token string")
    new = spark.createDataFrame([(1, "pending", "n1"), (2, "pending", "n2"), (3, "pending", "n3")], "id int, status string, token string")
    keep = {"status": F.when(F.col("o_status") == "unsubscribed", "pending").otherwise(F.coalesce("o_status", "n_status"))}
    once = tables.merged(base, new, "id", keep, ["token"])
    assert sorted(map(tuple, once.collect())) == [(1, "confirmed", "n1"), (2, "pending", "n2"), (3, "pending", "n3")]
    assert sorted(map(tuple, tables.merged(once, new, "id", keep, ["token"]).collect())) == sorted(map(tuple, once.collect()))


def test_first_and_last_with_ties(spark):
    df = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("a", 2, "z"), (None, 1, "n")], "k string, o int, v string")
    assert sorted((str(r.k), r.v) for r in tables.first_per_key(df, ["k"], ["o", "v"]).collect()) == [("None", "n"), ("a", "x")]
    assert sorted((str(r.k), r.v) for r in tables.last_per_key(df, ["k"], ["o", "v"]).collect()) == [("None", "n"), ("a", "z")]


def test_round_robin(spark):
    df = spark.createDataFrame([(g, c, f"{g}{c}{i}") for g in "AB" for c in "xy" for i in range(2)], "g string, c string, id string")
    assert [r.id for r in ranking.round_robin(df, "g", "c", "id", 6).collect()] == ["Ax0", "Bx0", "Ay0", "By0", "Ax1", "Bx1"]


def test_related_in_a_hot_group(spark):
    df = spark.createDataFrame([(i, "one", i % 2, f"n{i:03d}") for i in range(300)], "id int, a string, b int, name string")
    got = ranking.related(df, "id", [("a", 3), ("b", 3)], "name", 6).where("id = 9").orderBy("position").collect()
    assert [r.related for r in got] == [0, 1, 2, 3, 5, 7]


def test_changes_replayed_add_nothing(spark):
    from lodestrata.streaming import twins

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, None)], "k string, o int, s string")
    got = twins.changes(rows, None, "k", ["o"], ["s"])
    assert sorted((r.k, r.o) for r in got.collect()) == [("a", 1), ("a", 3), ("b", 1)]
    last = rows.groupBy("k").agg(F.max_by("s", "o").alias("s"))
    again = spark.createDataFrame([("a", 4, "y"), ("b", 2, None)], "k string, o int, s string")
    assert twins.changes(again, last, "k", ["o"], ["s"]).count() == 0


def test_change_stream(spark, tmp_path):
    from lodestrata.streaming import twins

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"k": "a", "o": o, "s": s}) for o, s in ((1, "x"), (2, "x"), (3, "y"))))
    stream = spark.readStream.schema("k string, o int, s string").json(str(src))
    twins.change_log(stream, str(tmp_path / "log"), str(tmp_path / "cp"), "k", ["o"], ["s"]).awaitTermination(60)
    (src / "2.json").write_text(json.dumps({"k": "a", "o": 4, "s": "y"}))
    twins.change_log(stream, str(tmp_path / "log"), str(tmp_path / "cp"), "k", ["o"], ["s"]).awaitTermination(60)
    assert sorted(r.o for r in spark.read.parquet(str(tmp_path / "log" / "log")).collect()) == [1, 3]


def test_first_seen_stream(spark, tmp_path):
    from lodestrata.streaming import twins

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"url": u, "at": "2026-01-01T00:00:00"}) for u in "aab"))
    stream = spark.readStream.schema("url string, at timestamp").json(str(src))
    q = twins.first_seen(stream, ["url"], "at").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.url for r in spark.table("seen").collect()) == ["a", "b"]


def test_nearest_everywhere(spark):
    p = spark.createDataFrame([(1, 0.0, 1.0), (2, 80.0, 179.0)], "id bigint, lat double, lon double")
    o = spark.createDataFrame([(7, 0.0, -179.0), (8, 0.0, -179.0)], "id bigint, lat double, lon double")
    assert sorted((r[0], r[1]) for r in spatial.nearest(p, o).collect()) == [(1, 7), (2, 7)]
    assert spatial.nearest(p, o.where("false")).count() == 0


def test_wired_share_counts_exclusions(spark):
    rows = [("x", "measured", 60)] * 4 + [("x", "missing", None), ("x", "announced", 10), ("y", "missing", None), ("y", None, None)]
    df = spark.createDataFrame(rows, "c string, s string, v int")
    r = stats.wired_share(df, "c", "s", F.col("v") > 50).first()
    assert (r.n, r.n_positive, r.excluded_missing, r.excluded_not_collected, r.wired, r.share) == (5, 4, 1, 0, "x", 0.8)


def test_text(spark):
    assert one(spark, text.accent_fold(F.lit("  Évry-Côte  d'Or "))) == "evry-cote d'or"
    assert one(spark, text.slugify(F.lit(" Été & Co. "))) == "ete-co"
    assert one(spark, text.locale_number(F.lit("1 234,5 %"))) == 1234.5 and one(spark, text.locale_number(F.lit("0"))) is None and one(spark, text.locale_number(F.lit("n/a"))) is None
    assert one(spark, text.longest_token(F.lit("the abcd efgh"), ["the"])) == "abcd"
    assert one(spark, text.right_of(F.lit("Tour - 12 m - x"), " - ")) == "12 m - x"


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    df = entry.entry(spark)
    assert df.count() > 0
    assert datetime.now().year > 2000


def test_global_rank(spark):
    df = spark.createDataFrame([(i, (i * 7) % 50) for i in range(200)], "id int, v int")
    got = {r.id: r.position for r in ranking.global_rank(df, [F.desc("v"), F.col("id")]).collect()}
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(((i, (i * 7) % 50) for i in range(200)), key=lambda x: (-x[1], x[0])))}
    assert got == want
    assert ranking.global_rank(df.where("false"), [F.col("id")]).count() == 0


def test_percentiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", 5.0)], "g string, v double")
    got = sorted((r.g, str(r.v), r.pct_at_or_below, r.pct_at_or_above) for r in ranking.percentile_labels(df.where("v is not null"), "v", ["g"]).collect())
    assert got == [("a", "1.0", 67, 99), ("a", "1.0", 67, 99), ("a", "2.0", 99, 34), ("b", "5.0", 99, 99)]


def test_medians_equal_brute_force(spark):
    import random
    import statistics

    from lodestrata.operators import stats

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), float(rng.randint(0, 9)) if rng.random() < 0.9 else None, "x") for _ in range(500)] + [("one", 4.0, "x"), ("none", None, "x")]
    df = spark.createDataFrame(rows, "g string, v double, _c string")
    want = {}
    for g, v, _ in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert {r.g: r.median for r in stats.medians(df, "v", ["g"]).collect()} == {g: statistics.median(v) for g, v in want.items()}
    assert stats.medians(df, "v").first().median == statistics.median(v for _, v, _ in rows if v is not None)
    assert stats.medians(df.where("false"), "v", ["g"]).count() == 0


def test_nearest_equals_brute_force(spark):
    import random

    from lodestrata.operators.nearby import great_circle_m

    rng = random.Random(5)
    place = lambda k: (k, rng.choice([rng.uniform(-90, 90), 10.0, 90.0]), rng.choice([rng.uniform(-180, 180), 180.0, -180.0]))
    points, others = [place(k) for k in range(300)], [place(k) for k in range(200)] + [(900, 10.0, 20.0), (800, 10.0, 20.0)]
    got = {r.query_id: r.metres for r in spatial.nearest(spark.createDataFrame(points, "id bigint, lat double, lon double"), spark.createDataFrame(others, "id bigint, lat double, lon double")).collect()}
    assert len(got) == 300
    for k, lat, lon in points:
        assert abs(got[k] - min(float(great_circle_m(lat, lon, a, o)) for _, a, o in others)) < 1e-3


def test_outside_boxes_equals_brute_force(spark):
    import random

    rng = random.Random(6)
    points, others = ([(k, rng.uniform(0, 3), rng.uniform(0, 3)) for k in range(n)] for n in (200, 60))
    got = {r.id for r in spatial.outside_boxes(spark.createDataFrame(points, "id bigint, lat double, lon double"), spark.createDataFrame(others, "id bigint, lat double, lon double"), 0.2).collect()}
    assert got == {k for k, a, o in points if not any(abs(a - x) < 0.2 and abs(o - y) < 0.2 for _, x, y in others)} and got
