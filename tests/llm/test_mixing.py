import pytest
from pyspark.sql import functions as F

from lodestrata.llm import mixing as m


def test_tokens_whatever_the_cut(monkeypatch):
    text = "Le service d'urbanisme a publié les chiffres ; 12,5 MW.\n\n" * 40
    whole = m.count_tokens(text)
    monkeypatch.setattr(m, "PIECE_CHARS", 100)
    assert m.count_tokens(text) == whole > 0 and m.count_tokens("") == 0
    assert m.count_tokens("a" * 1000) > 0


def test_shortage_goes_to_siblings_first():
    sizes = [("a", "en", 100), ("a", "fr", 1000), ("b", "en", 1000), ("c", None, 10)]
    root = m.plan(sizes, {"a": (0.5, 1), "b": (0.4, 1), "c": (0.1, 2)}, total=1000.0)
    a = root.kids["a"]
    assert root.kids["c"].budget == 20 and a.budget == pytest.approx(980 * 5 / 9) and sum(k.budget for k in a.kids.values()) == pytest.approx(a.budget)
    exact = m.plan(sizes, {"a": (0.5, 1), "b": (0.4, 1), "c": (0.1, 2)})
    assert exact.budget == pytest.approx(200) and exact.kids["a"].budget == pytest.approx(100)
    full = m.plan(sizes, {"a": (0.5, 1), "b": (0.4, 1), "c": (0.1, 2)}, total=1e9)
    assert full.budget == pytest.approx(2120)
    assert m.plan([], {}).budget == 0 and m.plan(sizes, {"a": (0.0, 1)}).budget == 0


def test_shortage_stays_in_the_domain():
    sizes = [("a", "en", 100), ("b", "en", 10_000), ("c", "en", 10_000)]
    targets = {"a": (0.4, 1), "b": (0.2, 1), "c": (0.4, 1)}
    root = m.plan(sizes, targets, total=1000.0, domains={"a": "x", "b": "x"})
    got = {p: leaf.budget for p, leaf in m.each_leaf(root)}
    assert got == {("x", "a", "en"): 100, ("x", "b", "en"): pytest.approx(500), ("c", "c", "en"): pytest.approx(400)}
    flat = {p: leaf.budget for p, leaf in m.each_leaf(m.plan(sizes, targets, total=1000.0))}
    assert flat == {("a", "en"): 100, ("b", "en"): pytest.approx(300), ("c", "en"): pytest.approx(600)}
    full = m.plan(sizes, targets, total=20_050.0, domains={"a": "x", "b": "x"})
    assert sum(leaf.budget for _, leaf in m.each_leaf(full)) == pytest.approx(20_050) and full.kids["x"].budget == pytest.approx(10_100)


def test_selection(spark):
    rows = [(k, "a", "en" if k % 2 else None, 10) for k in range(200)] + [(1000 + k, "b", "en", 7) for k in range(5)] + [(2000, "x", "en", 5), (2001, "a", "en", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, tokens bigint")
    sizes = [(r.source, r.lang, r.n) for r in df.groupBy("source", "lang").agg(F.sum("tokens").alias("n")).collect()]
    root = m.plan(sizes, {"a": (0.9, 2), "b": (0.1, 3)}, total=900.0)
    got = m.select(df, root, buckets=8).collect()
    used = {s: sum(r.tokens * r.repeats for r in got if r.source == s) for s in "ab"}
    assert abs(used["a"] - root.kids["a"].budget) <= 10 and abs(used["b"] - root.kids["b"].budget) <= 7
    assert all(1 <= r.repeats <= (2 if r.source == "a" else 3) for r in got) and len({r.doc_id for r in got}) == len(got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, m.select(df.repartition(7), root, buckets=8).collect()))


def test_shares_with_a_shortage_are_those_of_the_budget(spark):
    """Planted: one source falls short; what it lacks goes to the others by their weights."""
    rows = [(k, "small", "en", 10) for k in range(10)] + [(100 + k, "large", ("en", "fr")[k % 2], 10) for k in range(400)] + [(1000 + k, "other", "de", 10) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, tokens bigint")
    sizes = [(r.source, r.lang, r.n) for r in df.groupBy("source", "lang").agg(F.sum("tokens").alias("n")).collect()]
    got = m.select(df, m.plan(sizes, {"small": (0.5, 2), "large": (0.3, 1), "other": (0.2, 1)}, total=2200.0))
    used = {r.source: r.n for r in got.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n")).collect()}
    assert used["small"] == 200 and abs(used["large"] - 1200) <= 20 and abs(used["other"] - 800) <= 10
    langs = {r.lang: r.n for r in got.where("source = 'large'").groupBy("lang").agg(F.sum("tokens").alias("n")).collect()}
    assert abs(langs["en"] - 600) <= 10 and abs(langs["fr"] - 600) <= 10


def test_sizes(spark):
    df = spark.createDataFrame([(1, "a", "hello world", 1), (2, None, None, 1), (None, "a", "x", 1)], "k bigint, source string, text string, tokens int")
    assert sorted((r.doc_id, r.tokens) for r in m.sized(df, "k", "text", ["source"]).collect()) == [(1, 2), (2, 0)]
    assert m.sized(df.where("false"), "k", "text", ["source"]).count() == 0
