import json

from lodestrata.operators import nested as n

WANTED = {"indicator_proxies": ("indicator", ["public_inquiry_held"]), "indicator_source": ("indicator", ["archived_url"]), "fact": ("fact", ["kind"]), "fact_source": ("fact", ["url"])}


def run(spark, payloads):
    rows = [(k, p if p is None or isinstance(p, str) else json.dumps(p), "t", "x") for k, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "no bigint, body string, tag string, payload string")
    return sorted(tuple(r) for r in n.leaves(n.tagged(df, "no", "body"), WANTED).collect())


def test_shapes(spark):
    i = {"id": "T1", "status": "measured", "proxies": {"publicInquiryHeld": "oui"}, "source": [{"url": "u", "archivedUrl": "a1"}, {"archived_url": "a2"}, None], "verification_source": {"archived_url": "no"}}
    got = run(spark, [
        {"indicators": [None, i]}, {"meta": {}, "record": {"Indicators": json.dumps([i])}}, [{"indicators": {"3": i, "5": None}}],
        {"facts": {"kind": "press", "source": "https://x.example/1"}}, {"facts": [{"kind": None, "source": json.dumps({"url": "u2"})}, {"Kind": "petition", "source": None}], "source": {"url": "own"}, "contestation": [{"kind": "no"}]},
        json.dumps(json.dumps({"facts": [{"kind": "a"}]})),
    ])
    ind = lambda rec, pos: [(rec, "indicator", pos, "archived_url", "a1"), (rec, "indicator", pos, "archived_url", "a2"), (rec, "indicator", pos, "public_inquiry_held", "true")]
    assert got == sorted([*ind(0, 1), *ind(1, 0), *ind(2, 3), (3, "fact", 0, "kind", "press"), (3, "fact", 0, "url", "https://x.example/1"), (4, "fact", 0, "url", "u2"), (4, "fact", 1, "kind", "petition"), (5, "fact", 0, "kind", "a")])


def test_nothing_to_read(spark):
    deep = "[" * 20000 + "]" * 20000
    assert run(spark, [None, "", "{", '{"facts": [', "7", '"text"', [], {}, {"facts": None}, {"facts": []}, {"facts": [1, "x", None]}, {"indicators": [{"proxies": None, "source": None}]}, deep]) == []
    assert run(spark, []) == []


def test_very_long(spark):
    assert len(run(spark, [{"facts": [{"kind": "k" * 1000}] * 2000}])) == 2000


def test_links_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, json.dumps({"id": "r", "facts": [{"kind": "a", "source": {"url": "u"}}]}))], "no bigint, body string")
    rows = n.tagged(df, "no", "body")
    n.write_tables(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    fact, src = n.typed(back, "fact").first(), n.typed(back, "fact_source").first()
    assert src.parent_key == fact.row_key and fact.parent_key == n.typed(back, "record").first().row_key and src.url == "u"


def test_keys_are_unique_and_nothing_is_left_out(spark):
    twice = {"proxies": [{"public_inquiry_held": True}, {"public_inquiry_held": False}], "proxy": {"cndp_referral": True}, "source": {"url": "a"}, "Sources": ["b", {"url": "c", "parts": [{"no": 1}, {"no": 2}]}]}
    value = {"id": "r", "indicators": [twice, None, twice], "indicator": {"1": twice, "01": twice}, "contestation": [{"kind": "x", "label": {"fr": "y"}}], "source": {"url": "own"}, "scores": [1, 2]}
    rows = list(n.visit(7, [value, value]))
    keys = [r[2] for r in rows]
    assert len(set(keys)) == len(keys) and {r[3] for r in rows if r[3]} <= set(keys)
    tags = {t: sum(r[0] == t for r in rows) for t in {r[0] for r in rows}}
    assert tags == {"record": 2, "indicator": 8, "indicator_proxies": 24, "indicator_source": 24, "indicator_source_parts": 16, "contestation": 2, "contestation_label": 2, "record_source": 2}
    assert rows[0][5] == {"id": "r", "scores": "[1, 2]"}
    df = spark.createDataFrame([(7, json.dumps(value))], "no bigint, body string")
    assert [r.no for r in n.typed(n.tagged(df, "no", "body"), "indicator_source_parts", "no int").orderBy("row_key").collect()] == [1, 2] * 4


def test_truth():
    assert [n.truth(v) for v in (True, False, 1, 0, "Ja", " NON ", "?", None, float("nan"))] == [True, False, True, False, True, False, None, None, None]
