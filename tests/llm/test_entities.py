import itertools

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import incremental, linkage, names, spellings


def org(a, b):
    fa, fb = names.folded([a, b])
    return names.same_name(names.organisation(fa), names.organisation(fb))


def test_names():
    assert org("Betefoth Stizuth Infraestr. NV", "STIZUTH-BETEFOTH Infraestructuras N.V.") == 1.0
    assert org("Bob Fugregond", "Dr Robert G. Fugregond") > 0.9 and org("E. Zekidel", "Zekidel, Elisabeth") > 0.7
    assert org("Rasefun Bebrind SpA", "Rasefun Bedruth NV") == 0.0 and org("Guillermo Distakith", "Guillermo Hiwefix") == 0.0
    p = lambda n: names.project(names.folded([n])[0])
    assert p("Brutagund Hub numérique I") == p("Centro de datos Brutagund ph. 1 - Bad Pasas") == ("brutagund", "1", "")
    assert p("Rizezol Building B").unit == p("Rizezol bât. B").unit == "B" and p("X Süd").unit == p("X South").unit
    assert p("Kodrodo & Tokom").promoter == "kodrodo tokom" and p("Bapamol (Bad Pasas)").core == "bapamol"
    assert names.address("https://archive.example/web/20260110/https://m.MAIRIE.EXAMPLE/a/b-1/?utm=x#t") == names.address("http://www.mairie.example/a/b-1")
    assert [names.near("abc", x, 2) for x in ("abc", "acb", "ab", "xyz")] == [0, 1, 1, 3]


def test_spellings_group_and_keep_apart(spark):
    groups = [["Kanakum Lubrem Hosting Ltd", "Lubrem Kanakum", "KANAKUM LUBRME HOST.", "Kanakum L."], ["Kanakum Titath Réseaux SL", "Kanakum Titath"], ["Robert Sterakor", "Bob Sterakor", "Sterakor, Robert"], ["Richard Sterakor"]]
    vals = [(n, "x") for g in groups for n in g] * 2 + [(None, "x"), ("", "x"), ("  ", "x"), ("123", "x"), ("z" * 5000, "x")]
    df = spark.createDataFrame(vals, "name string, node string").select("name").distinct()
    got = spellings.clusters(spellings.nodes_of(df)).collect()
    by = {r.name: r.cluster for r in got}
    pairs = {(a, b) for a, b in itertools.combinations(sorted(by), 2) if by[a] == by[b]}
    assert pairs == {(a, b) for g in groups for a, b in itertools.combinations(sorted(g), 2)}
    assert spellings.nodes_of(df.where("false")).count() == 0


def test_cosines_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    keys = sorted({" ".join("".join(rng.choice(list("abcdst"), 5)) for _ in range(2)) for _ in range(80)})
    df = spark.createDataFrame([(k,) for k in keys], "node string")
    got = {(r.a, r.b): r.cosine for r in spellings.cosine_pairs(df, 0.3, check=False).collect()}
    g = {k: spellings.grams(k) for k in keys}
    n = {x: sum(x in v for v in g.values()) for v in g.values() for x in v}
    vec = {k: {x: np.log1p(len(keys) / n[x]) for x in g[k]} for k in keys}
    norm = {k: np.sqrt(sum(w * w for w in v.values())) for k, v in vec.items()}
    want = {(a, b): sum(vec[a][x] * vec[b][x] for x in vec[a].keys() & vec[b].keys()) / norm[a] / norm[b] for a, b in itertools.combinations(keys, 2)}
    shared = {p for p in want if want[p] >= 0.3 and len(g[p[0]] and set(g[p[0]]) & set(g[p[1]])) >= 8}
    assert shared <= set(got) and all(abs(got[p] - want[p]) < 1e-9 and want[p] >= 0.3 - 1e-9 for p in got) and got


def test_no_pair_above_the_threshold_is_lost(spark):
    rng = np.random.default_rng(5)
    keys = sorted({" ".join("".join(rng.choice(list("abcdst"), 5)) for _ in range(k % 2 + 1)) for k in range(90)} | {"smith", "smyth"})
    df = spark.createDataFrame([(k,) for k in keys], "node string")
    got = {(r.a, r.b) for r in spellings.cosine_pairs(df, 0.3, check=False).collect()}
    g = {k: set(spellings.grams(k)) for k in keys}
    w = {x: np.log1p(len(keys) / sum(x in v for v in g.values())) for v in g.values() for x in v}
    norm = {k: np.sqrt(sum(w[x] ** 2 for x in v)) for k, v in g.items()}
    want = {(a, b): sum(w[x] ** 2 for x in g[a] & g[b]) / norm[a] / norm[b] for a, b in itertools.combinations(keys, 2)}
    assert got == {p for p in want if want[p] >= 0.3} and ("smith", "smyth") in got and not any(abs(v - 0.3) < 1e-9 for v in want.values())
    assert {(r.a, r.b) for r in spellings.cosine_pairs(df, 0.3).collect()} >= {("smith", "smyth")}


def test_only_nodes_of_the_same_name_become_candidates(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = [" ".join(sorted("".join(rng.choice(list("abdeor"), 7)) for _ in range(2))) for _ in range(50)]

    def slipped(w):
        k = int(rng.choice([0, 0, int(rng.integers(len(w) - 1))]))
        return [w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "z" + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + "q" + w[k:]][int(rng.integers(4))]

    keys = sorted({*base, *(" ".join(sorted(slipped(w) for w in k.split())) for k in base), *(f"{k.split()[0]} {k.split()[1][0]}" for k in base[:20]), *(f"{k.split()[0]} {k.split()[1][:3]}." for k in base[20:40])})
    keys += ["bob sterakor", "robert sterakor", "dobert sterakor", "rober terakor", "robert smitakor", "single", "sinlge"]
    seen, real = {}, spellings.cut
    monkeypatch.setattr(spellings, "cut", lambda df, name, *x: seen.setdefault(name, real(df, name, *x)))
    got = {(r.a, r.b): r.words for r in spellings.cosine_pairs(spark.createDataFrame([(k,) for k in keys], "node string"), 0.3).collect()}
    g = {k: set(spellings.grams(k)) for k in keys}
    w = {x: np.log1p(len(keys) / sum(x in v for v in g.values())) for v in g.values() for x in v}
    norm = {k: np.sqrt(sum(w[x] ** 2 for x in v)) for k, v in g.items()}
    same = {(a, b): s for a, b in itertools.combinations(sorted(keys), 2) if (s := names.same_name(a, b))}
    assert got == {(a, b): s for (a, b), s in same.items() if sum(w[x] ** 2 for x in g[a] & g[b]) / norm[a] / norm[b] >= 0.3} and len(got) > 60
    assert seen["candidates"].count() == len(same)  # and not all that have n-grams in common


def test_linkage_equals_one_merge_at_a_time(spark):
    rng = np.random.default_rng(8)
    n = 24
    sim = np.zeros((n, n))
    for _ in range(90):
        a, b = sorted(rng.choice(n, 2, replace=False))
        sim[a, b] = sim[b, a] = round(float(rng.uniform(0.3, 1)), 6)
    groups = {k: {k} for k in range(n)}
    while True:
        best = max(((np.mean([sim[i, j] for i in groups[a] for j in groups[b]]), -a, -b) for a, b in itertools.combinations(sorted(groups), 2)), default=(0, 0, 0))
        if best[0] < 0.35:
            break
        groups[-best[1]] |= groups.pop(-best[2])
    edges = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", float(sim[a, b])) for a, b in itertools.combinations(range(n), 2) if sim[a, b] > 0], "a string, b string, sim double")
    got = {}
    for r in spellings.average_linkage(edges).collect():
        got.setdefault(r.cluster, set()).add(int(r.node))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if any(sim[i].any() for i in g))


def test_linkage_goes_on_until_no_pair_merges(spark):
    # a node's likeness to all before it is the same and falls with its number, so that each round merges one pair
    n = 63
    edges = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", 1 - b / 200) for a, b in itertools.combinations(range(n), 2)], "a string, b string, sim double")
    got = spellings.average_linkage(edges).collect()
    assert len(got) == n and {r.cluster for r in got} == {"00"}


COLS = "key string, name string, operator string, place string, country string, status string, sig string, unit string"


def made():
    rng = np.random.default_rng(2)
    word = lambda k: "".join(rng.choice(list("bdgkmnrstvz")) + rng.choice(list("aeiou")) for _ in range(k))
    return [(word(4), word(3) + " " + word(3), word(4), f"X{k % 3}") for k in range(120)]


def test_records_are_matched(spark):
    base = made()
    right = [(f"s{k}", f"{c.title()} Data Center", o.title() + " AG", p.title(), n, "announced", None, None) for k, (c, o, p, n) in enumerate(base)]
    left, truth = [], set()
    for k, (c, o, p, n) in enumerate(base[:80]):
        typed = c[:2] + c[3:] if k % 7 == 0 else c
        left.append((f"w{k}", f"Campus {typed.upper()}" if k % 5 else o.title() + " AG", None if k % 3 else o.title(), p.title() if k % 5 == 0 or k % 4 else None, n, "announced", None, None))
        truth.add((f"w{k}", f"s{k}"))
    left += [("e1", None, None, None, None, None, None, None), ("e2", "", "", "", "", "", None, None), ("e3", "Campus Neverseen", None, None, "X1", None, None, None), ("w1", *left[1][1:])]
    l, r = (linkage.signatures(spark.createDataFrame(x, COLS), "key", "name", "operator", "place", "country", "status") for x in (left, right + right[:5]))
    a, b = linkage.read(l, False), linkage.read(r, True)
    m = linkage.match(a, b)
    got = {(x.lk, x.rk) for x in m.join(l.select(F.col("sig").alias("a"), F.col("key").alias("lk")), "a").join(r.select(F.col("sig").alias("b"), F.col("key").alias("rk")), "b").collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 2
    assert all(0.5 <= x.posterior <= 1 for x in m.collect())
    none = linkage.read(linkage.signatures(spark.createDataFrame([], COLS), "key", "name", "operator", "place", "country", "status"), True)
    assert linkage.match(a, none).count() == 0


def test_batches(spark):
    cols = "no bigint, batch bigint, name string, operator string, place string, country string, lat double, lon double, urls array<string>, sig string"
    rows = [
        (1, 0, "Brutagund Campus", None, "Mont-Paven", "XA", 10.0, 20.0, ["https://a.example/x-111"], "z"), (2, 0, "Brutagund Campus", None, "Mont-Paven", "XA", 10.0, 20.0, None, "z"),
        (3, 1, "DC Brutagnud", None, "Mont Paven", "XA", 20.0, 10.0, [], "z"), (4, 1, "Brutagund Phase 2", None, "Mont-Paven", "XA", 10.0, 20.0, ["https://a.example/x-111"], "z"),
        (5, 1, "Kodrodo & Tokom", None, "San Luzi", "XA", None, None, ["https://b.example/bewanart-77"], "z"), (6, 2, "Bewanart", "Tokom Kodrodo SA", "San Luzi", "XA", 0.0, 0.0, ["https://b.example/bewanart-77"], "z"),
        (7, 2, "Brutagund ph. 2", None, None, "XA", 10.0, 20.001, None, "z"), (8, 2, None, None, None, None, None, None, None, "z"), (9, 2, "Brutagund Campus", None, "Mont-Paven", "XB", 10.0, 20.0, None, "z"), (10, None, "Brutagund", None, None, "XA", None, None, None, "z"),
    ]
    df = spark.createDataFrame(rows, cols)
    read = lambda d: incremental.read(d, "no", "batch", "name", "operator", "place", "country", "lat", "lon", F.col("urls"))
    got = {(r.first_no, r.dup_no) for r in incremental.duplicates(read(df)).collect()}
    assert got == {(1, 2), (1, 3), (4, 7), (5, 6), (1, 10)}  # what has no batch number comes last
    assert incremental.duplicates(read(df.where("false"))).count() == 0


def test_an_address_of_all_pairs_nothing(spark):
    rows = [(k, k % 2, f"{c.title()} Campus", None, p, "XA", None, None, ["https://a.example/all-1234"]) for k, (c, _, p, _) in enumerate(made())]
    df = spark.createDataFrame(rows, "no bigint, batch bigint, name string, operator string, place string, country string, lat double, lon double, urls array<string>")
    read = incremental.read(df, "no", "batch", "name", "operator", "place", "country", "lat", "lon", F.col("urls"))
    assert incremental.duplicates(read).count() == 0


def batches(spark, rows):
    df = spark.createDataFrame(rows, "no bigint, batch bigint, name string, operator string, place string, country string, lat double, lon double, urls array<string>")
    read = incremental.read(df, "no", "batch", "name", "operator", "place", "country", "lat", "lon", F.col("urls"))
    return {(r.first_no, r.dup_no) for r in incremental.duplicates(read).collect()}


def test_swaps_and_two_edits_are_found(spark):
    long = "bakedimogunafelovitaruseko"
    rows = [
        (1, 0, "Briulbo Campus", None, None, "XA", 10.0, 20.0, None), (2, 1, "Brilubo Campus", None, None, "XA", 10.0, 20.0, None),
        (3, 0, "Miodulem Campus", None, "Paven", "XA", 30.0, 40.0, None), (4, 1, "Midulm Campus", None, "Pavem", "XA", 30.0, 40.0, None),
        (5, 0, long.title() + " Campus", None, "Luzi", "XA", 50.0, 60.0, None), (6, 1, ("ab" + long[2:12] + "ef" + long[14:]).title() + " Campus", None, "Luzi", "XA", 50.0, 60.0, None),
    ]
    assert names.near(long, "ab" + long[2:12] + "ef" + long[14:], 2) == 2
    assert batches(spark, rows) == {(1, 2), (3, 4), (5, 6)}


def test_an_address_of_many_still_leads_to_its_entries(spark):
    page = ["https://a.example/all-1234"]
    rows = [(k + 10, 0, f"{c.title()} Campus", None, p, "XA", None, None, page) for k, (c, _, p, _) in enumerate(made())]
    rows += [(1, 0, "Kodrodo & Tokom", None, None, "XA", 10.019, 20.0, page), (2, 1, "Bewanart Campus", None, None, "XA", 10.021, 20.0, page)]
    assert batches(spark, rows) == {(1, 2)}


def entry(no, name, batch=0, country="XA", lat=10.0, lon=20.0):
    return (no, batch, name, None, "Mont-Paven", country, lat, lon, None)


def read_entries(spark, rows):
    df = spark.createDataFrame(rows, "no bigint, batch bigint, name string, operator string, place string, country string, lat double, lon double, urls array<string>")
    return incremental.read(df, "no", "batch", "name", "operator", "place", "country", "lat", "lon", F.col("urls"))


def test_an_index_is_opened_again_and_read_in_part(spark, tmp_path):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("bdgkmnrstvz")) + rng.choice(list("aeiou")) for _ in range(5))
    path, sizes = f"file://{tmp_path}/index", []
    for k in range(3):
        rows = [entry(10_000 * k + n, f"{word().title()} Campus", country=f"X{n % 9}") for n in range(400)]
        incremental.Index(spark, path, buckets=512).add(read_entries(spark, rows + ([entry(9, "Brutagund Campus")] if not k else [])))
        late = incremental.Index(spark, path)  # as another session would
        assert late.buckets == 512 and len(late.loads) == 2 * k + 1
        seen = []
        stored = late.stored
        late.stored = lambda what, only=None, also=None: seen.append((what, only, stored(what, only, also))) or seen[-1][2]
        variant = read_entries(spark, [entry(90_000 + k, ("Brutagnud", "Brutagudn", "Brutganud")[k] + " Campus")])
        late.add(variant)
        sizes.append({what: len(only) for what, only, _ in seen if only is not None})
        assert {(r.sig, r.first_no) for r in late.first_numbers().collect()} >= {(r.sig, 9) for r in variant.collect()}
    # as many buckets whatever was accepted before, and a small part of all
    assert sizes[0] == sizes[1] == sizes[2] and all(n <= 60 for n in sizes[0].values()) and {"postings", "signatures"} <= set(sizes[0])
    # what a broken run left behind is not read
    n = late.stored("signatures").count()
    late._append("signatures", late.stored("signatures"), "broken")
    assert incremental.Index(spark, path).stored("signatures").count() == n


def test_late_entries_with_smaller_numbers_come_first(spark):
    rows = [entry(50, "Brutagund Campus", 0), entry(60, "Brutagnud Campus", 1), entry(7, "Brutagund Campus", 2), entry(3, "Brutagudn Campus", 3)]
    assert batches(spark, rows) == {(3, 7), (3, 50), (3, 60)}


def test_long_chains_are_followed_to_their_end(spark):
    names_ = ["bakedimo"]
    for k in range(7):
        names_.append(names_[-1][:k] + "xyzwvuqx"[k] + names_[-1][k + 1 :])
    rows = [entry(k, f"{n.title()} Campus") for k, n in enumerate(reversed(names_))]
    assert batches(spark, rows) == {(0, k) for k in range(1, len(rows))}


def test_what_says_nothing_matches_nothing(spark):
    blank = [(k, 0, None, None, None, c, None, None, None) for k, c in enumerate((None, None, "XA", "XA"))]
    assert batches(spark, blank) == set()


def test_candidates_cover_all_that_verification_allows(spark):
    rng = np.random.default_rng(9)
    base = sorted({"".join(rng.choice(list("abcdefgimnorstu"), int(rng.integers(6, 26)))) for _ in range(60)})

    def spoiled(w):
        for _ in range(2):
            k = int(rng.integers(0, len(w) - 1))
            w = [w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "z" + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + "q" + w[k:]][int(rng.integers(4))]
        return w

    rows = [entry(k, f"{w} Campus") for k, w in enumerate(base)] + [entry(1000 + k, f"{spoiled(w)} Campus", 1) for k, w in enumerate(base)]
    read = {r.no: r.core for r in read_entries(spark, rows).collect()}
    want = {(k, 1000 + k) for k in range(len(base)) if names.near(read[k], read[1000 + k], 2) <= 2 and min(len(read[k]), len(read[1000 + k])) >= 6}
    assert len(want) > 50 and want <= batches(spark, rows)


def test_more_batches_read_no_more(spark, monkeypatch):
    read, stored = [], incremental.Index.stored
    monkeypatch.setattr(incremental.Index, "stored", lambda self, what, *a, **k: read.append(what) or stored(self, what, *a, **k))
    words = [c for c, _, _, _ in made()[:24]]
    rows = [entry(k, f"{w.title()} Campus", 0) for k, w in enumerate(words)] + [entry(100 + k, f"{w[1::-1].title()}{w[2:]} Campus", 0) for k, w in enumerate(words)]
    sizes = []
    for n in (1000, 6):
        assert batches(spark, [(no, no // n, *rest) for no, _, *rest in rows]) >= {(k, 100 + k) for k in range(24)}
        sizes.append(len(read))
        read.clear()
    assert sizes[0] == sizes[1]


def test_batches_at_once_or_one_by_one(spark):
    words = [c for c, _, _, _ in made()[:12]]
    rows = [entry((7 * k) % 36, f"{(w if k % 3 else w[1::-1] + w[2:]).title()} Campus", k % 4 or None) for k, w in enumerate(words * 3)]
    rows += [(100, 1, "Kodrodo & Tokom", None, "Luzi", "XA", None, None, ["https://b.example/bewanart-77"]), (98, 2, "Bewanart", "Tokom Kodrodo SA", "Luzi", "XA", None, None, ["https://b.example/bewanart-77"])]
    whole, index = read_entries(spark, rows), incremental.Index(spark)
    for k in (1, 2, 3, None):
        index.add(whole.where(F.col("batch").eqNullSafe(F.lit(k))))
    parts = {(r.first_no, r.no) for r in whole.join(index.first_numbers(), "sig").where("first_no < no").collect()}
    assert parts == batches(spark, rows) and {d for _, d in parts} & {100, 98}


def test_names_meet_whenever_verification_accepts_them():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("bdgkmnrstaeio"), n))

    def slip(w, times):
        for _ in range(times):
            k = int(rng.integers(0, max(1, len(w) - 1)))
            w = (w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :])[rng.integers(0, 4)] or w
        return w

    rows = []
    for base in (word(rng.integers(2, 19)) for _ in range(150)):
        town, at = word(9), int(rng.integers(-500, 500))
        for _ in range(5):
            place = ("", slip(town, 1), slip(town, 2), town, town[3:])[rng.integers(0, 5)]
            cell = None if rng.random() < 0.3 else at + int(rng.integers(-1, 2))
            rows.append(("XA", slip(base, rng.integers(0, 3)), "", place, ("", "tokom kodrodo", "tokon kodrodo")[rng.integers(0, 3)], "", cell, cell, [["a/1"], None, []][rng.integers(0, 3)]))
    batch = [None if k % 5 == 0 else k % 4 for k in range(len(rows))]
    order = [9 if b is None else b for b in batch]
    table = pa.table([list(c) for c in zip(*rows)] + [list(range(len(rows))), batch, [None] * len(rows)], names=[*incremental.NAMES, "sig", "batch", "seen"])
    want = {(n, o) for n, a in enumerate(rows) for o, b in enumerate(rows) if n != o and order[o] <= order[n] and incremental.same_project(a, b)}
    assert len(want) > 400
    for pieces in (1, 3):
        got = [r for p in range(pieces) for r in incremental._named_links((None, None, pa.scalar(p), pa.scalar(pieces)), table).to_pylist()]
        assert {(r["new"], r["old"]) for r in got} == want
        assert all(r["earlier"] == (order[r["old"]] < order[r["new"]]) for r in got)
