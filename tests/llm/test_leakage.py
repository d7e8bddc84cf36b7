import random

import numpy as np

from lodestrata.llm import leakage as L

ITEM = "the survey team measured noise at night near eight dwellings facing the cooling towers and the register lists many megawatts waiting at the substation since the old ruling of that year"
WORDS = ITEM.split()


def found(spark, docs, items=((1, ITEM),)):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, run int, item_id int")
    i = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in L.leaks(d, "doc_id", "text", i, "item_id", "text").collect()}


def test_runs_edits_and_looks(spark):
    pad = "alpha beta gamma "
    edited = WORDS[:]
    for k in (3, 14):
        edited[k] = "other"
    del edited[25]
    docs = [
        (1, pad + " ".join(WORDS[5:17]) + " omega"), (2, pad + " ".join(WORDS[5:16]) + " omega"), (3, pad + " ".join(edited) + " omega"), (4, ITEM.upper().replace(" ", "  ").replace("SURVEY", "<b>SUR­VEY</b>")),
        (5, None), (6, ""), (7, pad * 20000 + ITEM), (8, "Thе sūrvey—teаm measured, noise; at: night/near eight dwellings (facing) the cooling towers"), (1, pad + " ".join(WORDS[5:17]) + " omega"),
    ]
    assert found(spark, [(*d, 1, 1) for d in docs]) == {(1, 1), (3, 1), (4, 1), (7, 1), (8, 1)}


def test_against_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(6, 40)))) for k in range(12)]
    docs = []
    for k in range(150):
        w = [rng.choice(vocab) for _ in range(20)]
        own = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 6)):
            if own:
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["zz"], [own[at], "zz"]])
        a = rng.randrange(len(own) + 1) if rng.random() < 0.4 and own else 0
        docs.append((k, " ".join(w + own[a:] + w), 1, 1))
    want = set()
    for i, t in items:
        item = t.split()
        code = {x: n + 1 for n, x in enumerate(dict.fromkeys(item))}
        iw = np.array([code[x] for x in item])
        for d, text, *_ in docs:
            words = text.split()
            dw = np.array([code.get(x, 0) for x in words])
            runs = {tuple(item[k : k + 12]) for k in range(len(item) - 11)}
            if any(tuple(words[k : k + 12]) in runs for k in range(len(words) - 11)) or L.least_edits(iw, dw) <= len(item) // 8:
                want.add((d, i))
    assert found(spark, docs, items) == want and len(want) > 20


def test_sieves_in_several_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BITS", 64)
    monkeypatch.setattr(L, "BITS_EACH", 64)
    assert found(spark, [(1, ITEM, 1, 1)], [(1, ITEM), (2, ITEM), (3, ""), (4, None)]) == {(1, 1), (1, 2)}
    assert found(spark, []) == set()
    d = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    assert L.leaks(d, "doc_id", "text", d.where("false"), "doc_id", "text").count() == 0


def test_a_full_sieve_keeps_all(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BITS", 8)
    monkeypatch.setattr(L, "SIEVE_BITS", 8)
    assert found(spark, [(1, ITEM, 1, 1), (2, "nothing of it", 1, 1)]) == {(1, 1)}


def test_long_and_short_items_side_by_side(spark):
    long = " ".join(f"w{k % 977}x{k % 1009}" for k in range(100_000))
    words = long.split()
    docs = [(1, " ".join(words[70_000:70_020])), (2, " ".join(words[10:21])), (3, "before solar after"), (4, "x " * 30_000 + " ".join(words[5:17]) + " y" * 30_000 + " " + " ".join(words[99_900:99_930]))]
    assert found(spark, [(*d, 1, 1) for d in docs], [(1, long), (2, "solar"), (3, " ".join(words[:9]))]) == {(1, 1), (3, 2), (4, 1)}


def test_a_run_belongs_to_the_document_it_stands_in(spark):
    long = " ".join(f"w{k}" for k in range(40))
    docs = [(1, "alpha beta survey"), (2, " ".join(WORDS[14:28]) + " omega"), (3, "alpha"), (4, " ".join(long.split()[:13])), (5, " ".join(long.split()[25:]))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    i = spark.createDataFrame([(1, ITEM), (2, long)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.run) for r in L.leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == {(2, 1, 14), (4, 2, 13), (5, 2, 15)}
