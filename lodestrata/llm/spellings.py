"""Variant spellings of names typed by people.

Each spelling is reduced to its own words (``names.organisation``); spellings with
the same words are one node. A node is a vector of character n-grams weighted by
rarity over all nodes. Only nodes whose words go together are paired: they meet by
keys of their words (``meeting``), are checked word by word, and those whose cosine
is above a threshold are grouped by average linkage. The nearest nodes of a node,
whatever their words, are found by a sparse cosine join: n-grams are ordered from
rare to frequent, and only the prefix of each vector is joined whose rest is too
short to reach the threshold alone, which loses no pair.
The linkage merges all pairs that are each other's nearest at once, round by
round; for average linkage that gives the same groups as one merge at a time,
and no group has to fit into one task.

Edge cases: null, empty and blank names and names without letters have no node
and no partner; repeated names count once; names of any length are read whole;
ties between equally near groups go to the smaller key.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm import names
from lodestrata.runtime import cut, free

GRAM = 3
COSINE = 0.3
#: Steps of 1 in which bounds are counted, rounded up; whole numbers are smaller to send.
STEPS = 65_536
#: Nodes of an n-gram that are joined in one piece.
PIECE = 1_000
LINKAGE = 0.35
#: Nodes whose keys are made at once.
SLICE = 200


def grams(key: str, n: int = GRAM) -> list[str]:
    """Character n-grams of a node's words, each with a blank before and after."""
    out: set[str] = set()
    words = key.split()
    long = [w for w in words if len(w.rstrip(".")) > 1] or words
    for w in long:
        t = f"_{w}_"
        out.update(t[k : k + n] for k in range(max(1, len(t) - n + 1)))
    return sorted(out)


def _read(only_promoters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vals = b.column(0).to_pylist()
            keys = []
            for f in names.folded(vals):
                own = names.project(f).promoter if only_promoters else names.organisation(f)
                keys.append(own if any(c.isalpha() for c in own) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string())], names=["name", "node"])

    return run


def nodes_of(values: DataFrame, only_promoters: bool = False) -> DataFrame:
    """(name, node) of a column of distinct names; with ``only_promoters`` of those
    that are no project's name."""
    return values.select(F.col(values.columns[0]).cast("string").alias("name")).where("name is not null").mapInArrow(_read(only_promoters), "name string, node string").where("node is not null")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = [names.same_name(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        keep = pa.array([s > 0 for s in score])
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array([s for s in score if s > 0], pa.float64())], names=["a", "b", "words"])


def _weighed(nodes: DataFrame) -> DataFrame:
    """(node, id, rank, w): the n-grams of each node with their weights."""
    gram_udf = F.arrow_udf(lambda k: pa.array([grams(x) for x in k.to_pylist()], pa.list_(pa.string())), "array<string>")
    post = cut(nodes.select("node", F.explode(gram_udf("node")).alias("g")), "postings")
    n = nodes.count()
    df = post.groupBy("g").agg(F.count("*").alias("df"))
    return post.join(df, "g").select("node", F.xxhash64("node").alias("id"), F.struct("df", F.xxhash64("g").alias("g")).alias("rank"), F.log1p(F.lit(float(n)) / F.col("df")).alias("w"))


def _listed(word: str) -> bool:
    return word in names.NICKNAMES or word in names.FULL_NAME


def _left(word: str) -> set[str]:
    """What is left of a word, and of the full name it is short for, without as many
    letters as ``names`` lets differ."""
    full = names.FULL_NAME.get(word, word)
    out = names.shortened(word, 2 if len(word) >= 6 else 1 if len(word) >= 3 else 0)
    return out if full == word else out | names.shortened(full)


@functools.lru_cache(2)
def _near_listed(n: int) -> dict[str, set[str]]:
    """Listed first names by what is left of them."""
    out: dict[str, set[str]] = {}
    for w in {*names.NICKNAMES, *names.FULL_NAME}:
        for k in _left(w):
            out.setdefault(k, set()).add(w)
    return out


@functools.lru_cache(2_000)
def _word(word: str) -> tuple[tuple[str, ...], ...]:
    """Of one word: keys of equal words, keys of words with slips, prefixes that a short
    form may be, keys if its first letter slipped, its possible initials, its last letters."""
    x = word.rstrip(".") or word
    left, known = _left(x), _near_listed(len(names.FULL_NAME))
    listed = set().union(*(known.get(k, ()) for k in left))
    full = names.FULL_NAME.get(x, x)
    first = {w[0] for w in (x, full, *listed, *(names.FULL_NAME.get(n, n) for n in listed))}
    if _listed(x):
        sure, left, slipped = {f"N{x}"}, set(), set()
    else:
        sure = {f"N{n}" for n in listed} | {f"e{x}"}
        left = left if len(x) >= 3 else set()
        slipped = set().union(*(names.shortened(x[k:], 1 if len(x) >= 6 else 0) for k in range(3))) if len(x) >= 4 else set()
    starts = {f"p{w[:k]}" for w in (x, full) for k in (2, 3, 4) if len(w) >= k}
    return tuple(sure), tuple(left), tuple(starts), tuple(slipped), tuple(first), tuple(x[-2:])


def meeting(node: str) -> tuple[set[tuple[str, str]], set[tuple[str, str]]]:
    """(key, mark) of a node; those of the second set ask no other that doesn't ask.
    Two nodes meet where they have a key in common and no mark or different ones.

    ``names.same_name`` needs two pairs of words that go together (one, where both
    names are one word), of which one is sure: no listed first names, and alike but
    for two letters, or short forms. So two nodes of the same name share a key of the
    sure pair with an initial of the other one; or, where both pairs differ in their
    first letters, what is left of one word behind that, with one of the last two
    letters of the other, since no more than one other slip is allowed. Equal words
    have a key of their own, so that their nodes don't meet at all other keys, too.
    """
    asks, silent = set(), set()
    words = node.split()
    read = [_word(w) for w in words]
    for k, (w, (sure, left, starts, slipped, _, _)) in enumerate(zip(words, read)):
        others = [r for n, r in enumerate(read) if n != k]
        first = set().union(*(r[4] for r in others)) if others else {"-"}
        x = w.rstrip(".")
        (silent if _listed(x) else asks).update((f"{s}|{t}", "") for s in sure for t in first)
        asks.update((f"w{s}|{t}", x) for s in left for t in first)
        silent.update((f"{s}|{t}", "") for s in starts for t in first)
        if w.endswith(".") and len(x) > 1:
            asks.update((f"p{x[:4]}|{t}", "") for t in first)
        if slipped:
            last = {c for r in others if r[3] for c in r[5]}
            asks.update((f"z{s}|{t}", x[0]) for s in slipped for t in last)
    return asks, silent - asks


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, SLICE):
            ids, keys, asks = [], [], []
            for i, n in zip(*(c.to_pylist() for c in b.slice(k, SLICE).columns)):
                for own, ask in zip(meeting(n), (True, False)):
                    ids += [i] * len(own)
                    keys += own
                    asks += [ask] * len(own)
            cols = [pa.array(ids, pa.int64()), pa.array([x for x, _ in keys], pa.string()), pa.array([c or None for _, c in keys], pa.string()), pa.array(asks, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "k", "mark", "asks"])


def same_pairs(nodes: DataFrame) -> DataFrame:
    """(x, y, a, b, words): all pairs of nodes that ``names.same_name`` takes for the
    same, by number and name; found by keys of their words, so that nodes that have
    only n-grams in common never meet."""
    kept = nodes.select(F.xxhash64("node").alias("id"), "node")
    keys = kept.mapInArrow(_meeting, "id bigint, k string, mark string, asks boolean")
    keys = keys.select("id", F.xxhash64("k").alias("k"), F.when(F.col("mark").isNotNull(), F.xxhash64("mark")).alias("mark"), "asks")
    group = keys.groupBy("k").agg(F.expr("collect_list(struct(id, mark)) filter (where asks)").alias("asks"), F.expr("collect_list(id) filter (where not asks)").alias("silent"), F.expr("min(mark) <> max(mark)").alias("differ"))
    group = group.where("size(asks) > 0 and size(asks) + size(silent) > 1 and coalesce(differ, true)").select(F.explode("asks").alias("x"), "asks", "silent")
    later = "transform(filter(asks, v -> v.id > x.id and coalesce(v.mark <> x.mark, true)), v -> v.id)"
    met = group.select("x.id", F.expr(f"explode(concat({later}, silent))").alias("y")).withColumnRenamed("id", "x").where("x <> y")
    met = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    shown = met.join(kept.select(F.col("id").alias("x"), F.col("node").alias("u")), "x").join(kept.select(F.col("id").alias("y"), F.col("node").alias("v")), "y")
    return cut(shown.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).mapInArrow(_checked, "a string, b string, words double"), "candidates")


def same_cosine_pairs(nodes: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(a, b, cosine, words), a < b: pairs of nodes of the same name that are at least
    ``threshold`` alike. The same pairs as those of ``cosine_pairs`` that are checked
    afterwards, but only these are ever formed."""
    pairs = same_pairs(nodes)
    weighed = _weighed(nodes)
    lengths = weighed.groupBy("node").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l"))
    of = lambda k: weighed.select(F.col("node").alias(k), F.col("rank.g").alias("g"), F.col("w").alias(f"w{k}"))
    dots = pairs.join(of("a"), "a").join(of("b"), ["b", "g"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("_dot"), F.first("words").alias("words"))
    for k in "ab":
        dots = dots.join(lengths.select(F.col("node").alias(k), F.col("_l").alias(f"_l{k}")), k)
    return cut(dots.select("a", "b", (F.col("_dot") / (F.col("_la") * F.col("_lb"))).alias("cosine"), "words").where(F.col("cosine") >= threshold), "pairs")


def cosine_pairs(nodes: DataFrame, threshold: float = COSINE, check: bool = True) -> DataFrame:
    """(a, b, cosine, words), a < b: pairs of nodes at least ``threshold`` alike; with
    ``check`` only those of the same name, else without words."""
    if check:
        return same_cosine_pairs(nodes, threshold)
    own, weighed = W.partitionBy("node"), _weighed(nodes)
    rest = own.orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0)
    vec = weighed.withColumn("_rest", F.sum(F.col("w") * F.col("w")).over(rest)).withColumn("_all", F.sum(F.col("w") * F.col("w")).over(own))
    vec = vec.withColumn("rest", F.sqrt(F.greatest(F.lit(0.0), (F.col("_rest") - F.col("w") * F.col("w")) / F.col("_all"))))
    # numbers instead of names where all pairs with a common n-gram meet
    vec = cut(vec.select("id", "rank", F.col("rank.g").alias("g"), (F.col("w") / F.sqrt("_all")).alias("w"), (F.sqrt(F.col("_rest") / F.col("_all")) >= threshold).alias("prefix"), "rest"), "vectors")
    pre = vec.where("prefix").withColumn("end", F.min("rest").over(W.partitionBy("id")))
    x, y = (pre.select(F.col("id").alias(k), "g", F.col("w").alias(f"w{k}"), F.col("rest").alias(f"r{k}"), F.col("end").alias(f"e{k}")) for k in "xy")
    own_dot = F.col("wx") * F.col("wy")
    # after the last common n-gram of both prefixes, one vector has only what follows its prefix,
    # so no cosine is above the sum over the common ones plus the product of these rests
    up = lambda c: F.ceil(c * STEPS).cast("int")
    # the postings of frequent n-grams are cut by one side's nodes, and the other side's go to every piece
    # (there are no more of these than rows by PIECE)
    large = F.broadcast(pre.groupBy("g").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_k")).where("_k > 1"))
    x = x.join(large, "g", "left").withColumn("_p", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))).drop("_k")
    y = y.join(large, "g", "left").withColumn("_p", F.pmod("y", F.coalesce("_k", F.lit(1))).cast("int")).drop("_k")
    met = x.join(y, ["g", "_p"]).where("x < y").groupBy("x", "y").agg(F.sum(own_dot).alias("dot"), F.min(up(F.greatest(F.col("ex") * F.col("ry"), F.col("ey") * F.col("rx")))).alias("more"))
    cand = cut(met.where(up(F.col("dot")) + F.col("more") >= int(threshold * STEPS)).select("x", "y", "dot"), "candidates")
    # what the sum lacks are n-grams after the end of both prefixes, or of the one that ends first:
    # they are all in what follows the prefix of that one
    ends = vec.where("prefix").groupBy("id").agg(F.max("rank").alias("end"))
    for k in "xy":
        cand = cand.join(ends.select(F.col("id").alias(k), F.col("end").alias(f"end_{k}")), k)
    short, other = F.when(F.col("end_x") <= F.col("end_y"), F.col("x")).otherwise(F.col("y")), F.when(F.col("end_x") <= F.col("end_y"), F.col("y")).otherwise(F.col("x"))
    sides = cand.select("x", "y", "dot", short.alias("s"), other.alias("o"))
    after = vec.where("not prefix").select(F.col("id").alias("s"), "g", F.col("w").alias("ws"))
    more = sides.select("s", "o").join(after, "s").join(vec.select(F.col("id").alias("o"), "g", F.col("w").alias("wo")), ["o", "g"]).groupBy("s", "o").agg(F.sum(F.col("ws") * F.col("wo")).alias("_more"))
    pairs = sides.join(more, ["s", "o"], "left").select("x", "y", (F.col("dot") + F.coalesce("_more", F.lit(0.0))).alias("cosine")).where(F.col("cosine") >= threshold)
    ids = nodes.select(F.xxhash64("node").alias("id"), "node")
    pairs = pairs.join(ids.select(F.col("id").alias("x"), F.col("node").alias("u")), "x").join(ids.select(F.col("id").alias("y"), F.col("node").alias("v")), "y")
    return cut(pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "cosine"), "pairs")


def nearest(nodes: DataFrame, n: int = 10, threshold: float = COSINE) -> DataFrame:
    """(node, other, cosine, position): the ``n`` nearest nodes of each node by cosine,
    the smaller one first where two are equally near.

    ``clusters`` takes all pairs above the threshold instead: with more variants of
    a name than ``n``, average linkage would miss links between them.
    """
    pairs = cosine_pairs(nodes, threshold, check=False)
    both = pairs.selectExpr("a as node", "b as other", "cosine").unionByName(pairs.selectExpr("b as node", "a as other", "cosine"))
    ranked = both.withColumn("position", F.row_number().over(W.partitionBy("node").orderBy(F.desc(F.round("cosine", 9)), "other")))
    return ranked.where(F.col("position") <= n)


def average_linkage(edges: DataFrame, threshold: float = LINKAGE) -> DataFrame:
    """(node, cluster) of all nodes that have an edge (a, b, sim), grouped by
    average linkage; pairs without an edge count as 0."""
    e = cut(edges.select("a", "b", F.col("sim").alias("s")), "edges")
    members = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cluster", F.col("node"))
    sizes = members.select("cluster", F.lit(1).cast("bigint").alias("size"))
    # each round merges the nearest pair of all at least, so the rounds end
    while True:
        mean = e.join(sizes.select(F.col("cluster").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("size").alias("nb")), "b")
        mean = mean.withColumn("avg", F.round(F.col("s") / (F.col("na") * F.col("nb")), 9)).where(F.col("avg") >= threshold)
        both = mean.select("a", "b", "avg").unionByName(mean.select(F.col("b").alias("a"), F.col("a").alias("b"), "avg"))
        # the nearest, the smaller pair first where there are several
        best = both.groupBy("a").agg(F.min(F.struct(-F.col("avg"), F.least("a", "b"), F.greatest("a", "b"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        back = best.select(F.col("a").alias("b"), F.col("b").alias("a"))
        merged = cut(best.join(back, ["a", "b"]).where("a < b").select(F.col("a").alias("to"), F.col("b").alias("cluster")), "merges")
        if merged.isEmpty():
            break
        old = members, e
        new = lambda df, col: df.join(merged.withColumnRenamed("cluster", col), col, "left").withColumn(col, F.coalesce("to", col)).drop("to")
        members = cut(new(members, "cluster"), "members")
        sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
        e = new(new(e, "a"), "b").where("a <> b")
        e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").groupBy("a", "b").agg(F.sum("s").alias("s")), "edges")
        free(*old, merged)
    return members


def clusters(named: DataFrame) -> DataFrame:
    """(name, node, cluster) of all names; a node without a partner is its own."""
    nodes = cut(named.select("node").distinct(), "nodes")
    pairs = cosine_pairs(nodes)
    edges = pairs.select("a", "b", ((F.col("cosine") + F.col("words")) / 2).alias("sim"))
    groups = average_linkage(edges)
    return named.join(groups, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
