"""Mixing of sources to target weights, in tokens of a public tokenizer.

Weights go down a tree (domain if domains are given, source, language). A node gets its weight's
share of its parent's budget but no more than its leaves can give, each at most
so many times its size; what a node can't take goes to its siblings, and only
what all of them can't take goes to the siblings of their parent. The tree has
one leaf per source and language, so it is worked out on the driver.

Each leaf is then used in seeded epochs: whole epochs take every document, the
last one the documents of a seeded order up to the tokens that are left. The
order is cut into buckets of a hash; the sums of the buckets tell where the cut
is, and only that bucket's documents are put in order, so a leaf of any size is
never sorted in one task.

Edge cases: a null text has no tokens and is never chosen; documents of a source
without a target, or with a null source, are not used; a source without any token
can't be used and its share goes to the others; a target of 0, or none at all,
uses nothing; a null language is a leaf of its own; ties of the order go to the
smaller id; texts are counted whole, whatever their length.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE_CHARS = 20_000
BUCKETS = 4096


@functools.cache
def _encoding(path: str):
    import tiktoken

    try:
        from public_tokenizers import PATTERN
    except ImportError:  # the usual pattern of byte-level vocabularies
        PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a text; a long one is cut before single blanks between letters,
    where the tokenizer cuts as well."""
    enc = _encoding(path)
    n, at = 0, 0
    while at < len(text):
        end = at + PIECE_CHARS
        if end < len(text):
            cut = text.rfind(" ", at + 1, end)
            while cut > at and not (text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
                cut = text.rfind(" ", at + 1, cut)
            end = cut if cut > at else end
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def sized(docs: DataFrame, key: str, text: str, path_cols: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, path columns, tokens) of all documents."""
    names = ["doc_id", *path_cols, "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, tokenizer) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=names)

    kind = ", ".join(["doc_id bigint", *[f"{c} string" for c in path_cols], "tokens bigint"])
    cols = [F.col(key).cast("bigint").alias("doc_id"), *[F.col(c).cast("string") for c in path_cols], F.col(text).cast("string").alias("_t")]
    return docs.select(*cols).where("doc_id is not null").mapInArrow(run, kind)


@dataclass
class Node:
    """A part of the mixture: its weight among its siblings and what it holds."""

    weight: float | None = None  # None: by size
    tokens: int = 0
    repeats: int = 1
    kids: dict[str | None, Node] = field(default_factory=dict)
    budget: float = 0.0

    def size(self) -> int:
        return sum(k.size() for k in self.kids.values()) if self.kids else self.tokens

    def most(self) -> float:
        return sum(k.most() for k in self.kids.values()) if self.kids else float(self.tokens * self.repeats)

    def share(self) -> float:
        return float(self.size()) if self.weight is None else self.weight

    def give(self, budget: float) -> float:
        """Spread a budget over the leaves; returns what could not be placed."""
        self.budget = min(budget, self.most())
        left, open_ = self.budget, [k for k in self.kids.values() if k.share() > 0 and k.most() > 0]
        got = {id(k): 0.0 for k in open_}
        while open_ and left > 1e-6:
            total = sum(k.share() for k in open_)
            full = [k for k in open_ if k.most() - got[id(k)] <= left * k.share() / total]
            if not full:
                for k in open_:
                    got[id(k)] += left * k.share() / total
                left = 0.0
            for k in full:
                left -= k.most() - got[id(k)]
                got[id(k)] = k.most()
                open_.remove(k)
        for k in self.kids.values():
            k.give(got.get(id(k), 0.0))
        if self.kids:
            self.budget -= max(0.0, left)
        return budget - self.budget


def largest_exact(root: Node) -> float:
    """The largest total at which every child with tokens gets just its share."""
    kids = [k for k in root.kids.values() if k.share() > 0 and k.most() > 0]
    total = sum(k.share() for k in kids)
    return min((k.most() * total / k.share() for k in kids), default=0.0)


def plan(sizes: list[tuple[str | None, str | None, int]], targets: dict[str, tuple[float, int]], total: float | None = None, domains: dict[str, str] | None = None) -> Node:
    """The budget tree of (source, language, tokens) under targets (share, repeats);
    without a total, the largest that meets every target.

    ``domains`` puts sources together: a domain's weight is the sum of its sources',
    and what one of them lacks goes to the others of the domain before it goes to
    other domains.
    """
    root = Node()
    for source, lang, tokens in sizes:
        if source in targets:
            share, repeats = targets[source]
            over = root
            if domains is not None:
                over = root.kids.setdefault(domains.get(source, source), Node(weight=0.0))
            if source not in over.kids:
                over.kids[source] = Node(weight=share)
                if over is not root:
                    over.weight += share
            leaf = over.kids[source].kids.setdefault(lang, Node(repeats=repeats))
            leaf.tokens += tokens
    root.give(largest_exact(root) if total is None else total)
    return root


def each_leaf(node: Node, path: tuple = ()) -> Iterator[tuple[tuple, Node]]:
    """(path, leaf) of all leaves."""
    for name, kid in node.kids.items():
        if kid.kids:
            yield from each_leaf(kid, (*path, name))
        else:
            yield (*path, name), kid


def select(counted: DataFrame, root: Node, seed: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, source, lang, tokens, repeats) of the chosen documents."""
    spark = counted.sparkSession
    rows = []
    for (*_, source, lang), leaf in each_leaf(root):
        if leaf.tokens and leaf.budget > 0:
            whole = min(leaf.repeats, int(leaf.budget // leaf.tokens))
            rows.append((source, lang, whole, int(leaf.budget - whole * leaf.tokens)))
    leaves = spark.createDataFrame(rows, "source string, lang string, epochs int, rest bigint")
    same = counted["source"].eqNullSafe(leaves["source"]) & counted["lang"].eqNullSafe(leaves["lang"])
    # one row per source and language
    docs = counted.join(F.broadcast(leaves), same).select("doc_id", counted["source"], counted["lang"], "tokens", "epochs", "rest").where("tokens > 0")
    docs = docs.withColumn("_h", F.xxhash64(F.lit(seed), "epochs", "doc_id")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    per = docs.groupBy("source", "lang", "rest", "_b").agg(F.sum("tokens").alias("_n"))
    upto = per.withColumn("_end", F.sum("_n").over(W.partitionBy("source", "lang").orderBy("_b")))
    cut = upto.where("_end - _n < rest").groupBy("source", "lang").agg(F.max("_b").alias("_cut"), F.max_by(F.col("_end") - F.col("_n"), "_b").alias("_before"))
    # at most one row per source and language again
    edge = docs.join(F.broadcast(cut.withColumnRenamed("source", "_s").withColumnRenamed("lang", "_l")), docs["source"].eqNullSafe(F.col("_s")) & docs["lang"].eqNullSafe(F.col("_l")), "left").drop("_s", "_l")
    inside = edge.where("_b = _cut").withColumn("_run", F.sum("tokens").over(W.partitionBy("source", "lang").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, 0)))
    # the document on the edge is taken if most of it is still wanted
    last = inside.where("_before + _run - tokens / 2 <= rest").select("doc_id", F.lit(1).alias("_x"), "_h")
    extra = edge.where("_b < _cut").select("doc_id", F.lit(1).alias("_x"), "_h").unionByName(last)
    got = edge.select("doc_id", "source", "lang", "tokens", "epochs", "_h").join(extra, ["doc_id", "_h"], "left")
    return got.withColumn("repeats", F.col("epochs") + F.coalesce("_x", F.lit(0))).where("repeats > 0").select("doc_id", "source", "lang", "tokens", "repeats")
