"""Matching of records across two tables without a common key.

Records are reduced to what a match can rest on (``names``): the project's own
name, its unit, the municipality and the organisation. Candidate pairs share a
block; every pair gets a vector of similarities. A Gaussian mixture of two
components, matched and unmatched, is fitted to the vectors without labels:

* each component has its own means and variances; the variances are regularised
  by a share of those of all pairs and from below, so none collapses on ties;
* similarities that can't be computed are marginalised, not guessed;
* a fit without constraints is the start; from there on, in every round of
  expectation-maximisation, up to convergence, the posteriors are made transitive
  before they are summed up: if a record would match two others, the product of
  the two posteriors may not exceed the posterior that these two are the same,
  and what exceeds it is taken from the weaker one.

The maximisation sees all pairs: the vectors lie on a grid, and pairs that lie
alike (their own point, that of the record's best match and that of the two
matches) are counted once by Spark, so a round reads the counts only. What comes
to the driver is at most one row per point of the grid, however many pairs there
are. Covariances are diagonal; that is part of the regularisation.

Candidates share a block: what is left of the name without up to two letters, for
names of over ``LONG`` letters one of five segments, at least one of which two
edits leave whole, or organisation and place. Blocks with many records are cut
into pieces that no task has to join alone.

Edge cases: a null country, or a name without any letters, matches nothing;
missing municipalities and organisations are no evidence either way; repeated
records are compared once and all get their match; empty tables give no match;
ties go to the record with the same status, then to the smaller key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm import names
from lodestrata.runtime import cut, free

#: Similarities are rounded to this step; the grid has (1 / STEP + 2) points per feature.
STEP = 0.05
FEATURES = ("core", "place", "org")
AXIS = round(1 / STEP) + 2
#: Bounds on the rounds of the start and of the transitive fit; both end when no mean moves by more than ``STILL``.
ROUNDS, STILL = 60, 1e-4
#: Names longer than this are found by segments.
LONG = 20
#: Records of a block that are joined in one piece.
PIECE = 5_000
#: Share of the variance of all pairs that is added to each component's.
REGULAR = 0.02
#: No component is narrower than this; a slip of typing moves a similarity so far.
LEAST_SD = 0.1
MIN_POSTERIOR = 0.5

READ = "sig bigint, country string, core string, unit string, place string, org string, carried boolean, status string, blocks array<string>"


def segments(core: str, sought: bool) -> set[str]:
    """The five segments of a long name, or, of a name that is sought, all substrings
    that can be a segment of a name at most two edits away."""
    out, n = set(), len(core)
    for size in range(n - 2, n + 3) if sought else (n,):
        ends = [size * k // 5 for k in range(6)]
        for k in range(5):
            for move in range(-2, 3) if sought else (0,):
                a, b = ends[k] + move, ends[k + 1] + move
                if 0 <= a and b <= n:
                    out.add(f"{size}/{k}/{core[a:b]}")
    return out


def _read(batches: Iterator[pa.RecordBatch], every_org: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig, name, operator, muni, country, status = (b.column(k).to_pylist() for k in range(6))
        fn, fo, fm = names.folded(name), names.folded(operator), names.folded(muni)
        rows = []
        for k in range(b.num_rows):
            p = names.project(fn[k])
            org = p.promoter or (names.organisation(fo[k]) if fo[k] else "")
            place = names.place(fm[k]) if fm[k] else ""
            c = (country[k] or "").strip().upper()
            blocks: list[str] = []
            if c and p.core:
                if len(p.core) <= LONG:
                    blocks += [f"{c}|{p.unit}|{s}" for s in names.shortened(p.core, 2 if len(p.core) >= 5 else 1)]
                if len(p.core) >= LONG - 1:
                    blocks += [f"{c}|{p.unit}|{s}" for s in segments(p.core, every_org)]
            if c and org and place and (every_org or not p.core):
                ends = {place[:3], place[-3:]}
                blocks += [f"{c}|@{names.FULL_NAME.get(w, w)}|{e}" for w in org.split() if len(w) > 3 for e in ends]
            rows.append((sig[k], c or None, p.core, p.unit, place, org, bool(p.promoter), status[k], blocks))
        cols = list(zip(*rows)) or [[] for _ in range(9)]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(cols, kinds)], names=["sig", "country", "core", "unit", "place", "org", "carried", "status", "blocks"])


def signatures(df: DataFrame, key: str, name: str, operator: str, place: str, country: str, status: str) -> DataFrame:
    """The rows with ``sig``, a number for what they say: equal rows are compared once."""
    cols = [F.col(c).cast("string") for c in (name, operator, place, country, status)]
    return df.select(F.col(key).alias("key"), *[c.alias(f"_{k}") for k, c in enumerate(cols)]).where("key is not null").withColumn("sig", F.xxhash64(*[F.coalesce(F.col(f"_{k}"), F.lit("\x00")) for k in range(5)]))


def read(signed: DataFrame, every_org: bool) -> DataFrame:
    rows = signed.select("sig", *[f"_{k}" for k in range(5)]).distinct()
    return rows.mapInArrow(lambda it: _read(it, every_org), READ).where("country is not null")


def _grid(x: float | None) -> float | None:
    return None if x is None else round(x / STEP) * STEP


def compare(a: tuple[str, str, str], b: tuple[str, str, str]) -> tuple[float | None, float | None, float | None]:
    """Similarities of (core, place, org); None where one side says nothing."""
    core = names.likeness(a[0], b[0]) if a[0] and b[0] else None
    place = names.place_likeness(a[1], b[1]) if a[1] and b[1] else None
    org = None
    if a[2] and b[2]:
        org = names.same_name(a[2], b[2]) or min(0.5, names.likeness(a[2], b[2]) / 2)
    return _grid(core), _grid(place), _grid(org)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = [x.to_pylist() for x in b.columns]
        got = [compare(x, y) for x, y in zip(zip(c[2], c[3], c[4]), zip(c[5], c[6], c[7]))]
        cols = list(zip(*got)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(v), pa.float64()) for v in cols)], names=["a", "b", *FEATURES])


def vectors(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, core, place, org) of pairs (a, b) of signatures."""
    said = lambda df, k: df.select(F.col("sig").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in FEATURES])
    both = pairs.join(said(left, "a"), "a").join(said(right, "b"), "b")
    return both.select("a", "b", *[f"{c}_a" for c in FEATURES], *[f"{c}_b" for c in FEATURES]).mapInArrow(_vectors, "a bigint, b bigint, core double, place double, org double")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of signatures that share a block; a unit that differs parts them."""
    x = left.select(F.col("sig").alias("a"), F.explode("blocks").alias("block")).withColumn("block", F.xxhash64("block"))
    y = right.select(F.col("sig").alias("b"), F.explode("blocks").alias("block")).withColumn("block", F.xxhash64("block"))
    # large blocks are cut by the right side's records, and the left side's go to every piece
    # (there are no more of these than rows by PIECE)
    large = F.broadcast(y.groupBy("block").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_k")).where("_k > 1"))
    x = x.join(large, "block", "left").select("a", "block", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1)).alias("_p"))
    y = y.join(large, "block", "left").select("b", "block", F.pmod("b", F.coalesce("_k", F.lit(1))).cast("int").alias("_p"))
    return x.join(y, ["block", "_p"]).select("a", "b").distinct()


class Mixture:
    """Two Gaussian components over similarities, each feature apart."""

    def __init__(self, points: np.ndarray, weight: np.ndarray) -> None:
        self.points, self.weight = points, weight
        seen = ~np.isnan(points)
        self.seen = seen
        self.filled = np.where(seen, points, 0.0)
        total = np.maximum((seen * weight[:, None]).sum(0), 1e-9)
        mean = (self.filled * weight[:, None]).sum(0) / total
        self.var0 = np.maximum((np.where(seen, (self.filled - mean) ** 2, 0) * weight[:, None]).sum(0) / total, 1e-4)
        # the start: vectors whose mean similarity is high are matches
        level = np.where(seen.any(1), self.filled.sum(1) / np.maximum(seen.sum(1), 1), 0)
        self.fit(np.where(level >= 0.85, 0.95, 0.05) * weight)

    def fit(self, matched: np.ndarray) -> None:
        parts = []
        for w in (matched, self.weight - matched):
            n = np.maximum((self.seen * w[:, None]).sum(0), 1e-9)
            mean = (self.filled * w[:, None]).sum(0) / n
            var = (np.where(self.seen, (self.filled - mean) ** 2, 0) * w[:, None]).sum(0) / n
            parts.append((mean, np.maximum(var + REGULAR * self.var0, LEAST_SD**2)))
        if parts[0][0].sum() < parts[1][0].sum():
            parts.reverse()
            matched = self.weight - matched
        self.parts = parts
        self.prior = float(np.clip(matched.sum() / max(self.weight.sum(), 1e-9), 1e-6, 1 - 1e-6))

    def posterior(self) -> np.ndarray:
        return self.posterior_at(self.points)

    def posterior_at(self, points: np.ndarray) -> np.ndarray:
        logs, seen = [], ~np.isnan(points)
        for (mean, var), prior in zip(self.parts, (self.prior, 1 - self.prior)):
            # a similarity above the matches' mean is no evidence against a match
            d = np.where(seen, points, 0.0) - mean
            if len(logs) == 0:
                d = np.minimum(d, 0)
            logs.append(math.log(prior) + np.where(seen, -0.5 * (d**2 / var + np.log(2 * np.pi * var)), 0).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -700, 700)))


def code(points: np.ndarray) -> np.ndarray:
    """The number of each point of the grid; what wasn't computed has a place of its own."""
    steps = np.where(np.isnan(points), 0, np.round(np.nan_to_num(points) / STEP) + 1).astype(np.int64)
    return (steps[:, 0] * AXIS + steps[:, 1]) * AXIS + steps[:, 2]


def every_point() -> np.ndarray:
    axis = np.array([math.nan, *(k * STEP for k in range(AXIS - 1))])
    return np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), -1).reshape(-1, 3)


def coded() -> Column:
    """The number of a pair's point, as ``code`` has it."""
    step = [F.coalesce(F.round(F.col(f) / STEP).cast("int") + 1, F.lit(0)) for f in FEATURES]
    return (step[0] * AXIS + step[1]) * AXIS + step[2]


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The point of two matches of one record; different units are never the same."""
    for b in batches:
        c = [x.to_pylist() for x in b.columns]
        got = [compare(x, y) if u == v else (0.0, 0.0, 0.0) for x, y, u, v in zip(zip(c[2], c[3], c[4]), zip(c[6], c[7], c[8]), c[5], c[9])]
        points = np.array([[math.nan if v is None else v for v in g] for g in got], float).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code(points))], names=["a", "b", "g2"])


def transitive(post: np.ndarray) -> Column:
    """Posterior of a pair at point g, when its record's best match is at g1 and the
    two matches are at g2; -1: there is no better match."""

    def run(g: pa.Array, g1: pa.Array, g2: pa.Array) -> pa.Array:
        g, g1, g2 = (np.asarray(x.cast(pa.int64())) for x in (g, g1, g2))
        most = np.where(g2 >= 0, post[np.maximum(g2, 0)] / np.maximum(post[np.maximum(g1, 0)], 1e-9), 1.0)
        return pa.array(np.minimum(post[g], most))

    return F.arrow_udf(run, "double")("g", "g1", "g2")


def fitted(pairs: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, p): posteriors of pairs (a, b, core, place, org, tie), one mixture
    fitted to all of them, transitive in every round."""
    keyed = pairs.withColumn("g", coded())
    grid = keyed.groupBy("g").agg(F.count("*").cast("double").alias("n")).toPandas()  # one row per point at most
    if not len(grid):
        return pairs.select("a", "b", F.lit(0.0).alias("p"))
    whole = every_point()
    numbers = grid["g"].to_numpy(np.int64)
    mix = Mixture(whole[numbers], grid["n"].to_numpy(float))

    def moved(before: list) -> bool:
        return any(np.abs(x[0] - y[0]).max() > STILL for x, y in zip(before, mix.parts))

    for _ in range(ROUNDS):
        before = mix.parts
        mix.fit(mix.posterior() * mix.weight)
        if not moved(before):
            break
    start = mix.posterior_at(whole)
    w = W.partitionBy("a").orderBy(F.desc("_p"), F.desc("tie"), "b")
    none = F.lit(-1).cast("bigint")
    likely = keyed.withColumn("_p", F.arrow_udf(lambda g: pa.array(start[np.asarray(g)]), "double")("g"))
    best = cut(likely.withColumn("b1", F.first("b").over(w)).withColumn("g1", F.first("g").over(w)), "best")
    said = right.select(F.col("sig").alias("b"), *[F.col(c).alias(f"{c}_r") for c in (*FEATURES, "unit")])
    doubt = best.where("b <> b1 and _p >= 0.01").select("a", "b", "b1")
    x = doubt.join(said, "b").join(said.select(F.col("b").alias("b1"), *[F.col(c).alias(c.replace("_r", "_1")) for c in said.columns[1:]]), "b1")
    x = x.select("a", "b", "core_r", "place_r", "org_r", "unit_r", "core_1", "place_1", "org_1", "unit_1").mapInArrow(_between, "a bigint, b bigint, g2 bigint")
    lie = cut(best.join(x, ["a", "b"], "left").select("a", "b", "g", F.when(F.col("g2").isNull(), none).otherwise(F.col("g1")).alias("g1"), F.coalesce("g2", none).alias("g2")), "points")
    counts = cut(lie.groupBy("g", "g1", "g2").agg(F.count("*").alias("n")), "counts")
    for _ in range(ROUNDS):
        before = mix.parts
        expected = counts.select("g", (transitive(mix.posterior_at(whole)) * F.col("n")).alias("e")).groupBy("g").agg(F.sum("e").alias("e")).toPandas()  # one row per point at most
        at = np.zeros(len(whole))
        at[expected["g"].to_numpy(np.int64)] = expected["e"]
        mix.fit(at[numbers])
        if not moved(before):
            break
    free(best, counts)
    return lie.select("a", "b", transitive(mix.posterior_at(whole)).alias("p"))


def match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, posterior): pairs of signatures that are the same, as ``read`` makes them.

    Pairs of which one carries its promoter's name have no core to compare; they
    get a mixture of their own.
    """
    pairs = vectors(candidates(left, right), left, right)
    status = lambda df, k: df.select(F.col("sig").alias(k), F.col("status").alias(f"_s{k}"))
    pairs = pairs.join(status(left, "a"), "a").join(status(right, "b"), "b").withColumn("tie", F.coalesce((F.col("_sa") == F.col("_sb")).cast("int"), F.lit(0))).drop("_sa", "_sb")
    pairs = cut(pairs, "pairs")
    named = fitted(pairs.where("core is not null"), right)
    carried = fitted(pairs.where("core is null"), right)
    return named.unionByName(carried).where(F.col("p") >= MIN_POSTERIOR).withColumnRenamed("p", "posterior")
