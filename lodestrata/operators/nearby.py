"""Points near other points, and points inside regions.

``points_within`` joins two point sets by great-circle distance. Points become
unit vectors; a k-d tree of splits, drawn from a bounded sample, cuts space into
leaves of about equal load. A candidate point lives in one leaf; a query point is
copied into every leaf that its chord ball touches (the halo), so each leaf can
be answered alone by a local k-d tree. The splits only decide the balance, never
the result. A leaf that cannot be cut further, because its points lie at one
place, is cut into a grid of blocks by id, so no task gets an unbounded group.

``points_in_regions`` tests points against polygons by sweeping the polygons'
edges along the longitude. Few edges travel with the task; many are cut, with
the points, into strips of longitude.

Edge cases: a row whose id, latitude or longitude is null, NaN or out of range,
or which lies at exactly 0/0, has no place and takes part in nothing; an id that
comes several times is at the place of its latest row; empty inputs give an
empty result; columns other than those named are not read, so clashing names do
no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import cut

EARTH_M = 6_371_000.0
#: Rows of either side that the splits are drawn from, at most about.
SAMPLE_ROWS = 60_000
#: Candidates and queries that a block should hold.
BLOCK_CANDIDATES, BLOCK_QUERIES = 20_000, 10_000
#: Up to so many polygon edges travel with every task; beyond, strips are cut.
TASK_EDGES = 200_000
#: Distance computations done at once in a leaf of the local tree.
MATRIX_CELLS = 2_000_000


def placed(df: DataFrame, key: str, lat: str, lon: str, newest: str | None = None) -> DataFrame:
    """(id, lat, lon) of the rows that have a place, one per id: that of the row
    with the greatest ``newest``, then the greatest coordinates."""
    rows = df.select(F.col(key).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), (F.col(newest) if newest else F.lit(0)).alias("_new"))
    rows = rows.where(
        "id is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)"
        " and lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)"
    )
    last = rows.groupBy("id").agg(F.max(F.struct("_new", "lat", "lon")).alias("_r"))
    return last.select("id", "_r.lat", "_r.lon")


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    c = np.cos(a)
    return np.column_stack((c * np.cos(o), c * np.sin(o), np.sin(a)))


def great_circle_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    a1, a2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def chord(radius_m: float) -> float:
    """Straight-line length, on the unit sphere, of an arc of ``radius_m``."""
    return 2 * math.sin(min(math.pi, radius_m / EARTH_M) / 2)


class Splits:
    """k-d splits of space into leaves, and of leaves into blocks."""

    def __init__(self, cand: np.ndarray, query: np.ndarray, cand_scale: float, query_scale: float, reach: float) -> None:
        self.reach = reach
        self.dim: list[int] = []
        self.at: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.first: list[int] = []
        self.cand_parts: list[int] = []
        self.query_parts: list[int] = []
        self.blocks = 0
        both = np.vstack((cand, query))
        weight = np.concatenate((np.full(len(cand), cand_scale / BLOCK_CANDIDATES), np.full(len(query), query_scale / BLOCK_QUERIES)))
        self._grow(both, weight, np.arange(len(both)) < len(cand))

    def _grow(self, pts: np.ndarray, weight: np.ndarray, is_cand: np.ndarray) -> int:
        me = len(self.dim)
        for part in (self.dim, self.at, self.kids, self.first, self.cand_parts, self.query_parts):
            part.append(-1)
        load = weight.sum()
        if load > 1 and len(pts):
            low, high = pts.min(0), pts.max(0)
            d = int(np.argmax(high - low))
            if high[d] - low[d] > 2 * self.reach:
                order = np.argsort(pts[:, d], kind="stable")
                half = np.searchsorted(np.cumsum(weight[order]), load / 2)
                cut = float(pts[order[min(half, len(order) - 1)], d])
                cut = cut if cut < high[d] else float((low[d] + high[d]) / 2)
                left = pts[:, d] <= cut
                self.dim[me], self.at[me] = d, cut
                a = self._grow(pts[left], weight[left], is_cand[left])
                b = self._grow(pts[~left], weight[~left], is_cand[~left])
                self.kids[me] = (a, b)
                return me
        self.first[me] = self.blocks
        self.cand_parts[me] = max(1, math.ceil(weight[is_cand].sum() * 0.5))
        self.query_parts[me] = max(1, math.ceil(weight[~is_cand].sum() * 0.5))
        self.blocks += self.cand_parts[me] * self.query_parts[me]
        return me

    def frozen(self) -> dict:
        kids = np.array([k if isinstance(k, tuple) else (-1, -1) for k in self.kids])
        return {
            "dim": np.array(self.dim), "at": np.array(self.at, float), "left": kids[:, 0], "right": kids[:, 1],
            "first": np.array(self.first), "cp": np.array(self.cand_parts), "qp": np.array(self.query_parts), "reach": self.reach,
        }


def _leaves(tree: dict, xyz: np.ndarray, reach: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf within ``reach`` of each row."""
    row, node = np.arange(len(xyz)), np.zeros(len(xyz), int)
    reach = np.broadcast_to(reach, len(xyz))
    rows, leaves = [], []
    while len(row):
        d = tree["dim"][node]
        end = d < 0
        rows.append(row[end])
        leaves.append(node[end])
        row, node, d = row[~end], node[~end], d[~end]
        x, cut = xyz[row, d], tree["at"][node]
        low, high = x - reach[row] <= cut, x + reach[row] > cut
        row, node = np.concatenate((row[low], row[high])), np.concatenate((tree["left"][node[low]], tree["right"][node[high]]))
    return np.concatenate(rows or [row]), np.concatenate(leaves or [node])


def _mixed(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))) & np.uint64(0x7FFFFFFF)


def _spread(tree: dict, is_cand: bool):
    """Arrow mapper that gives each row the blocks in which it takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lat, lon = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            row, leaf = _leaves(tree, unit_vectors(lat, lon), 0.0 if is_cand else tree["reach"])
            own, other = (tree["cp"], tree["qp"]) if is_cand else (tree["qp"], tree["cp"])
            part = (_mixed(ids[row]) % own[leaf].astype(np.uint64)).astype(int)
            copies = other[leaf]
            row, leaf, part = (np.repeat(x, copies) for x in (row, leaf, part))
            k = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            block = tree["first"][leaf] + (part * tree["qp"][leaf] + k if is_cand else k * tree["qp"][leaf] + part)
            more = [c.take(pa.array(row)) for c in b.columns[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(ids[row]), pa.array(lat[row]), pa.array(lon[row]), *more], names=["block", "id", "lat", "lon", *b.schema.names[3:]])

    return run


class BallTree:
    """A k-d tree over points in memory, asked for many balls at once."""

    LEAF = 128

    def __init__(self, pts: np.ndarray) -> None:
        self.order = np.arange(len(pts))
        self.pts = pts
        self.nodes: list[tuple[int, int, int, float, int, int]] = []
        self._build(0, len(pts))

    def _build(self, lo: int, hi: int) -> int:
        me = len(self.nodes)
        self.nodes.append((lo, hi, -1, 0.0, -1, -1))
        own = self.pts[self.order[lo:hi]]
        if hi - lo > self.LEAF:
            d = int(np.argmax(own.max(0) - own.min(0)))
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, d], mid)]
            cut = float(self.pts[self.order[lo + mid], d])
            a, b = self._build(lo, lo + mid), self._build(lo + mid, hi)
            self.nodes[me] = (lo, hi, d, cut, a, b)
        return me

    def parts(self, query: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) indexes of all pairs at most ``reach`` apart, no more than
        ``MATRIX_CELLS`` at once."""
        near = reach * reach * (1 + 1e-9)
        stack = [(0, np.arange(len(query)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            lo, hi, d, cut, a, b = self.nodes[node]
            if d >= 0:
                x = query[q, d]
                stack += [(a, q[x - reach <= cut]), (b, q[x + reach >= cut])]
                continue
            own = self.order[lo:hi]
            pts = self.pts[own]
            if not len(own):
                continue
            for k in range(0, len(q), step := max(1, MATRIX_CELLS // len(own))):
                part = q[k : k + step]
                gap = query[part][:, None, :] - pts[None, :, :]
                i, j = np.nonzero(np.einsum("ijk,ijk->ij", gap, gap) <= near)
                yield part[i], own[j]

    def pairs(self, query: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) indexes of all pairs at most ``reach`` apart."""
        found, none = list(self.parts(query, reach)), np.zeros(0, int)
        return np.concatenate([q for q, _ in found] or [none]), np.concatenate([p for _, p in found] or [none])

    def nearest(self, query: np.ndarray, reach: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(point or -1, squared distance) of the nearest point of each query within its
        own ``reach``; of equally near ones the one with the smallest rank."""
        best, at = reach * reach * (1 + 1e-9), np.full(len(query), -1)
        rank = np.arange(len(self.pts)) if rank is None else rank
        stack = [(0, np.arange(len(query)), np.zeros(len(query)))]
        while stack:
            node, q, gap = stack.pop()
            q = q[gap * gap <= best[q]]
            if not len(q):
                continue
            lo, hi, d, cut, a, b = self.nodes[node]
            if d >= 0:
                off = query[q, d] - cut
                left = off <= 0
                # the far halves first on the stack, so that the near ones are asked before them
                for kid, own in ((a, ~left), (b, left)):
                    stack.append((kid, q[own], np.abs(off[own])))
                for kid, own in ((a, left), (b, ~left)):
                    stack.append((kid, q[own], np.zeros(int(own.sum()))))
                continue
            own = self.order[lo:hi]
            if not len(own):
                continue
            own = own[np.argsort(rank[own], kind="stable")]
            for k in range(0, len(q), step := max(1, MATRIX_CELLS // len(own))):
                part = q[k : k + step]
                way = query[part][:, None, :] - self.pts[own][None, :, :]
                dist = np.einsum("ijk,ijk->ij", way, way)
                j = dist.argmin(1)
                got, point = dist[np.arange(len(part)), j], own[j]
                better = (got < best[part]) | ((got == best[part]) & ((at[part] < 0) | (rank[point] < rank[at[part]])))
                best[part[better]], at[part[better]] = got[better], point[better]
        return at, best


def _answer(reach: float, radius_m: float, schema: pa.Schema):
    """Grouped Arrow function: the pairs of one block."""

    def run(query: pa.Table, cand: pa.Table) -> pa.Table:
        if not query.num_rows or not cand.num_rows:
            return schema.empty_table()
        qi, qa, qo = (query.column(k).to_numpy() for k in ("id", "lat", "lon"))
        ci, ca, co = (cand.column(k).to_numpy() for k in ("id", "lat", "lon"))
        i, j = BallTree(unit_vectors(ca, co)).pairs(unit_vectors(qa, qo), reach)
        metres = great_circle_m(qa[i], qo[i], ca[j], co[j])
        near = metres <= radius_m
        return pa.table([pa.array(qi[i[near]]), pa.array(ci[j[near]]), pa.array(metres[near])], schema=schema)

    return run


def _sample(df: DataFrame, rows: int) -> tuple[np.ndarray, float]:
    """Coordinates of about ``SAMPLE_ROWS`` rows, and how many rows each stands for."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    got = (df.sample(share, seed=7) if share < 1 else df).select("lat", "lon").where("lat between -90 and 90 and lon between -180 and 180").toPandas()
    return unit_vectors(got["lat"].to_numpy(float), got["lon"].to_numpy(float)), 1 / share


def points_within(
    queries: DataFrame, candidates: DataFrame, radius_m: float, query_sample: tuple[DataFrame, int] | None = None, candidate_sample: tuple[DataFrame, int] | None = None
) -> DataFrame:
    """(query_id, candidate_id, metres) of all pairs at most ``radius_m`` apart.

    Both inputs have (id bigint, lat double, lon double), ids unique, as
    ``placed`` makes them. The splits are drawn from the inputs themselves or,
    to spare a pass, from the (lat/lon rows, row count) given as samples.
    """
    reach = chord(radius_m)
    q_xyz, q_scale = _sample(*(query_sample or (queries, queries.count())))
    c_xyz, c_scale = _sample(*(candidate_sample or (candidates, candidates.count())))
    tree = Splits(c_xyz, q_xyz, c_scale, q_scale, reach).frozen()
    kind = "block int, id bigint, lat double, lon double"
    cols = [F.col("id").cast("bigint"), "lat", "lon"]
    q = queries.select(*cols).mapInArrow(_spread(tree, False), kind)
    c = candidates.select(*cols).mapInArrow(_spread(tree, True), kind)
    schema = pa.schema([("query_id", pa.int64()), ("candidate_id", pa.int64()), ("metres", pa.float64())])
    return q.groupBy("block").cogroup(c.groupBy("block")).applyInArrow(_answer(reach, radius_m, schema), "query_id bigint, candidate_id bigint, metres double")


def _first(reach: float, edges_m: Sequence[float], schema: pa.Schema):
    """Grouped Arrow function: each query's first candidate of one block. Pairs are
    looked at in parts of bounded size, and none is kept."""
    edges = np.array(edges_m, float)

    def run(query: pa.Table, cand: pa.Table) -> pa.Table:
        if not query.num_rows or not cand.num_rows:
            return schema.empty_table()
        qi, qa, qo = (query.column(k).to_numpy() for k in ("id", "lat", "lon"))
        ci, ca, co, layer = (cand.column(k).to_numpy() for k in ("id", "lat", "lon", "layer"))
        order = np.lexsort((ci, layer))
        rank = np.empty(len(ci), np.int64)
        rank[order] = np.arange(len(ci))
        none = len(edges) * len(ci)
        best = np.full(len(qi), none)
        for i, j in BallTree(unit_vectors(ca, co)).parts(unit_vectors(qa, qo), reach):
            ring = np.searchsorted(edges, great_circle_m(qa[i], qo[i], ca[j], co[j]))
            np.minimum.at(best, i, np.minimum(ring * len(ci) + rank[j], none))
        hit = best < none
        ring, at = best[hit] // len(ci), order[best[hit] % len(ci)]
        return pa.table([pa.array(qi[hit]), pa.array(ring.astype(np.int32)), pa.array(layer[at]), pa.array(ci[at])], schema=schema)

    return run


def first_within(queries: DataFrame, candidates: DataFrame, edges_m: Sequence[float]) -> DataFrame:
    """(query_id, ring, layer, candidate_id): of all candidates within the last of
    ``edges_m`` (rising) the one in the innermost ring, there of the smallest layer,
    there with the smallest id. Queries without any give no row.

    Candidates have (id bigint, lat double, lon double, layer bigint), without nulls.
    Of candidates at one place only the first can be an answer, and queries at one
    place have the same answer, so each place is asked and answers once; a block
    gives one row per place that asks, however many candidates are near.
    """
    reach = chord(edges_m[-1])
    q = cut(queries.groupBy("lat", "lon").agg(F.min(F.col("id").cast("bigint")).alias("id")).select("id", "lat", "lon"), "asked")
    c = candidates.groupBy("lat", "lon").agg(F.min(F.struct(F.col("layer").cast("bigint").alias("layer"), F.col("id").cast("bigint").alias("id"))).alias("_c"))
    c = cut(c.select("_c.id", "lat", "lon", "_c.layer"), "places")
    q_xyz, q_scale = _sample(q, q.count())
    c_xyz, c_scale = _sample(c, c.count())
    tree = Splits(c_xyz, q_xyz, c_scale, q_scale, reach).frozen()
    kind = "block int, id bigint, lat double, lon double"
    schema = pa.schema([("id", pa.int64()), ("ring", pa.int32()), ("layer", pa.int64()), ("candidate_id", pa.int64())])
    blocks = q.mapInArrow(_spread(tree, False), kind).groupBy("block").cogroup(c.mapInArrow(_spread(tree, True), f"{kind}, layer bigint").groupBy("block"))
    found = blocks.applyInArrow(_first(reach, edges_m, schema), "id bigint, ring int, layer bigint, candidate_id bigint").groupBy("id").agg(F.min(F.struct("ring", "layer", "candidate_id")).alias("_m"))
    at = q.join(found, "id").select("lat", "lon", "_m")
    return queries.select(F.col("id").alias("query_id"), "lat", "lon").join(at, ["lat", "lon"]).select("query_id", "_m.ring", "_m.layer", "_m.candidate_id")


def nearest_of(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, candidate_id, metres): the nearest candidate of each query, the one
    with the smaller id where two are equally near.

    The nearest row of a bounded sample of the candidates bounds each query's
    distance; the query goes to the leaves within that bound only, and every leaf
    answers with its own nearest. Nothing is paired but one candidate per leaf.
    """
    kinds = "query_id bigint, candidate_id bigint, metres double"
    n = candidates.count()
    near, scale = _sample(candidates, n)
    while n and not len(near):  # a sample may be empty by chance
        near, scale = _sample(candidates.limit(SAMPLE_ROWS), min(n, SAMPLE_ROWS))
    q_xyz, q_scale = _sample(queries, queries.count())
    tree = Splits(near, q_xyz, scale, q_scale, 0.0).frozen()
    cols = [F.col("id").cast("bigint"), "lat", "lon"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = BallTree(near)
        for b in batches:
            ids, lat, lon = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            xyz = unit_vectors(lat, lon)
            reach = np.sqrt(known.nearest(xyz, np.full(len(xyz), 2.1))[1]) * (1 + 1e-9) + 1e-12
            row, leaf = _leaves(tree, xyz, reach)
            part = (_mixed(ids[row]) % tree["qp"][leaf].astype(np.uint64)).astype(int)
            copies = tree["cp"][leaf]
            row, leaf, part = (np.repeat(x, copies) for x in (row, leaf, part))
            k = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            block = tree["first"][leaf] + k * tree["qp"][leaf] + part
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(ids[row]), pa.array(lat[row]), pa.array(lon[row]), pa.array(reach[row])], names=["block", "id", "lat", "lon", "reach"])

    def answer(query: pa.Table, cand: pa.Table) -> pa.Table:
        qi, qa, qo, reach = (query.column(k).to_numpy() for k in ("id", "lat", "lon", "reach"))
        ci, ca, co = (cand.column(k).to_numpy() for k in ("id", "lat", "lon"))
        at = BallTree(unit_vectors(ca, co)).nearest(unit_vectors(qa, qo), reach, ci)[0] if len(ci) else np.full(len(qi), -1)
        hit = at >= 0
        j = at[hit]
        return pa.table({"query_id": pa.array(qi[hit], pa.int64()), "candidate_id": pa.array(ci[j], pa.int64()), "metres": pa.array(great_circle_m(qa[hit], qo[hit], ca[j], co[j]), pa.float64())})

    q = queries.select(*cols).mapInArrow(spread, "block int, id bigint, lat double, lon double, reach double")
    c = candidates.select(*cols).mapInArrow(_spread(tree, True), "block int, id bigint, lat double, lon double")
    got = q.groupBy("block").cogroup(c.groupBy("block")).applyInArrow(answer, kinds)
    return got.groupBy("query_id").agg(F.min(F.struct("metres", "candidate_id")).alias("_m")).select("query_id", "_m.candidate_id", "_m.metres")


# Regions


def ring_edges(regions: DataFrame, key: str, ring: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(region, x1, y1, x2, y2) of the edges with x1 < x2; the last corner is
    joined to the first. Upright edges cross no upright ray and are left out."""
    r = F.col("_ring")
    corners = F.filter(F.col(ring), lambda p: p[lat].isNotNull() & p[lon].isNotNull() & ~F.isnan(p[lat]) & ~F.isnan(p[lon]))
    nxt = F.concat(F.slice(r, F.lit(2), F.size(r)), F.slice(r, F.lit(1), F.lit(1)))
    pair = regions.where(F.col(key).isNotNull() & F.col(ring).isNotNull()).select(F.col(key).cast("bigint").alias("region"), corners.alias("_ring")).where(F.size(r) >= 3)
    e = pair.select("region", F.explode(F.arrays_zip(r.alias("a"), nxt.alias("b"))).alias("e")).select(
        "region", F.col(f"e.a.{lon}").alias("xa"), F.col(f"e.a.{lat}").alias("ya"), F.col(f"e.b.{lon}").alias("xb"), F.col(f"e.b.{lat}").alias("yb")
    )
    swap = F.col("xa") > F.col("xb")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return e.where("xa <> xb").select("region", pick("xa", "xb").alias("x1"), pick("ya", "yb").alias("y1"), pick("xb", "xa").alias("x2"), pick("yb", "ya").alias("y2")).distinct()


def sweep(px: np.ndarray, py: np.ndarray, edges: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(point, region) of the points inside regions, by a sweep along x.

    The edges' ends cut x into slabs. Going from slab to slab, edges enter and
    leave the active set; a point is inside a region if an odd number of the
    region's active edges passes above it. A point on the left end of an edge
    belongs to the edge, one on the right end doesn't.
    """
    none = np.zeros(0, int)
    if not len(px) or not len(edges["x1"]):
        return none, none
    by = np.argsort(edges["x1"], kind="stable")
    x1, y1, x2, y2, reg = (edges[k][by] for k in ("x1", "y1", "x2", "y2", "region"))
    slope = (y2 - y1) / (x2 - x1)
    ends = np.unique(np.concatenate((x1, x2)))
    slab = np.searchsorted(ends, px, "right") - 1
    order = np.argsort(slab, kind="stable")
    slabs, starts = np.unique(slab[order], return_index=True)
    enter, active, points, regions = np.searchsorted(x1, ends, "right"), none, [], []
    done = 0
    for s, lo, hi in zip(slabs, starts, [*starts[1:], len(order)]):
        if s < 0 or s >= len(ends) - 1:
            continue
        active = np.concatenate((active, np.arange(done, enter[s])))
        active = active[x2[active] > ends[s]]
        done = enter[s]
        if not len(active):
            continue
        act = active[np.argsort(reg[active], kind="stable")]
        first = np.nonzero(np.diff(reg[act], prepend=reg[act[0]] - 1))[0]
        for k in range(lo, hi, step := max(1, MATRIX_CELLS // len(act))):
            p = order[k : min(hi, k + step)]
            above = (y1[act] + (px[p][:, None] - x1[act]) * slope[act]) > py[p][:, None]
            i, j = np.nonzero(np.add.reduceat(above.astype(np.int32), first, axis=1) % 2)
            points.append(p[i])
            regions.append(reg[act[first[j]]])
    return np.concatenate(points or [none]), np.concatenate(regions or [none])


def points_in_regions(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, region) of the points inside each region; ``edges`` as ``ring_edges``
    makes them, ``points`` with (id, lat, lon)."""
    kind = "id bigint, region bigint"
    pts = points.select(F.col("id").cast("bigint"), "lat", "lon")
    n = edges.count()
    names = ["region", "x1", "y1", "x2", "y2"]

    def answer(ids: np.ndarray, lat: np.ndarray, lon: np.ndarray, e: dict) -> list[pa.Array]:
        i, region = sweep(lon, lat, e)
        return [pa.array(ids[i], pa.int64()), pa.array(region, pa.int64())]

    if n <= TASK_EDGES:
        got = edges.select(*names).toPandas()
        e = {k: got[k].to_numpy() for k in names}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays(answer(*(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)), e), names=["id", "region"])

        return pts.mapInArrow(run, kind)

    rows = pts.count()
    strips = max(1, math.ceil(rows / BLOCK_QUERIES))
    at = sorted({float(x) for x in pts.approxQuantile("lon", [k / strips for k in range(1, strips)], 0.2 / strips)}) if strips > 1 else []
    cuts = np.array(at)

    def strip_of(x: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, x, "right")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n = np.unique(strip_of(b.column(2).to_numpy(zero_copy_only=False)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n.astype(np.int64))], names=["strip", "n"])

    load = np.zeros(len(at) + 1)
    for r in pts.mapInArrow(counted, "strip int, n bigint").groupBy("strip").agg(F.sum("n").alias("n")).collect():  # one row per strip
        load[r["strip"]] = r["n"]
    parts = np.maximum(1, np.ceil(load / (2 * BLOCK_QUERIES))).astype(np.int64)

    def spread_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lat, lon = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            strip = strip_of(lon)
            yield pa.RecordBatch.from_arrays([pa.array(strip.astype(np.int32)), pa.array((_mixed(ids).astype(np.int64) % parts[strip]).astype(np.int32)), *b.columns], names=["strip", "part", "id", "lat", "lon"])

    def spread_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last = strip_of(b.column(1).to_numpy(zero_copy_only=False)), strip_of(b.column(3).to_numpy(zero_copy_only=False))
            n = last - first + 1
            row = np.repeat(np.arange(b.num_rows), n)
            strip = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            copies = parts[strip]
            row, strip = np.repeat(row, copies), np.repeat(strip, copies)
            part = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pa.RecordBatch.from_arrays([pa.array(strip.astype(np.int32)), pa.array(part.astype(np.int32)), *(c.take(pa.array(row)) for c in b.columns)], names=["strip", "part", *names])

    p = pts.mapInArrow(spread_points, "strip int, part int, id bigint, lat double, lon double")
    e = edges.select(*names).mapInArrow(spread_edges, "strip int, part int, region bigint, x1 double, y1 double, x2 double, y2 double")
    schema = pa.schema([("id", pa.int64()), ("region", pa.int64())])

    def one(own: pa.Table, near: pa.Table) -> pa.Table:
        if not own.num_rows or not near.num_rows:
            return schema.empty_table()
        return pa.table(answer(*(own.column(k).to_numpy() for k in ("id", "lat", "lon")), {k: near.column(k).to_numpy() for k in names}), schema=schema)

    return p.groupBy("strip", "part").cogroup(e.groupBy("strip", "part")).applyInArrow(one, kind)
