"""New batches checked for duplicates against everything accepted before.

An inverted index in a folder that all executors share holds, for each distinct
way an entry has been described (a signature), its tokens, what it said, and the
number of the first entry of its project. It is opened again by any later
session; a batch counts as taken in when its mark is written, and what a broken
run left behind is never read.

Entries are reduced to signatures. Those that the index knows are answered by
their number. The others are compared

* with entries that have a name of their own, too, within country and unit: names
  meet if they have in common what is left without one letter, or two where
  verification allows two. Names as far apart as that, swapped letters included,
  have something of this in common, so no pair is lost. What is left is hashed in
  the task, on whole arrays, and is neither stored nor shuffled; pairs without any
  of the evidence that different names need are dropped there by bounds on letters
  of the place, cells and addresses, which lose none that verification accepts;
* by tokens, which are stored: ``g``: for names of over ``LONG`` letters, the prefix
  of the rarest 3-grams: two edits spoil ``SPOILED`` at most, so one more than that
  is sure to meet; ``o``: organisation and place, and ``u``: the address of an
  article with place or neighbouring cells; these lead from or to an entry that
  carries no project's name.

Several batches that are there are taken in at once: one pass compares each entry
with those of its own batch and of all before it. A later batch, in this session
or another, is held against what is stored: signatures in buckets by country and
length of name, postings in buckets by token; files are sorted by bucket and in
small parts that say which buckets they hold. It reads only the parts of the
buckets that its own tokens and possible candidates name, so a small batch reads a
small part of the index, however much has been accepted. Nothing is rewritten.
Labels are settled per load: signatures of earlier loads bring their first number
along with the candidate pair.

Edge cases: entries without a country, or whose name and organisation both have
no letters, match nothing; missing places and coordinates are no evidence; an
address alone is none either; entries with equal words are compared once; entries
without a batch number are a batch of their own after all others; an entry whose
number is smaller than those accepted before becomes the first of its project;
a batch may be empty, and so may the table; columns that are not named are not
read.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm import names
from lodestrata.runtime import cut, free, mark, names_in, shared_path

BUCKETS = 1024
#: Postings of a token, in one load, that are joined in one piece.
PIECE = 1_000
#: So many buckets are picked out of the files; a batch that needs more reads them all.
FEW = 256
#: Bytes of a part of a file that can be left out by its buckets.
PART_BYTES = 1 << 20
#: Lengths of names that have buckets of their own; longer ones share the last.
LENGTHS = 60
#: Entries of one country and unit, in one load, whose names are compared in one piece.
GROUP = 20_000
#: Pairs that are looked at in one go.
CHUNK = 1_000_000
#: A cell that no place is in.
NOWHERE = -(1 << 40)
#: Fixed value: multiplier of the hashes of letters.
BASE = 0x9E3779B97F4A7C15
GRAM = 3
#: 3-grams that two edits can spoil; a swap of neighbours spoils four.
SPOILED = 8
#: Names longer than this are found by 3-grams where two letters are altered.
LONG = 20
#: Size of a cell of coordinates, in degrees; neighbours are near.
CELL = 0.02
#: Ordinary words for pages in addresses, which are no names.
PAGE_WORDS = set("site sites page pages article articles news actualites actualite avis dossier index home start liste list projet projets project projects projekt proyecto progetto".split())

SIGNATURE = "country string, core string, unit string, place string, org string, hint string, cell_a int, cell_b int, pages array<string>"
READ = f"no bigint, batch bigint, {SIGNATURE}, words array<string>"
STORED = {
    "postings": "token bigint, kind string, named boolean, sig bigint, bucket int",
    "signatures": f"sig bigint, no bigint, {SIGNATURE}, first_no bigint, bucket int",
    "moved": "first_no bigint, to_no bigint",
    "order": "gram string, df int",
}
NAMES = [c.split()[0] for c in SIGNATURE.split(", ")]
LINKS = "new bigint, old bigint, seen bigint, earlier boolean, follows boolean, score double"
LINK_NAMES = [c.split()[0] for c in LINKS.split(", ")]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), *(pa.string(),) * 6, pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))
    for b in batches:
        no, batch, name, operator, muni, country, lat, lon, urls = (c.to_pylist() for c in b.columns)
        fn, fo, fm = names.folded(name), names.folded(operator), names.folded(muni)
        rows = []
        for k in range(b.num_rows):
            p = names.project(fn[k])
            org = p.promoter or (names.organisation(fo[k]) if fo[k] else "")
            place = names.place(fm[k]) if fm[k] else ""
            pages = [names.address(u) for u in urls[k] or [] if u]
            hint = names.slug(pages[0]) if pages and (urls[k] or [None])[0] else ""
            squeezed = place.replace(" ", "")
            if hint in PAGE_WORDS or squeezed and (squeezed in hint or hint in squeezed or names.more_alike(hint, squeezed, 0.6)):
                hint = ""
            a = b_ = None
            if _valid(lat[k]) and _valid(lon[k]) and not (lat[k] == 0 and lon[k] == 0):
                # the two may have been swapped, so their order says nothing
                a, b_ = sorted((int(lat[k] // CELL), int(lon[k] // CELL)))
            words = sorted({names.FULL_NAME.get(w, w) for w in org.split() if len(w) > 3})
            rows.append((no[k], batch[k], (country[k] or "").strip().upper() or None, p.core, p.unit, place, org, hint, a, b_, sorted({u for u in pages if names.is_article(u)}), words))
        cols = list(zip(*rows)) or [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(cols, kinds)], names=["no", "batch", *NAMES, "words"])


def _valid(x: float | None) -> bool:
    return x is not None and x == x and abs(x) <= 180


def read(df: DataFrame, no: str, batch: str, name: str, operator: str, place: str, country: str, lat: str, lon: str, pages) -> DataFrame:
    """Entries reduced to what identity can rest on; ``pages`` is a column with an
    array of addresses, the entry's own first."""
    cols = [F.col(no).cast("bigint").alias("_0"), F.col(batch).cast("bigint").alias("_1")]
    cols += [F.col(c).cast("string").alias(f"_{k}") for k, c in enumerate((name, operator, place, country), 2)]
    cols += [F.col(lat).cast("double").alias("_6"), F.col(lon).cast("double").alias("_7"), pages.alias("_8")]
    got = df.select(*cols).where("_0 is not null").mapInArrow(_read, READ)
    said = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in NAMES[:-1]]
    return got.withColumn("sig", F.xxhash64(*said, F.array_join("pages", " ")))


#: SQL: the distinct 3-grams of a name with its edges.
GRAMS = f"array_distinct(transform(sequence(1, greatest(1, length(core) + 3 - {GRAM})), i -> substring(concat('_', core, '_'), i, {GRAM})))"
#: SQL: an entry without a project's name asks the cells around its own, too.
CELLS = "if(core <> '', array(concat_ws('|', cell_a, cell_b)), flatten(transform(sequence(cell_a - 1, cell_a + 1), x -> transform(sequence(cell_b - 1, cell_b + 1), y -> concat_ws('|', x, y)))))"
#: SQL: where an entry is; without two places or common cells, an address is no evidence.
WHERE = f"concat(if(place <> '', array('p'), array()), if(cell_a is not null, {CELLS}, array()))"
REST = f"""concat(
    if(place <> '', flatten(transform(words, w -> transform(array(substring(place, 1, 3), substring(place, -3, 3)), e -> concat_ws('|', 'o', country, w, e)))), array()),
    flatten(transform(coalesce(pages, array()), p -> transform({WHERE}, w -> concat_ws('|', 'u', country, p, w)))),
    if(length(core) >= {LONG - 1} and size({GRAMS}) <= {SPOILED}, array(concat_ws('|', 'f', country, unit)), array()))"""


def signature_bucket(buckets: int) -> Column:
    return F.expr(f"cast(pmod(crc32(cast(country as binary)) + least(length(core), {LENGTHS}), {buckets}) as int)")


def postings(sigs: DataFrame, order: DataFrame | None, buckets: int) -> DataFrame:
    """(token, kind, named, sig, bucket): the tokens of each signature; order is None
    if no name is long."""
    s = sigs.where("country is not null")
    got = s.selectExpr("core <> '' as named", "sig", f"explode(array_distinct({REST})) as w").selectExpr("xxhash64(w) as token", "substring(w, 1, 1) as kind", "named", "sig")
    if order is not None:
        long = s.where(f"length(core) >= {LONG - 1}").selectExpr("core <> '' as named", "sig", "country", "unit", f"explode({GRAMS}) as gram")
        rare = long.join(order, "gram", "left").groupBy("named", "sig", "country", "unit").agg(F.expr(f"slice(array_sort(collect_set(struct(coalesce(df, 0) as df, xxhash64(gram) as h, gram))), 1, {SPOILED + 1}) as r"))
        got = got.unionByName(rare.selectExpr("named", "sig", "country", "unit", "explode(r.gram) as g").selectExpr("xxhash64('g', country, unit, g) as token", "'g' as kind", "named", "sig"))
    return got.withColumn("bucket", F.expr(f"cast(pmod(token, {buckets}) as int)"))


def _left(codes: np.ndarray, times: int) -> np.ndarray:
    """Hashes of what is left of words of one length (a row of code points each)
    without ``times`` letters, one column for each choice of letters."""
    m, n = codes.shape
    power = np.array([pow(BASE, k, 1 << 64) for k in range(n + 1)], np.uint64)
    sums = np.zeros((m, n + 1), np.uint64)  # of the first k letters
    for k in range(n):
        sums[:, k + 1] = sums[:, k] * power[1] + codes[:, k]
    part = lambda i, j: sums[:, j] - sums[:, i] * power[j - i]  # of letters i to j
    if times == 0:
        return sums[:, n:]
    if times == 1:
        return np.stack([sums[:, i] * power[n - 1 - i] + part(i + 1, n) for i in range(n)], 1)
    return np.stack([sums[:, i] * power[n - 2 - i] + part(i + 1, j) * power[n - 1 - j] + part(j + 1, n) for i in range(n) for j in range(i + 1, n)], 1)


def _met(tokens: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different words that have a token in common, some more than once."""
    by = np.argsort(tokens, kind="stable")
    tokens, of = tokens[by], of[by]
    at, k = np.arange(len(tokens)), 1
    while len(at):
        at = at[at + k < len(tokens)]
        at = at[tokens[at + k] == tokens[at]]
        for p in range(0, len(at), CHUNK):
            x, y = of[at[p : p + CHUNK]], of[at[p : p + CHUNK] + k]
            other = x != y
            yield x[other], y[other]
        k += 1


def _each(i: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each row of i with the rows start on, as many as size."""
    ends, p = np.cumsum(size), 0
    while p < len(i):
        q = max(p + 1, int(np.searchsorted(ends, (ends[p - 1] if p else 0) + CHUNK, "right")))
        n = size[p:q]
        yield np.repeat(i[p:q], n), np.repeat(start[p:q], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = q


def _letters(words: list[str]) -> np.ndarray:
    """Bits of the letters that each word has once, and twice, at least: an edit changes two at most."""
    out = np.zeros((len(words), 2), np.uint64)
    for k, w in enumerate(words):
        once = twice = 0
        for c in w:
            b = 1 << (ord(c) & 63)
            twice |= once & b
            once |= b
        out[k] = once, twice
    return out


def _named_pairs(core: list[str], place: list[str], org: list[str], cells: tuple[np.ndarray, np.ndarray], pages: list, mine: np.ndarray, piece: int, pieces: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (of one country and unit, sorted by core) that verification could
    accept, each once: names with a letter or two left out that are the same, and
    what can be seen at once of the evidence that different names need. Equal names
    are paired for the rows that are ``mine``, others by the tokens of the piece."""
    words, start, word, size = np.unique(np.array(core, dtype=object), return_index=True, return_inverse=True, return_counts=True)
    own = np.flatnonzero(mine)
    yield from _each(own, own + 1, (start + size)[word[own]] - own - 1)

    spots, spot = np.unique(np.array(place, dtype=object), return_inverse=True)
    squeezed = [p.replace(" ", "") for p in spots]
    bits, wide = _letters(squeezed), np.array([len(p) for p in spots])
    # the end of one may be the other
    tails = np.array([hash(p[-4:]) if len(p) >= 4 else k for k, p in enumerate(squeezed)])
    known, worked, (a, b) = wide > 0, np.array([o != "" for o in org]), cells
    paged = np.array([functools.reduce(lambda x, u: x | 1 << (hash(u) & 63), urls or (), 0) for urls in pages], np.uint64)

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        p, q = spot[i], spot[j]
        apart = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=int)
        most = (np.maximum(wide[p], wide[q]) * 0.3 + 1e-6).astype(int)
        return known[p] & known[q] & ((apart <= 2 * most) | (tails[p] == tails[q]))

    def backed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        close = (a[i] != NOWHERE) & (a[j] != NOWHERE) & (abs(a[i] - a[j]) <= 1) & (abs(b[i] - b[j]) <= 1)
        return alike(i, j) | close | (paged[i] & paged[j] != 0) | (worked[i] & worked[j])

    lengths = np.array([len(w) for w in words])
    placed = np.bincount(word, known[spot], len(words)) > 0
    tokens: list[list] = [[], [], []]
    for n in np.unique(lengths[lengths <= LONG]):
        for times in (0, 1, 2) if n >= 6 else (0, 1):
            # two edits only count where the place is known
            of = np.flatnonzero((lengths == n) & (placed | (times < 2)))
            left = _left(np.array([[ord(c) + 1 for c in words[w]] for w in of], np.uint64).reshape(-1, n), times)
            of, left = np.repeat(of, left.shape[1]), left.ravel()
            if pieces > 1:
                here = (left ^ (left >> np.uint64(29))) % np.uint64(pieces) == piece
                left, of = left[here], of[here]
            tokens[times].append((left, of))
    found = [np.zeros(0, int)]
    for times, seem in ((1, backed), (2, alike)):
        got = [x for t in range(times + 1) for x in tokens[t]]
        for x, y in _met(*(np.concatenate(c) for c in zip(*got))) if got else ():
            for k, i in _each(np.arange(len(x)), start[x], size[x]):
                for i_, j in _each(i, start[y[k]], size[y[k]]):
                    ok = seem(i_, j)
                    found.append(np.unique(np.minimum(i_, j)[ok] * len(core) + np.maximum(i_, j)[ok]))
    both = np.unique(np.concatenate(found))
    yield both // len(core), both % len(core)


def _named_links(key: tuple, group: pa.Table) -> pa.Table:
    """Verified pairs of a group (country, unit, piece, pieces) of entries with names of their own."""
    piece, pieces = key[2].as_py(), key[3].as_py()
    group = group.sort_by([("core", "ascending"), ("sig", "ascending")])
    said = {n: group[n].to_pylist() for n in NAMES}
    told, seen, batch = list(zip(*said.values())), group["seen"].to_pylist(), group["batch"].to_pylist()
    cells = tuple(np.array([NOWHERE if c is None else c for c in said[n]]) for n in ("cell_a", "cell_b"))
    # what was taken in before comes first, what has no batch number after all others
    order = {x: k for k, x in enumerate(sorted({x for x in batch if x is not None}))} | {None: len(batch)}
    rank = np.array([-1 if s is not None else order[x] for s, x in zip(seen, batch)])
    sig = group["sig"].to_numpy()
    out = []
    for i, j in _named_pairs(said["core"], said["place"], said["org"], cells, said["pages"], sig % pieces == piece, piece, pieces):
        for x, y in ((i, j), (j, i)):
            ok = (rank[x] >= 0) & (rank[y] <= rank[x])
            for n, o in zip(x[ok].tolist(), y[ok].tolist()):
                score = same_project(told[n], told[o])
                if score > 0:
                    out.append((sig[n], sig[o], seen[o], bool(rank[o] < rank[n]), False, score))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.float64())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds)], names=LINK_NAMES)


def near_cells(a: tuple, b: tuple) -> bool | None:
    if a[0] is None or b[0] is None:
        return None
    return abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1


def same_project(a: tuple, b: tuple) -> float:
    """How sure it is that two descriptions (``NAMES``) of one country mean one
    project; 0: they don't."""
    core_a, unit_a, place_a, org_a, hint_a, *cell_a, pages_a = a[1:]
    core_b, unit_b, place_b, org_b, hint_b, *cell_b, pages_b = b[1:]
    place = names.place_likeness(place_a, place_b) if place_a and place_b else None
    near = near_cells(cell_a, cell_b)
    org = names.same_name(org_a, org_b) if org_a and org_b else None
    if core_a and core_b:
        if unit_a != unit_b:
            return 0.0
        d = names.near(core_a, core_b, 2)
        if d > (2 if min(len(core_a), len(core_b)) >= 6 else 1):
            return 0.0
        shared = bool(d) and bool(set(pages_a or ()) & set(pages_b or ()))
        here = place is not None and place >= 0.7
        far = (place is not None and place < 0.6) or (place is None and near is False)
        if far and not (near and d == 0):
            return 0.0
        if d == 2 and not (here and (near or org or shared or near is None)):
            return 0.0
        if d and not here and not near and not shared and not org:
            return 0.0
        if d and org == 0.0 and not near:
            return 0.0
        return 1.0 - 0.1 * d + (0.05 if near else 0)
    # one entry at least carries its promoter's name
    if place is not None and place < 0.7:
        return 0.0
    named = core_a or hint_a, core_b or hint_b
    alike = names.near(named[0], named[1], 1) <= 1 if all(named) else None
    if alike is False or org == 0.0:
        return 0.0
    if org and place:
        return 0.9 if alike else 0.8 if near else 0.6 if near is None else 0.55
    if org and near:
        return 0.7
    if org is None and alike and (near or place):
        return 0.75
    if org is None and near and set(pages_a or ()) & set(pages_b or ()):
        return 0.6
    return 0.0


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = len(NAMES)
    for b in batches:
        cols = [c.to_pylist() for c in b.columns[4:]]
        got = [same_project(row[:n], row[n:]) for row in zip(*cols)]
        keep = pa.array([s > 0 for s in got], pa.bool_())
        follows = pa.array([not c for c in cols[1]], pa.bool_())
        yield pa.RecordBatch.from_arrays([*(b.column(k).filter(keep) for k in range(4)), follows.filter(keep), pa.array(got, pa.float64()).filter(keep)], names=LINK_NAMES)


def observed(seen: Observation, name: str, none: object, written: DataFrame) -> object:
    """What was observed while a table was written. A result without rows may never be
    observed; ``none`` stands for that, but only where nothing was written."""
    try:
        return seen.get[name]
    except Py4JJavaError:
        if not written.isEmpty():
            raise
        return none


class Index:
    """The index in its folder. ``Index(spark, path)`` opens what is there or makes
    a new one; the number of buckets is fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.path = path or shared_path(spark, "entry-index")
        made = [int(n.split("-")[1]) for n in names_in(spark, self.path) if n.startswith("buckets-")]
        self.buckets = made[0] if made else buckets
        if not made:
            mark(spark, f"{self.path}/buckets-{buckets}")
        marks = [n.split("-") for n in names_in(spark, f"{self.path}/loads")]
        self.loads, self.highest = [m[1] for m in marks], max((int(m[2]) for m in marks), default=None)

    def stored(self, what: str, only: list[int] | None = None, also: str | None = None) -> DataFrame:
        """What the loads taken in, and ``also``, have stored, of some buckets or of all."""
        there = {n.split("=")[1] for n in names_in(self.spark, f"{self.path}/{what}")}
        loads = [x for x in (*self.loads, also) if x in there]
        if not loads or only == []:
            return self.spark.createDataFrame([], STORED[what])
        got = self.spark.read.schema(STORED[what]).parquet(*[f"{self.path}/{what}/load={x}" for x in loads])
        if only is not None and len(only) <= FEW:
            # ten at a time reach the files' dictionaries; parts without any of them are not read
            some = [F.col("bucket").isin(only[k : k + 10]) for k in range(0, len(only), 10)]
            got = got.where(functools.reduce(Column.__or__, some))
        return got.coalesce(self.spark.sparkContext.defaultParallelism)  # many small files, few tasks

    def _append(self, what: str, df: DataFrame, load: str) -> None:
        out = df.repartition("bucket").sortWithinPartitions("bucket") if "bucket" in df.columns else df.coalesce(1)
        out.write.option("parquet.block.size", PART_BYTES).mode("overwrite").parquet(f"{self.path}/{what}/load={load}")

    def _reach(self, kinds: list[str]) -> tuple[list[int], list[int]]:
        """Buckets of signatures that entries of these kinds (country and length) lie
        in, and those that their candidates lie in."""
        own, near = set(), set()
        for country, _, size in (k.rpartition("|") for k in kinds):
            n, at = int(size), zlib.crc32(country.encode())
            own.add((at + n) % self.buckets)
            near |= {(at + m) % self.buckets for m in (range(LENGTHS + 1) if n == 0 else (0, *range(max(1, n - 2), min(LENGTHS, n + 2) + 1)))}
        return sorted(own), sorted(near)

    def add(self, entries: DataFrame) -> None:
        """Take in ``read`` entries of a batch, or of several in the order of their
        numbers: each is held against itself, those before it and what the index has."""
        load, first_load = uuid.uuid4().hex, not self.loads
        told = entries.where("country is not null and (core <> '' or org <> '')")
        kind = F.concat_ws("|", "country", F.least(F.length("core"), F.lit(LENGTHS)))
        # a row per batch, as many kinds as countries and lengths
        about = sorted(told.groupBy("batch").agg(F.min("no").alias("least"), F.max("no").alias("most"), F.collect_set(kind).alias("kinds")).collect(), key=lambda r: (r["batch"] is None, r["batch"]))
        if not about:
            return
        kinds = sorted({k for r in about for k in r["kinds"]})
        long = any(int(k.rpartition("|")[2]) >= LONG - 1 for k in kinds)
        highest, late = self.highest, False
        for r in about:
            late = late or highest is not None and r["least"] <= highest
            highest = r["most"] if highest is None else max(highest, r["most"])
        own, near = self._reach(kinds)
        first = F.min(F.struct(F.isnull("batch"), "batch", "no"))  # of the first batch that has it
        sigs = told.groupBy("sig").agg(first.alias("_f"), F.min("no").alias("least"), *[F.first(c).alias(c) for c in (*NAMES, "words")])
        sigs = sigs.select("sig", "_f.no", "_f.batch", "least", *NAMES, "words").withColumn("bucket", signature_bucket(self.buckets))
        if not first_load:
            known = self.stored("signatures", own).groupBy("sig").agg(F.min("first_no").alias("seen"))
            sigs = sigs.join(known, "sig", "left")
        both = cut(sigs, "new")
        new = both if first_load else both.where("seen is null").drop("seen")
        if first_load and long:
            # the order of rarity is that of the first load; it decides the work, not the result
            self._append("order", new.where(f"length(core) >= {LONG - 1}").selectExpr(f"explode({GRAMS}) as gram").groupBy("gram").agg(F.count("*").cast("int").alias("df")), load)
        seen = Observation()
        self._append("postings", postings(new, self.stored("order", also=load) if long else None, self.buckets).observe(seen, F.collect_set("bucket").alias("buckets")), load)
        mine = self.spark.read.schema(STORED["postings"]).parquet(f"{self.path}/postings/load={load}")
        every = new.select("sig", "no", "batch", *NAMES, F.lit(None).cast("bigint").alias("seen"))
        if not first_load:
            before = self.stored("signatures", near)
            every = every.unionByName(before.select("sig", "no", F.lit(None).cast("bigint").alias("batch"), *NAMES, F.col("first_no").alias("seen")))
        pairs = self._candidates(mine, sorted(observed(seen, "buckets", [], mine)), long)
        links = cut(self._links(pairs, new, every).unionByName(self._named(every)), "links")
        self._label(new, links, load)
        if late:
            # entries that come late with smaller numbers: the first of their projects give way to them
            now = self.spark.read.schema(STORED["signatures"]).parquet(f"{self.path}/signatures/load={load}").groupBy("sig").agg(F.min("first_no").alias("first_no"))
            at = new.select("sig", F.struct(F.isnull("batch"), F.coalesce("batch", F.lit(0))).alias("_b"), "no")
            ahead = links.where("earlier and not follows").join(now.join(at, "sig").select(F.col("sig").alias("new"), "first_no", "_b"), "new")
            ahead = ahead.join(now.select(F.col("sig").alias("old"), F.col("first_no").alias("_o")), "old", "left").withColumn("seen", F.coalesce("seen", "_o")).where("first_no < seen")
            ahead = ahead.join(at.select("_b", F.col("no").alias("first_no")), ["_b", "first_no"], "left_semi").select(F.col("seen").alias("first_no"), F.col("first_no").alias("to_no"))
            again = new.join(now, "sig").where("least < first_no").select("first_no", F.col("least").alias("to_no"))
            if not first_load:
                again = again.unionByName(both.where("least < seen").select(F.col("seen").alias("first_no"), F.col("least").alias("to_no")))
            self._append("moved", again.unionByName(ahead), load)
        self.highest = highest
        mark(self.spark, f"{self.path}/loads/{len(self.loads):08d}-{load}-{self.highest}")
        self.loads.append(load)
        free(both, links)

    def _candidates(self, mine: DataFrame, buckets: list[int], long: bool) -> DataFrame:
        """(new, old): signatures of this load with all others that share a token, one
        without a project's name or both long."""
        every, before = mine.withColumn("fresh", F.lit(True)), None
        if self.loads:
            before = self.stored("postings", buckets).withColumn("fresh", F.lit(False))
            every = every.unionByName(before)
        # tokens of many entries are cut by the signatures stored, and those that ask go to every piece;
        # there are no more of them than postings of this load by PIECE
        large = F.broadcast(mine.groupBy("token").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_k")).where("_k > 1"))

        def met(ask: DataFrame, there: DataFrame) -> DataFrame:
            ask = ask.select("token", F.col("sig").alias("new")).join(large, "token", "left").withColumn("_p", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))).drop("_k")
            there = there.select("token", F.col("sig").alias("old"), "fresh").join(large, "token", "left").withColumn("_p", F.pmod("old", F.coalesce("_k", F.lit(1))).cast("int")).drop("_k")
            return ask.join(there, ["token", "_p"]).where("new <> old").select("new", "old", "fresh")

        found = met(mine.where("not named"), every.where("kind in ('o', 'u')"))
        # those of this load ask back
        found = found.select(F.explode(F.when(F.col("fresh"), F.array(F.struct("new", "old"), F.struct(F.col("old").alias("new"), F.col("new").alias("old")))).otherwise(F.array(F.struct("new", "old")))).alias("_f")).select("_f.*")
        if before is not None:
            found = found.unionByName(met(mine.where("named and kind in ('o', 'u')"), before.where("not named")).drop("fresh"))
        if long:
            found = found.unionByName(met(mine.where("kind in ('f', 'g')"), every.where("kind in ('f', 'g')")).drop("fresh"))
        return found.distinct()

    def _named(self, every: DataFrame) -> DataFrame:
        """Links between entries with names of their own, found within country and unit;
        a large group comes as often as it has pieces, each with its own tokens."""
        named = every.where("core <> ''")
        large = F.broadcast(named.groupBy("country", "unit").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_k")).where("_k > 1"))
        cut_up = named.join(large, ["country", "unit"], "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        return cut_up.groupBy("country", "unit", "_p", "_k").applyInArrow(_named_links, LINKS).select("new", "old", "seen", "earlier", "follows")

    def _links(self, pairs: DataFrame, new: DataFrame, every: DataFrame) -> DataFrame:
        """(new, old, seen, earlier, follows) of verified pairs; seen is the first number
        of a signature accepted before, earlier says if the old one is of a batch before."""
        attributes = lambda df, k, *more: df.select(F.col("sig").alias(k), *more, F.struct(F.isnull("batch"), F.coalesce("batch", F.lit(0))).alias(f"_b_{k}"), *[F.col(n).alias(f"{n}_{k}") for n in NAMES])
        both = pairs.join(attributes(new, "new"), "new").join(attributes(every, "old", "seen"), "old").where("seen is not null or _b_old <= _b_new")
        # lengths apart by more than verification allows
        both = both.where("core_new = '' or core_old = '' or abs(length(core_new) - length(core_old)) <= 2")
        shown = both.select("new", "old", "seen", F.expr("seen is not null or _b_old < _b_new").alias("earlier"), *[f"{n}_new" for n in NAMES], *[f"{n}_old" for n in NAMES])
        held = shown.mapInArrow(_verified, LINKS)
        # an entry without a project's name follows the one it fits best, and joins no others
        return held.withColumn("top", F.max("score").over(W.partitionBy("new"))).where("not follows or score = top").select("new", "old", "seen", "earlier", "follows")

    def _label(self, new: DataFrame, links: DataFrame, load: str) -> None:
        """Store the signatures with ``first_no``, the smallest number that each leads to."""
        inner = links.where("seen is null").select("new", "old")
        before = links.where("seen is not null").groupBy("new").agg(F.min("seen").alias("seen")).withColumnRenamed("new", "sig")

        def step(now: DataFrame) -> DataFrame:
            got = inner.join(now.select(F.col("sig").alias("old"), F.col("first_no").alias("_n")), "old").groupBy("new").agg(F.min("_n").alias("_n")).withColumnRenamed("new", "sig")
            return now.join(got, "sig", "left").select("sig", F.least("first_no", F.coalesce("_n", "first_no")).alias("first_no"), F.col("first_no").alias("_last"))

        def twice(now: DataFrame) -> tuple[DataFrame, Observation]:
            seen = Observation()
            return step(step(now).drop("_last")).observe(seen, F.count_if(F.col("first_no") < F.col("_last")).alias("moved")), seen

        after, seen = twice(new.select("sig", "no").join(before, "sig", "left").select("sig", F.least("no", F.coalesce("seen", "no")).alias("first_no")))
        labels = cut(after, "labels")
        while observed(seen, "moved", 0, labels):  # until no number moves
            after, seen = twice(labels)
            now = cut(after, "labels")
            free(labels)
            labels = now
        self._append("signatures", new.drop("words", "batch", "least").join(labels.select("sig", "first_no"), "sig"), load)
        free(labels)

    def first_numbers(self) -> DataFrame:
        """(sig, first_no) of all signatures taken in."""
        got = self.stored("signatures").select("sig", "first_no")
        if not names_in(self.spark, f"{self.path}/moved"):
            return got
        moved = self.stored("moved").groupBy("first_no").agg(F.min("to_no").alias("to_no"))
        while True:  # a number may have given way several times
            seen = Observation()
            now = got.join(moved, "first_no", "left").select("sig", F.least("first_no", F.coalesce("to_no", "first_no")).alias("first_no"), (F.col("to_no") < F.col("first_no")).alias("_gone"))
            got = cut(now.observe(seen, F.count_if("_gone").alias("gone")), "first").select("sig", "first_no")
            if not observed(seen, "gone", 0, got):
                return got


def duplicates(entries: DataFrame, index: Index | None = None) -> DataFrame:
    """(first_no, dup_no) of ``read`` entries that come in numbered batches: each
    batch is checked against those before it and the index, and taken in; all that
    are there are taken in at once, so none goes through the batches before it again."""
    stored = cut(entries, "entries")
    index = index or Index(entries.sparkSession)
    index.add(stored)
    return stored.select("no", "sig").join(index.first_numbers(), "sig").where("first_no < no").select("first_no", F.col("no").alias("dup_no"))
