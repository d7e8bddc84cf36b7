"""Evaluation passages inside a corpus, found with spaced seeds.

Words of items and documents are brought to one form and become numbers. Fixed
masks select some of the next few words and ignore the others; the selected words
are hashed at every position of items and documents, and the two sides are joined
on the hash. Around each hit the passage is verified: a run of equal words along
the hit's diagonal, or the whole item within a number of words replaced, left out
or added.

The masks miss nothing: an item of n words with e words altered keeps a run of
at least (n - e) / (e + 1) words, and each item has a solid mask of at most that
length beside the spaced ones.

The documents are read once for their seeds, however many items there are: a
sieve of the items' hashes, whose size is bounded by ``SIEVE_BITS``, goes to the
tasks and keeps back the seeds that no item has, and the others meet the items in
a shuffled join. Documents with a hit, found by a sieve of their numbers, are read
once more, and only the windows around their hits are sent to be verified, each
with its own item.

Edge cases: null and empty texts match nothing; items without words match
nothing; repeated documents and items are each reported; long documents are read
whole.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.plain_text import key_array
from lodestrata.runtime import cut

RUN_WORDS = 12
WORDS_PER_EDIT = 8
#: The largest sieve, in bits (128 MB), and how many bits there are for a hash.
SIEVE_BITS, BITS_EACH, BLOCK_BITS = 1 << 30, 24, 1 << 19
#: Masks; 1 selects the word, 0 ignores it.
MASKS = ("11111", "111011", "1101011", "11100111")
_TAG = re.compile(r"</?(\w+)[^<>]*>")
_INLINE = {"b", "i", "em", "strong", "a", "span", "u", "sup", "sub", "mark", "font", "small"}
_JOIN = re.compile(r"[-­‐‑]\s*\n\s*")
_WORD = re.compile(r"[^\W_]+")
_DASH = re.compile(r"[–—―]+")


def visible(text: str) -> str:
    """The text without mark-up and line-end hyphens."""
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m.group(1).lower() in _INLINE else " ", text)
    if "&" in text:
        text = html.unescape(text)
    return _DASH.sub(" ", _JOIN.sub("", text))


def words_of(texts: list[str | None]) -> list[list[str]]:
    """Words of each text as a reader sees them."""
    folded = key_array(pa.array([visible(t) if t else "" for t in texts], pa.string())).to_pylist()
    return [_WORD.findall(t.replace("'", "").replace("-", "").replace("·", "")) for t in folded]


def allowed_edits(n: int) -> int:
    return n // WORDS_PER_EDIT


_NUMBER: dict[str, int] = {}


def numbers_of(texts: list[str | None]) -> list[np.ndarray]:
    """The words of each text as numbers that are the same everywhere."""
    if len(_NUMBER) > 1_000_000:
        _NUMBER.clear()
    out = []
    for words in words_of(texts):
        for w in words:
            if w not in _NUMBER:
                _NUMBER[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out.append(np.array([_NUMBER[w] for w in words], np.uint64))
    return out


_FACTORS = np.random.default_rng(20).integers(1, 2**63 - 1, 32).astype(np.uint64) | np.uint64(1)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the selected words at each position; masks never share hashes."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, int(mask, 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                h = (h + words[k : k + n]) * _FACTORS[k]
                h ^= h >> np.uint64(31)
    return h


def solid_length(n: int) -> int:
    """Words in the unaltered run that an item of n words is sure to keep."""
    e = allowed_edits(n)
    return min(RUN_WORDS, max(1, math.ceil((n - e) / (e + 1))))


ITEM = "item_id bigint, size int, solid int, words binary"
SEED = "hash bigint, item_id bigint, at int, size int"
HIT = "hash bigint, doc_id bigint, at int"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = numbers_of(b.column(1).to_pylist())
        keep = [k for k, w in enumerate(words) if len(w)]
        size = [len(words[k]) for k in keep]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(size, pa.int32()), pa.array([solid_length(n) for n in size], pa.int32()), pa.array([words[k].tobytes() for k in keep], pa.binary())], names=["item_id", "size", "solid", "words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, size, solid, raw in zip(*(c.to_pylist() for c in b.columns)):
            words = np.frombuffer(raw, np.uint64)
            own = [seeds(words, m) for m in (*MASKS, *(["1" * solid] if solid < len(MASKS[0]) else []))]
            h = np.concatenate(own)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item, np.int64)), pa.array(np.concatenate([np.arange(len(x), dtype=np.int32) for x in own])), pa.array(np.full(len(h), size, np.int32))], names=["hash", "item_id", "at", "size"])


# Sieves


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    with np.errstate(over="ignore"):
        m = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (m >> np.uint64(34)) % np.uint64(bits), m % np.uint64(bits)


def sieve(keys: DataFrame, col: str) -> np.ndarray:
    """Bits set for the values of a column, of as many rows as may be: bounded by
    ``SIEVE_BITS`` and put together by tasks, block by block."""
    n = keys.count()
    bits = BLOCK_BITS
    while bits < min(SIEVE_BITS, n * BITS_EACH):
        bits *= 2

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(np.concatenate(_places(np.asarray(b.column(0)), bits)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(p // BLOCK_BITS), pa.array(p % BLOCK_BITS)], names=["block", "bit"])

    def joined(t: pa.Table) -> pa.Table:
        own = np.zeros(BLOCK_BITS, np.uint8)
        own[t.column("bit").to_numpy()] = 1
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    # equal values count once, so that a block has about as many rows as bits at most
    got = keys.select(F.col(col).cast("bigint")).distinct().mapInArrow(blocks, "block bigint, bit bigint").groupBy("block").applyInArrow(joined, "block bigint, bits binary")
    for r in got.collect():
        at = r["block"] * BLOCK_BITS // 8
        out[at : at + BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_sieve(h: np.ndarray, held: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for p in _places(h, len(held) * 8):
        ok &= (held[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return ok


def _doc_seeds(docs: DataFrame, held: np.ndarray, masks: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(held)  # SIEVE_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                ids = np.asarray(b.column(0))
                words = numbers_of(b.column(1).to_pylist())
                size = np.array([len(w) for w in words], np.int64)
                flat = np.concatenate(words) if len(words) else np.zeros(0, np.uint64)
                start = np.concatenate(([0], np.cumsum(size)))[:-1]
                doc = np.repeat(np.arange(len(size)), size)
                left = np.repeat(start + size, size) - np.arange(len(flat))  # words from here to the text's end
                h, d, at = [], [], []
                for m in masks:
                    own = seeds(flat, m)
                    keep = np.nonzero((left[: len(own)] >= len(m)) & in_sieve(own, sent.value))[0]
                    h.append(own[keep])
                    d.append(doc[keep])
                    at.append(keep - start[doc[keep]])
                d = np.concatenate(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(ids[d]), pa.array(np.concatenate(at).astype(np.int32))], names=["hash", "doc_id", "at"])

    return docs.mapInArrow(run, HIT)


WINDOW = "doc_id bigint, item_id bigint, starts array<int>, window binary"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document and item, the words around hits that lie close together."""
    for b in batches:
        ids, lists = b.column(0).to_pylist(), numbers_of(b.column(1).to_pylist())
        cols: list[list] = [[], [], [], []]
        for doc, words, hits in zip(ids, lists, b.column(2).to_pylist()):
            for hit in hits:
                n, starts = hit["size"], np.unique(np.array(hit["starts"], np.int64))
                room = 2 * allowed_edits(n) + 1
                for part in np.split(starts, np.nonzero(np.diff(starts) > n + 2 * room)[0] + 1):
                    lo, hi = max(0, int(part[0]) - room), min(len(words), int(part[-1]) + n + room)
                    for c, v in zip(cols, (doc, hit["item_id"], (part - lo).tolist(), words[lo:hi].tobytes())):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()))], names=["doc_id", "item_id", "starts", "window"])


def least_edits(item: np.ndarray, words: np.ndarray) -> int:
    """Fewest words replaced, left out or added that make the item a passage of ``words``."""
    row = np.zeros(len(words) + 1, np.int32)
    steps = np.arange(len(words) + 1)
    for w in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def _ragged(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in it) of the elements of rows of these sizes, laid end to end."""
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - first[row]


def longest_runs(same: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Longest run of true in each of n rows that are laid end to end."""
    at = np.arange(len(same))
    new = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    since = np.maximum.accumulate(np.where(~same, at, np.where(new, at - 1, -1))) if len(row) else at
    out = np.zeros(n, np.int64)
    np.maximum.at(out, row, np.where(same, at - since, 0))
    return out


#: Words that are laid against each other at once.
AT_ONCE = 1 << 20


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, item = np.asarray(b.column(0)), np.asarray(b.column(1))
        starts, windows, items = b.column(2).to_pylist(), [np.frombuffer(x, np.uint64) for x in b.column(3).to_pylist()], [np.frombuffer(x, np.uint64) for x in b.column(4).to_pylist()]
        work = np.cumsum([len(s) * len(i) + len(w) for s, i, w in zip(starts, items, windows)])
        cuts = [0, *(np.nonzero(np.diff(work // AT_ONCE))[0] + 1).tolist(), len(starts)] if len(starts) else [0]
        for lo, hi in zip(cuts, cuts[1:]):
            w, own = windows[lo:hi], items[lo:hi]
            w_size, i_size = np.array([len(x) for x in w]), np.array([len(x) for x in own])
            flat_w, flat_i = np.concatenate(w), np.concatenate(own)
            w_row, _ = _ragged(w_size)
            i_row, _ = _ragged(i_size)
            # runs along the diagonals of the hits
            pair, _ = _ragged(np.array([len(s) for s in starts[lo:hi]]))
            at = np.concatenate([np.array(s, np.int64) for s in starts[lo:hi]])
            run = np.zeros(hi - lo, np.int64)
            for some in np.array_split(np.arange(len(pair)), max(1, int(i_size[pair].sum()) // AT_ONCE)):
                hit, k = _ragged(i_size[pair[some]])
                p, place = pair[some][hit], at[some][hit] + k
                inside = (place >= 0) & (place < w_size[p])
                got = flat_w[(np.cumsum(w_size) - w_size)[p] + np.where(inside, place, 0)]
                np.maximum.at(run, pair[some], longest_runs(inside & (got == flat_i[(np.cumsum(i_size) - i_size)[p] + k]), hit, len(some)))
            # only an item nearly all of whose words are there can be whole
            with np.errstate(over="ignore"):
                mixed = lambda x, r: (x + r.astype(np.uint64) * _FACTORS[0]) * _FACTORS[1]
                there = np.bincount(i_row, np.isin(mixed(flat_i, i_row), mixed(flat_w, w_row)), hi - lo)
            edits = np.full(hi - lo, -1, np.int64)
            for k in np.nonzero(there >= i_size - i_size // WORDS_PER_EDIT)[0]:
                n = least_edits(own[k], w[k])
                edits[k] = n if n <= allowed_edits(len(own[k])) else -1
            keep = (run >= RUN_WORDS) | (edits >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi][keep]), pa.array(item[lo:hi][keep]), pa.array(run[keep].astype(np.int32)), pa.array(edits[keep].astype(np.int32))], names=["doc_id", "item_id", "run", "edits"])


SCHEMA = "doc_id bigint, item_id bigint, run int, edits int"


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_id, item_id, run, edits) of every document that holds a passage of an item:
    the longest run of equal words, and the edits of the whole item or -1."""
    d = docs.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col(doc_text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    it = items.select(F.col(item_key).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null")
    own = cut(it.mapInArrow(_items, ITEM), "items")
    probe = cut(own.mapInArrow(_item_seeds, SEED), "item-seeds")
    # at most as many lengths as the shortest mask has words
    solid = sorted(r["solid"] for r in own.select("solid").where(F.col("solid") < len(MASKS[0])).distinct().collect())
    found = _doc_seeds(d, sieve(probe, "hash"), [*MASKS, *("1" * n for n in solid)])
    hits = found.join(probe.withColumnRenamed("at", "_at"), "hash").groupBy("doc_id", "item_id", "size").agg(F.collect_set(F.col("at") - F.col("_at")).alias("starts"))
    hits = cut(hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "size", "starts")).alias("hits")), "hits")
    held = d.sparkSession.sparkContext.broadcast(sieve(hits.select("doc_id"), "doc_id"))  # SIEVE_BITS at most

    def with_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_sieve(np.asarray(b.column(0)).view(np.uint64), held.value)))

    around = d.mapInArrow(with_hits, "doc_id bigint, text string").join(hits, "doc_id").select("doc_id", "text", "hits").mapInArrow(_windows, WINDOW)
    pairs = around.join(own.select("item_id", "words"), "item_id").select("doc_id", "item_id", "starts", "window", "words")
    return pairs.mapInArrow(_verified, SCHEMA).groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.coalesce(F.min(F.when(F.col("edits") >= 0, F.col("edits"))), F.lit(-1)).alias("edits"))
