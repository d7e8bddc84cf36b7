"""Language of documents and of their sentences, by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A sentence is
cut greedily into the longest phrases that occur in that text; the language that
needs the fewest phrases for the sentence's length describes it best. The
automata are tables, so all sentences of a batch are parsed in step, in all
languages at once.

The labelled text is a sample of bounded size: ``SAMPLE_DOCS`` documents, of each
at most ``SAMPLE_CHARS`` characters, and ``TRAIN_CHARS`` characters per language. Labels may be wrong
and documents mixed, so before the automata are built the sample's sentences are
sorted by word frequencies over the whole sample, and those that don't belong
are left out. What is labelled then is every document, whole.

A text without any whole sentence, such as one of headings, is one segment with all
its lines, and its number of sentences is 0.

Edge cases: a null or empty text, or one without words, has no language and gives
no row; mark-up, addresses, case and accents make no difference; very long texts
are read whole; if no usable label is there at all, there is nothing to learn
from and the result is empty. Ties between languages go to the first in order.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.plain_text import key_array

LANGUAGES = ("de", "en", "es", "fr", "it", "nl")
SAMPLE_DOCS, SAMPLE_CHARS, TRAIN_CHARS = 500, 20_000, 60_000
MIN_WORDS = 5
#: A sentence is of another language than most of the text only if its best parse
#: needs at most this share of the phrases that the main language needs.
CLEARLY = 0.85

# Usual notations of the languages, besides the two-letter codes and their regions.
NOTATIONS = {
    "en": "eng english anglais englisch inglés ingles inglese engels",
    "fr": "fra fre french français francais französisch franzoesisch francés francese frans",
    "de": "deu ger german deutsch allemand alemán aleman tedesco duits",
    "es": "spa spanish español espanol castilian castellano espagnol spanisch spagnolo spaans",
    "it": "ita italian italiano italien italienisch italiaans",
    "nl": "nld dut dutch nederlands néerlandais neerlandais niederländisch niederlaendisch flemish vlaams olandese holandés",
}
ALPHABET = "abcdefghijklmnopqrstuvwxyz '"
_CODE = np.full(128, len(ALPHABET), np.uint8)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i
_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)[^<>]*>")
_NOISE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+")
_QUOTED = re.compile(r"[«“„\"]\s*([^«»“”„\"]*?)\s*[»”\"]|\(\s*([^()]*?)\s*\)")
_BREAK = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\n+")
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_END = re.compile(r"[.!?…]\s*[\"'»”’)\]]*\s*$")


def language_of_label(label: Column) -> Column:
    """The two-letter code that a label means, or null if it names none of ours."""
    word = F.lower(F.trim(label))
    head = F.regexp_extract(word, r"^([a-z]{2,3})(?:[-_ ][a-z0-9-]+)?$", 1)
    names = {n: code for code, words in NOTATIONS.items() for n in words.split()} | {code: code for code in LANGUAGES}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.get(F.array(table[word]), F.lit(0)), table[head])


def _unquoted(m: re.Match) -> str:
    """A quotation or bracket that is a sentence stands for itself; a mere phrase is left out."""
    inner = m.group(1) or m.group(2) or ""
    return f"\n{inner}\n" if _END.search(inner) and len(_WORDS.findall(inner)) >= MIN_WORDS and inner[:1].isupper() else " "


def sentences(text: str) -> list[str]:
    """The whole sentences of a text: with an end sign and at least MIN_WORDS words."""
    text = _TAG.sub(lambda m: " " if m.group(2).lower() in ("b", "i", "em", "strong", "a", "span", "u", "sup", "sub") else "\n", text)
    text = _QUOTED.sub(_unquoted, _NOISE.sub(" ", text))
    out = []
    for part in _BREAK.split(text):
        if part and _END.search(part) and len(_WORDS.findall(part)) >= MIN_WORDS:
            out.append(part)
    return out


def pieces(text: str) -> list[str]:
    """What a text without whole sentences consists of: its lines that hold words."""
    return [p for p in _TAG.sub("\n", _NOISE.sub(" ", text)).split("\n") if _WORDS.search(p)]


_LETTERS = re.compile(r"[^a-z']+")


def reduced(parts: list[str]) -> list[str]:
    """Sentences in comparison form, letters only, single blanks."""
    return [_LETTERS.sub(" ", s or "").strip() for s in key_array(pa.array(parts, pa.string())).to_pylist()]


# Suffix automaton


def suffix_automaton(text: str) -> np.ndarray:
    """Transitions [state, letter] of the automaton of all substrings; -1: none."""
    n = len(ALPHABET)
    nxt: list[list[int]] = [[-1] * n]
    link, length, last = [-1], [0], 0
    for c in _CODE[np.frombuffer(text.encode(), np.uint8)].tolist():
        if c >= n:
            last = 0
            continue
        if nxt[last][c] >= 0 and length[nxt[last][c]] == length[last] + 1:
            last = nxt[last][c]
            continue
        cur = len(nxt)
        nxt.append([-1] * n)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and nxt[p][c] < 0:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p][c] == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return np.array(nxt, np.int32)


def automata(texts: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """(all transitions flat, with a column that never matches; root of each language)."""
    roots, parts, at = [], [], 0
    for lang in LANGUAGES:
        t = suffix_automaton(texts.get(lang, ""))
        t = np.where(t >= 0, t + at, -1)
        parts.append(np.column_stack((t, np.full(len(t), -1))).astype(np.int32))
        roots.append(at)
        at += len(t)
    return np.vstack(parts).ravel(), np.array(roots, np.int32)


def phrase_counts(parts: list[str], flat: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """[sentence, language]: phrases that the greedy parse needs."""
    width, n = len(ALPHABET) + 1, len(parts)
    lens = np.array([len(p) for p in parts])
    order = np.argsort(-lens, kind="stable")
    counts = np.ones((n, len(roots)), np.int32)
    step = 4096
    for lo in range(0, n, step):
        rows = order[lo : lo + step]
        size = lens[rows]
        longest = int(size.max()) if len(size) else 0
        chars = np.full((longest, len(rows)), len(ALPHABET), np.uint8)
        for k, r in enumerate(rows):
            chars[: lens[r], k] = _CODE[np.frombuffer(parts[r].encode("ascii", "replace"), np.uint8)]
        state = np.tile(roots, (len(rows), 1)).astype(np.int64)
        got = np.ones((len(rows), len(roots)), np.int32)
        for t in range(longest):
            live = int(np.searchsorted(-size, -t, "left"))  # sizes descend
            c = chars[t, :live, None].astype(np.int64)
            new = flat[state[:live] * width + c]
            miss = new < 0
            if miss.any():
                again = flat[np.broadcast_to(roots, new.shape).astype(np.int64) * width + c]
                lone = miss & (again < 0)  # a letter that the language never uses is a phrase of its own
                got[:live] += miss.astype(np.int32) + (lone & (state[:live] != roots))
                new = np.where(miss, np.where(again < 0, roots, again), new)
            state[:live] = new
        counts[rows] = got
    return counts


# Learning


def cleaned(sample: list[tuple[str, str]]) -> dict[str, str]:
    """Training text per language, from (label, text) of the sample.

    Word frequencies of all sentences tell which sentences belong to another
    language than their label says; the frequencies are taken twice.
    """
    rows: dict[str, str] = {}
    found = [(s, label) for label, text in sample for s in sentences(text)]
    for s, (_, label) in zip(reduced([s for s, _ in found]), found):
        rows.setdefault(s, label)
    if not rows:
        return {}
    texts = list(rows)
    label = np.array([LANGUAGES.index(rows[t]) for t in texts])
    ids: dict[str, int] = {}
    words = [[ids.setdefault(w, len(ids)) for w in t.split()] or [ids.setdefault("", len(ids))] for t in texts]
    flat = np.fromiter((w for own in words for w in own), np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(own) for own in words])
    starts = np.nonzero(np.diff(owner, prepend=-1))[0]
    guess = label
    for _ in range(3):
        n = np.bincount(flat * len(LANGUAGES) + guess[owner], minlength=len(ids) * len(LANGUAGES)).reshape(len(ids), -1).astype(float)
        odds = np.log(n + 0.1) - np.log(n.sum(0) + 0.1 * len(ids))
        total = np.add.reduceat(odds[flat], starts, axis=0)
        total[:, n.sum(0) == 0] = -np.inf
        guess = total.argmax(1)
    kept = [(t, LANGUAGES[i]) for t, i in zip(texts, label)]
    belongs = guess == label
    out: dict[str, str] = {}
    size: Counter = Counter()
    parts: dict[str, list[str]] = defaultdict(list)
    for (s, lang), own in zip(kept, belongs):
        if own and size[lang] < TRAIN_CHARS:
            parts[lang].append(s)
            size[lang] += len(s) + 1
    for lang, p in parts.items():
        out[lang] = "|".join(p)
    return out


def labelled_sample(docs: DataFrame, label: str, text: str, sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """About ``sample_docs`` documents of each labelled language, to the driver."""
    rows = docs.select(language_of_label(F.col(label)).alias("lang"), F.col(text).alias("text"))
    n = {r["lang"]: r["n"] for r in rows.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, sample_docs / v) for k, v in n.items()}
    if not share:
        return []
    got = rows.where("lang is not null and text is not null").sampleBy("lang", share, seed=11).withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    return [(r["lang"], r["text"]) for r in got.collect()]


SCHEMA = "doc_id bigint, label string, lang string, main string, n_langs int, n_sentences int, chars bigint, confidence double"
_TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64())


def segment_languages(docs: DataFrame, key: str, label: str, text: str, training: dict[str, str]) -> DataFrame:
    """(doc_id, label, lang, main, n_langs, n_sentences, chars, confidence): the
    languages in which each document holds whole sentences, beside the code that
    its label means, the language of most of the text and the number of languages. Confidence is 1 - phrases of the best
    language / phrases of the next, weighted by length."""
    flat, roots = automata(training)
    sent = docs.sparkSession.sparkContext.broadcast((flat, roots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, roots = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                parts: list[str] = []
                owner: list[int] = []
                whole_ones: list[bool] = []
                for i, t in enumerate(b.column(2).to_pylist()):
                    if t:
                        own = sentences(t)
                        whole_ones += [bool(own)] * (len(own) or 1)
                        own = own or ["\n".join(pieces(t))]
                        parts += own
                        owner += [i] * len(own)
                cols: list[list] = [[] for _ in _TYPES]
                if parts:
                    once: dict[str, int] = {}
                    which = np.array([once.setdefault(p, len(once)) for p in parts])
                    short = reduced(list(once))
                    counts = phrase_counts(short, flat, roots).astype(float)
                    counts[np.array([len(s) for s in short]) == 0] = 1e9
                    _vote(b.column(0).to_pylist(), b.column(1).to_pylist(), np.array(owner), counts[which], np.array([len(s) for s in short])[which], np.array(whole_ones), cols)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=["doc_id", "label", "lang", "main", "n_langs", "n_sentences", "chars", "confidence"])

    return docs.select(F.col(key).cast("bigint").alias("_k"), language_of_label(F.col(label)), F.col(text).cast("string")).where("_k is not null").mapInArrow(run, SCHEMA)


def _vote(ids: list[int], labels: list[str | None], owner: np.ndarray, counts: np.ndarray, chars: np.ndarray, whole: np.ndarray, cols: list[list]) -> None:
    best = counts.argmin(1)
    two = np.sort(counts, 1)[:, :2]
    sure = 1 - two[:, 0] / two[:, 1]
    starts = np.nonzero(np.diff(owner, prepend=-1))[0]
    for lo, hi in zip(starts, [*starts[1:], len(owner)]):
        if counts[lo:hi].max() >= 1e9 and (counts[lo:hi].max(1) >= 1e9).all():
            continue
        size = np.bincount(best[lo:hi], chars[lo:hi], len(LANGUAGES))
        main = int(size.argmax())
        own = np.where(counts[lo:hi].min(1) <= CLEARLY * counts[lo:hi, main], best[lo:hi], main)
        langs = np.unique(own)
        for k in langs:
            m = own == k
            w = chars[lo:hi][m]
            for c, v in zip(cols, (ids[owner[lo]], labels[owner[lo]], LANGUAGES[k], LANGUAGES[main], len(langs), int(whole[lo:hi][m].sum()), int(w.sum()), float(np.average(sure[lo:hi][m], weights=np.maximum(w, 1))))):
                c.append(v)
