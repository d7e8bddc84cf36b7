"""One consistent form for text that looks the same but is written differently.

A column of Arrow text becomes one array of code points with a row number for
each; everything then happens on whole arrays:

1. lookup-table gathers replace styled, joined and full-width signs by the plain
   ones, blanks by the plain blank, and drop invisible characters; the lengths
   of the replacements give the offsets at which they are written;
2. letters are counted by script for every word, and a letter that imitates one
   of its word's own script is replaced;
3. marks are put in canonical order and composed with their letters, the k-th
   mark of all letters at once.

No string function is called per row. The tables are built from the Unicode data
of the interpreter by rule; only look-alike letters are listed.

``plain`` gives the plain form; ``key`` goes on to a form for comparison, without
case, accents and typographic variants.

Edge cases: null stays null and empty text stays empty; texts of any length are
taken whole; a text that is plain already comes back unchanged, byte by byte.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that the tables cover; those above are left alone, but for tags and selectors.
TOP = 0x30000
CONTROLS_AS_BLANK = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029)
INVISIBLE = (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)
#: Signs of typography that are plain as they are.
KEPT = (0x2011, 0x2024, 0x2025, 0x2026, 0x2033, 0x2034, 0x2036, 0x2037, 0x203C)
HANGUL_S, HANGUL_L, HANGUL_V, HANGUL_T = 0xAC00, 0x1100, 0x1161, 0x11A7
LATIN, CYRILLIC, GREEK = 1, 2, 3

# Letters that look like a Latin letter, in the order of their twins.
CYRILLIC_TWINS = ("АВЕЅІЈКМНОРСТУХаеіјосрѕухһԁԛԝӏ", "ABESIJKMHOPCTYXaeijocpsyxhdqwl")
GREEK_TWINS = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο", "ABEZHIKMNOPTYXvo")
#: Letters of other alphabets, and phonetic ones, that are never plain in Latin text.
OTHER_TWINS = ("ɑɡɩıȷʏօոսհցքѡⲟⲣⲥᴏᴄᴠᴡᴢꜱ", "agiijyonuhgqwopcocvwzs")
#: Letters that look like a Latin letter only beside Latin ones; alone they are good Greek.
SIMILAR_TWINS = ("αγηικρτυχω", "aynikptuxw")
CHEROKEE_TWINS = ("ᎪᏴᏟᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCEGHJKLMPSTVWZ")
DIGIT_TWINS = ("OoОоΟοIlІΙӏ", "00000011111")


@dataclass(frozen=True)
class Tables:
    length: np.ndarray  # of the replacement of each code point
    start: np.ndarray
    data: np.ndarray
    ccc: np.ndarray
    pair: np.ndarray  # letter << 21 | mark, sorted
    whole: np.ndarray
    joins: np.ndarray  # no mark by its class, but joined to the letter before it
    script: np.ndarray
    wordy: np.ndarray  # letter, digit or mark
    digit: np.ndarray
    to_latin: np.ndarray
    to_cyrillic: np.ndarray
    to_greek: np.ndarray
    to_digit: np.ndarray
    similar: np.ndarray  # looks like a Latin letter only beside Latin ones
    key_length: np.ndarray
    key_start: np.ndarray
    key_data: np.ndarray
    kind: np.ndarray  # 1: may have to be replaced, 2: digit, 4: letter, 8: control that stands for a blank


def _replacement(c: int) -> str | None:
    """What stands for a code point, or None for itself."""
    ch = chr(c)
    cat = unicodedata.category(ch)
    if c in CONTROLS_AS_BLANK or (cat == "Zs" and c != 0x20):
        return " "
    if cat in ("Cf", "Cc") or c in INVISIBLE or 0xFE00 <= c <= 0xFE0F:
        return ""
    if c in KEPT or HANGUL_S <= c < HANGUL_S + 11172:
        return None
    d = unicodedata.normalize("NFKD", ch)
    if d[:1] == " " and len(d) > 1:  # an accent that stands alone
        d = unicodedata.normalize("NFC", ch)
    return None if d == ch else d


def _key_replacement(c: int) -> str | None:
    ch = chr(c)
    if c in CONTROLS_AS_BLANK:
        return " "
    if c in KEY_LETTERS:
        return KEY_LETTERS[c]
    cat = unicodedata.category(ch)
    if cat in ("Pd",) or ch in "−":
        return "-" if c != 0x2D else None
    if ch in "‘’‚‛ʼ′`´":
        return "'"
    if ch in "“”„‟«»″":
        return '"'
    d = unicodedata.normalize("NFD", ch) if not HANGUL_S <= c < HANGUL_S + 11172 else ch
    d = "".join(x for x in d.casefold() if unicodedata.category(x) != "Mn")
    return None if d == ch else "".join(KEY_LETTERS.get(ord(x), x) for x in d)


#: Letters that are written with others where accents are lost.
KEY_LETTERS = {0x153: "oe", 0x152: "oe", 0xE6: "ae", 0xC6: "ae", 0xDF: "ss", 0x1E9E: "ss", 0x142: "l", 0x141: "l", 0xF8: "o", 0xD8: "o", 0x111: "d", 0x110: "d", 0xF0: "d", 0xD0: "d", 0xFE: "th", 0xDE: "th"}


def _packed(replace) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length, start, data = np.ones(TOP, np.int8), np.arange(TOP, dtype=np.int32), [np.arange(TOP, dtype=np.int32)]
    at = TOP
    for c in range(TOP):
        r = replace(c) if not 0xD800 <= c < 0xE000 else None
        if r is not None:
            length[c], start[c] = len(r), at
            data.append(np.array([ord(x) for x in r], np.int32))
            at += len(r)
    return length, start, np.concatenate(data)


@functools.cache
def tables() -> Tables:
    length, start, data = _packed(_replacement)
    key_length, key_start, key_data = _packed(_key_replacement)
    ccc, script, pairs = np.zeros(TOP, np.int16), np.zeros(TOP, np.int8), []
    wordy, digit = np.zeros(TOP, bool), np.zeros(TOP, bool)
    for c in range(TOP):
        ch = chr(c)
        cat = unicodedata.category(ch)
        ccc[c] = unicodedata.combining(ch)
        wordy[c] = cat[0] in "LNM"
        digit[c] = cat == "Nd"
        if cat[0] == "L":
            name = unicodedata.name(ch, "")
            script[c] = LATIN if name.startswith("LATIN") or 0x250 <= c < 0x2B0 else CYRILLIC if name.startswith("CYRILLIC") else GREEK if name.startswith("GREEK") else 0
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and len(p := d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            pairs.append((int(p[0], 16) << 21 | int(p[1], 16), c))
    pairs.sort()
    same = np.arange(TOP, dtype=np.int32)
    to_latin, to_cyrillic, to_greek, to_digit = same.copy(), same.copy(), same.copy(), same.copy()
    every = (SIMILAR_TWINS, CYRILLIC_TWINS, GREEK_TWINS, OTHER_TWINS, CHEROKEE_TWINS)
    for twins, latin in every:
        for a, b in zip(twins, latin):
            to_latin[ord(a)] = ord(b)
    for (twins, latin), to in ((CYRILLIC_TWINS, to_cyrillic), (SIMILAR_TWINS, to_greek), (GREEK_TWINS, to_greek)):
        for a, b in zip(twins, latin):
            to[ord(b)] = ord(a)
    for (twins, _), to in ((CYRILLIC_TWINS, to_cyrillic), ((GREEK_TWINS[0] + SIMILAR_TWINS[0], ""), to_greek)):
        for other, looks in every:
            for a, b in zip(other, looks):
                if a not in twins and to[ord(b)] != ord(b):
                    to[ord(a)] = to[ord(b)]
    for a, b in zip(*DIGIT_TWINS):
        to_digit[ord(a)] = ord(b)
    itself = np.array([c in (0, 0xD800) or unicodedata.normalize("NFC", d) == chr(c) if (d := _replacement(c)) is not None else True for c in range(0x3000)] + [False] * (TOP - 0x3000))
    simple = itself & (ccc == 0) & (script != CYRILLIC) & (script != GREEK) & (to_latin == same)
    simple[0x1100:0x1200] = False
    control = np.isin(same, CONTROLS_AS_BLANK)
    simple |= control
    return Tables(length, start, data, ccc, np.array([p for p, _ in pairs], np.int64), np.array([c for _, c in pairs], np.int32), np.isin(same, [p & 0x1FFFFF for p, _ in pairs]) & (ccc == 0), script, wordy, digit, to_latin, to_cyrillic, to_greek, to_digit, np.isin(same, [ord(x) for x in SIMILAR_TWINS[0]]), key_length, key_start, key_data, (~simple).astype(np.uint8) | digit.astype(np.uint8) << 1 | (script > 0).astype(np.uint8) << 2 | control.astype(np.uint8) << 3)


# Arrow text <-> code points


def decode(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row of each) of an Arrow array of strings.

    The texts lie end to end in one buffer, which becomes UTF-32 as a whole.
    """
    text = text.cast(pa.large_string())
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8) if n else np.zeros(1, np.int64)
    raw = memoryview(text.buffers()[2])[offsets[0] : offsets[-1]] if text.buffers()[2] else b""
    size = pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if text.null_count and np.diff(offsets)[~np.asarray(text.is_valid())].any():  # bytes under nulls
        return decode(pa.array(text.to_pylist(), pa.large_string()))
    cp = np.frombuffer(bytes(raw).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.int32)
    return cp, np.repeat(np.arange(n, dtype=np.int32), size)


def encode(cp: np.ndarray, row: np.ndarray, n: int, valid: np.ndarray | None = None) -> pa.Array:
    """The Arrow array of ``n`` strings with these code points; rows ascend."""
    raw = cp.astype("<i4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    end = np.zeros(len(cp) + 1, np.int64)
    np.cumsum((cp >= 0).view(np.int8) + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), out=end[1:])
    offsets = end[np.searchsorted(row, np.arange(n + 1, dtype=row.dtype if len(row) else np.int64), "left")]
    mask = pa.array(valid).buffers()[1] if valid is not None and not valid.all() else None
    return pa.Array.from_buffers(pa.large_string(), n, [mask, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]).cast(pa.string())


def _expand(cp: np.ndarray, row: np.ndarray, length: np.ndarray, start: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code point replaced by its string in the tables."""
    inside = np.minimum(cp, TOP - 1)
    n, s = length[inside], start[inside]
    high = cp >= TOP
    if high.any():
        n = np.where(high, np.where((cp >= 0xE0000) & (cp < 0xE1000), 0, 1), n)
    other = n != 1
    res = data[s]
    if high.any():
        res = np.where(high, cp, res)
    if not other.any():
        return res, row
    # the few that become none or several are written where their offsets say
    at = np.nonzero(other)[0]
    m = n[at].astype(np.int64)
    out = np.repeat(s[at] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
    whole = np.repeat(res, n)
    first = at + np.concatenate(([0], np.cumsum(m - 1)[:-1]))
    whole[np.repeat(first - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))] = data[np.minimum(out, len(data) - 1)]
    return whole, np.repeat(row, n)


def _compose(cp: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    inside = np.minimum(cp, TOP - 1)
    ccc = np.where(cp < TOP, t.ccc[inside], 0)
    mark = ccc > 0
    keep = np.ones(len(cp), bool)
    if mark.any():
        new = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
        base = np.maximum.accumulate(np.where(~mark | new, np.arange(len(cp)), 0))
        at = np.nonzero(mark)[0]
        order = at[np.lexsort((at, ccc[at], base[at]))]
        cp[at], ccc[at] = cp[order], ccc[order]  # canonical order; each base keeps its places
        own = base[at]
        k_th = at - own - 1
        ok = ~((own == at) | (ccc[own] > 0))
        at, own, k_th = at[ok], own[ok], k_th[ok]
        last = np.zeros(len(cp), np.int16)
        for k in range(int(k_th.max()) + 1 if len(k_th) else 0):
            a, o = at[k_th == k], own[k_th == k]
            want = cp[o].astype(np.int64) << 21 | cp[a]
            i = np.minimum(np.searchsorted(t.pair, want), len(t.pair) - 1)
            hit = (t.pair[i] == want) & ~((last[o] > 0) & (last[o] >= ccc[a]))
            cp[o[hit]] = t.whole[i[hit]]
            keep[a[hit]] = False
            last[o[~hit]] = ccc[a[~hit]]
    cp, row = cp[keep], row[keep]
    while len(cp) > 1:
        inside = np.minimum(cp, TOP - 1)
        a = np.nonzero(t.joins[inside[1:]] & (cp[1:] < TOP) & (row[1:] == row[:-1]))[0]
        want = cp[a].astype(np.int64) << 21 | cp[a + 1]
        i = np.minimum(np.searchsorted(t.pair, want), len(t.pair) - 1)
        hit = t.pair[i] == want
        a, i = a[hit], i[hit]
        first = np.concatenate(([True], np.diff(a) > 1)) if len(a) else np.zeros(0, bool)
        if not len(a):
            break
        cp[a[first]] = t.whole[i[first]]
        keep = np.ones(len(cp), bool)
        keep[a[first] + 1] = False
        cp, row = cp[keep], row[keep]
    for low, count, at_least in ((HANGUL_V, 21, "L"), (HANGUL_T + 1, 27, "S")):
        nxt = (cp[1:] >= low) & (cp[1:] < low + count) & (row[1:] == row[:-1]) if len(cp) > 1 else np.zeros(0, bool)
        if not nxt.any():
            continue
        a = np.nonzero(nxt)[0]
        if at_least == "L":
            a = a[(cp[a] >= HANGUL_L) & (cp[a] < HANGUL_L + 19)]
            cp[a] = HANGUL_S + ((cp[a] - HANGUL_L) * 21 + cp[a + 1] - HANGUL_V) * 28
        else:
            a = a[(cp[a] >= HANGUL_S) & (cp[a] < HANGUL_S + 11172) & ((cp[a] - HANGUL_S) % 28 == 0)]
            cp[a] = cp[a] + cp[a + 1] - HANGUL_T
        keep = np.ones(len(cp), bool)
        keep[a + 1] = False
        cp, row = cp[keep], row[keep]
    return cp, row


def _imitations(cp: np.ndarray, row: np.ndarray, t: Tables) -> np.ndarray:
    """Letters that imitate others replaced, word by word.

    A word's script is that of the letters which have no twin elsewhere. A word
    of twins alone is Latin if a Latin letter is among them or if it has at most
    three letters; else it is what it is. Letters that are merely similar count as
    their own script's where no Latin letter is in the word. If both scripts have as
    many sure letters, the one with more letters wins, Latin where they are equal. In a run of digits, letters that look
    like 0 and 1 are digits.
    """
    inside = np.minimum(cp, TOP - 1)
    wordy = t.wordy[inside] & (cp < TOP)
    if not wordy.any() or not ((cp >= 0x250) & wordy).any() and not t.digit[inside].any():
        return cp
    start = wordy & ~np.concatenate(([False], wordy[:-1] & (row[1:] == row[:-1])))
    word = np.cumsum(start) - 1
    own = np.nonzero(wordy)[0]
    w, c = word[own], cp[own]
    n = int(start.sum())
    script = t.script[c]
    count = lambda m: np.bincount(w[m], minlength=n)
    sure_latin = count((script == LATIN) & (t.to_cyrillic[c] == c) & (t.to_greek[c] == c) & (t.to_latin[c] == c))
    sure_cyrillic = count((script == CYRILLIC) & (t.to_latin[c] == c))
    among_latin = (count(script == LATIN) > 0)[w]
    sure_greek = count((script == GREEK) & ((t.to_latin[c] == c) | t.similar[c] & ~among_latin))
    latin, foreign, letters = count(script == LATIN), count((script == CYRILLIC) | (script == GREEK)), count(script > 0)
    digits = count(t.digit[c])
    as_digit = count((script > 0) & (t.to_digit[c] != c))
    cyrillic, greek = count(script == CYRILLIC), count(script == GREEK)
    wins = lambda sure, own: (sure > 0) & ((sure > sure_latin) | (sure == sure_latin) & (own > latin))
    goal = np.where(wins(sure_cyrillic, cyrillic) & (sure_cyrillic >= sure_greek), CYRILLIC, np.where(wins(sure_greek, greek), GREEK, 0))
    # nothing is sure, but more letters are good Greek than Latin
    goal = np.where((goal == 0) & (sure_latin == 0) & (count(t.similar[c]) > 0) & (greek > latin), GREEK, goal)
    goal = np.where((goal == 0) & ((latin > 0) | (letters <= 3) | (foreign == 0)), LATIN, goal)
    number = (digits >= 2) & (as_digit == letters) & (letters > 0)
    g = goal[w]
    out = np.where(g == CYRILLIC, t.to_cyrillic[c], np.where(g == GREEK, t.to_greek[c], np.where(g == LATIN, t.to_latin[c], c)))
    out = np.where(number[w], t.to_digit[c], out)
    cp = cp.copy()
    cp[own] = out
    return cp


def _doubtful(cp: np.ndarray, row: np.ndarray, n: int, t: Tables, kinds: int) -> np.ndarray:
    """Whether each row holds anything that may have to be replaced."""
    kind = t.kind[np.minimum(cp, TOP - 1)]
    bad = kind & kinds > 0
    if len(cp) > 1:
        two = kind[1:] | kind[:-1]
        bad[1:] |= (two & 6 == 6) & (kind[1:] & 6 != 6) & (row[1:] == row[:-1])
    out = np.zeros(n, bool)
    out[row[bad]] = True
    return out


def plain_points(cp: np.ndarray, row: np.ndarray, n: int, kinds: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Code points in the plain form; rows without anything doubtful pass as they are."""
    t = tables()
    doubt = _doubtful(cp, row, n, t, kinds)
    if not doubt.any():
        return cp, row
    own = doubt[row]
    c, r = _expand(cp[own], row[own], t.length, t.start, t.data)
    c, r = _compose(_imitations(c.astype(np.int32), r, t).astype(np.int32), r, t)
    if own.all():
        return c, r
    cp, row = np.concatenate((cp[~own], c)), np.concatenate((row[~own], r))
    order = np.argsort(row, kind="stable")
    return cp[order], row[order]


def _plain(text: pa.Array) -> pa.Array:
    cp, row = plain_points(*decode(text), len(text))
    return encode(cp, row, len(text), np.asarray(text.is_valid()))


def _key(text: pa.Array) -> pa.Array:
    t = tables()
    cp, row = plain_points(*decode(text), len(text), kinds=1)
    cp, row = _expand(cp, row, t.key_length, t.key_start, t.key_data)
    return encode(cp, row, len(text), np.asarray(text.is_valid()))


#: Bytes of text that are turned into arrays at once.
PART_BYTES = 1 << 20


def _in_parts(text: pa.Array, f) -> pa.Array:
    """``f`` over slices of bounded size; a longer single text is cut at blanks,
    which no step looks across, and put together again."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.nbytes <= PART_BYTES:
        return f(text)
    size = np.nan_to_num(np.array(pc.binary_length(text).to_numpy(zero_copy_only=False), float)).astype(np.int64)
    out, lo = [], 0
    ends = np.cumsum(size)
    while lo < len(text):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + PART_BYTES, "right")))
        if size[lo] <= PART_BYTES:
            out.append(f(text.slice(lo, hi - lo)))
        else:
            hi, whole, pieces, at = lo + 1, text[lo].as_py(), [], 0
            while at < len(whole):
                end = at + PART_BYTES // 4
                cut = whole.rfind(" ", at, end) + 1 if end < len(whole) else len(whole)
                cut = cut if cut > at else whole.find(" ", end) + 1 or len(whole)
                pieces.append(whole[at:cut])
                at = cut
            out.append(pa.array(["".join(x for p in pieces for x in f(pa.array([p])).to_pylist())], pa.string()))
        lo = hi
    return pa.concat_arrays(out)


def plain_array(text: pa.Array) -> pa.Array:
    return _in_parts(text, _plain)


def key_array(text: pa.Array) -> pa.Array:
    return _in_parts(text, _key)


def plain(col: Column | str) -> Column:
    """The plain form of a text column."""
    return F.arrow_udf(plain_array, "string")(col)


def key(col: Column | str) -> Column:
    """The form of a text column in which look and case do not matter."""
    return F.arrow_udf(key_array, "string")(col)


def not_plain(df, key_col: Column, text: Column):
    """(row_key, value, plain) of the rows whose text is not in the plain form."""
    rows = df.select(key_col.cast("string").alias("row_key"), text.alias("value")).where("row_key is not null and value is not null")
    return rows.withColumn("plain", plain("value")).where("plain <> value")
