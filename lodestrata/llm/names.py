"""Reading of project, place and organisation names as people type them.

Everything works on the comparison form of ``plain_text``: no case, no accents,
no look-alike letters. Word lists are fixed values; spellings near to a listed
word count as the word. What is left of a name when the listed words are gone
is what tells it from others.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import pyarrow as pa

from lodestrata.llm.plain_text import key_array

# Words that say what kind of place a project is.
FACILITY = "campus datacenter datacentre data center centre de donnees dc hub numerique polo digitale rechenzentrum server park centro datos projekt project projet proyecto progetto".split()
# Words before a number or letter, and words for wings.
PHASE = "phase fase ph etape".split()
BUILDING = "batiment building bat bldg gebaude edificio halle".split()
WINGS = {"nord": "N", "north": "N", "norte": "N", "noord": "N", "sud": "S", "south": "S", "sur": "S", "zuid": "S", "sued": "S", "ost": "E", "east": "E", "est": "E", "este": "E", "west": "W", "ouest": "W", "ovest": "W", "oeste": "W"}
NUMBERS = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6"}
# Legal forms, lines of business, words for groups, titles.
LEGAL = set("ag sa sas bv nv gmbh sl spa ltd limited plc inc llc srl sarl kg ab oy as ug slu sau co corp cie".split())
BUSINESS = "hosting computing technologies technology systems system holding infrastructure infraestructuras international rechenzentren reseaux developpement data centers datacenters services solutions".split()
SHORT = {"hldg", "rz", "dc", "intl", "int", "grp"}
GROUPS = set("groupe gruppe group grupo gruppo groep the".split())
TITLES = set("dr mr mrs ms ing prof herr frau mme mlle m sr sra dott sig sigra dipl".split())
# Usual short forms of first names; more can be added with ``add_short_forms``.
NICKNAMES = {
    "alexander": "alex sandy sasha xander", "andrew": "andy drew", "anthony": "tony", "antonius": "anton ton tonny toon", "benjamin": "ben", "catherine": "cathy", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny",
    "david": "dave", "dorothea": "dot dotty", "edward": "ed eddie ted", "elisabeth": "beth betty elise lisa lisbeth lise liz", "francesco": "cesco checco franco", "francisco": "paco pancho", "frederic": "fred freddy", "friederike": "frieda fritzi rike",
    "giuseppe": "beppe peppe pino", "guillermo": "guille memo willy", "hendrik": "henk", "heinrich": "heinz", "ignacio": "nacho", "isabelle": "isa bella belle", "james": "jim jimmy", "jean": "jeannot", "johannes": "hans jan jo johan",
    "john": "jack johnny", "jose": "pepe", "joseph": "joe", "josef": "sepp", "katherine": "kate kathy katie kat", "lawrence": "larry", "luigi": "gigi", "manuel": "manolo", "margaret": "greta maggie marge meg peggy", "matthew": "matt", "michael": "mick mike",
    "nicholas": "nick", "patricia": "pat patty", "peter": "pete", "richard": "dick rick richie", "robert": "bob bobby rob", "salvatore": "totò", "samuel": "sam", "stephen": "steve", "susanna": "sue susie", "theodora": "dora thea theo", "thomas": "tom tommy",
    "walter": "wally", "wilhelmina": "mina minna wil willa", "william": "bill billy liam will", "zachary": "zack",
}
#: Small words of place names.
PARTICLES = set("saint sainte st ste s san santa sta sankt sur les am an der de di del la le l d bad mont chateau ch i in bei im a".split())
FULL_NAME = {n: k for k, v in NICKNAMES.items() for n in v.split()}


def add_short_forms(path: str) -> None:
    """Take in a public list: lines of a full name and its short forms, with commas."""
    with open(path, encoding="utf-8") as f:
        for line in f:
            full, *short = (w.strip().lower() for w in line.split(","))
            FULL_NAME.update((w, full) for w in short if w)
    for cached in (organisation, project, same_name):
        cached.cache_clear()


_WORD = re.compile(r"[^\W_]+")
_INITIALS = re.compile(r"\b((?:[^\W\d_]\.){1,4}[^\W\d_])\b\.?")
_PLACE_END = re.compile(r"\s*\([^()]*\)\s*$|\s+-\s+.*$")
_COUNTRY = re.compile(r"\(\s*[a-z]{2}\s*\)")
_POSTCODE = re.compile(r"\b\d{4,6}\b")


def near(a: str, b: str, limit: int) -> int:
    """Letters changed, left out, added or swapped between two words; limit + 1 if more."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > limit or len(set(a) ^ set(b)) > 2 * limit:  # an edit changes two letters at most
        return limit + 1
    before, row = None, list(range(m + 1))
    for i in range(1, n + 1):
        new = [i]
        ca = a[i - 1]
        for j in range(1, m + 1):
            cb = b[j - 1]
            v = row[j - 1] if ca == cb else 1 + min(row[j - 1], row[j], new[j - 1])
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            new.append(v)
        if min(new) > limit:
            return limit + 1
        before, row = row, new
    return min(row[m], limit + 1)


def likeness(a: str, b: str) -> float:
    """1 for equal words, less by the share of letters that differ."""
    size = max(len(a), len(b))
    return 1 - near(a, b, size) / size if size else 1.0


def more_alike(a: str, b: str, than: float) -> bool:
    """Whether the likeness is more than this; words farther apart are not compared to the end."""
    size = max(len(a), len(b))
    return not size or 1 - near(a, b, int((1 - than) * size + 1e-9)) / size > than


def shortened(word: str, times: int = 1) -> set[str]:
    """The word and all that is left of it without up to ``times`` letters."""
    out, new = {word}, {word}
    for _ in range(times):
        new = {w[:k] + w[k + 1 :] for w in new for k in range(len(w))}
        out |= new
    return out


@functools.lru_cache(50_000)
def _shorter(word: str) -> frozenset[str]:
    """``shortened`` by one; one word is looked up in several lists."""
    return frozenset(shortened(word))


class Words:
    """Words found also if a letter is wrong, from five letters on."""

    def __init__(self, words, least: int = 5) -> None:
        self.words, self.least = set(words), least
        self.short: dict[str, list[str]] = {}
        for w in self.words:
            if len(w) >= 5:
                for s in shortened(w):
                    self.short.setdefault(s, []).append(w)

    def find(self, word: str) -> str | None:
        if word in self.words:
            return word
        if len(word) >= self.least:
            for s in _shorter(word) & self.short.keys():
                for w in self.short[s]:
                    if near(word, w, 1) <= 1:
                        return w
        return None


_PARTICLE = Words(PARTICLES)
_FACILITY, _UNIT, _BUSINESS = Words(FACILITY), Words([*PHASE, *BUILDING, *(w for w in WINGS if len(w) >= 5)]), Words(BUSINESS)
_BEGINNINGS = {b[:n] for b in BUSINESS for n in range(3, len(b) + 1)}
_GROUP = Words((g for g in GROUPS if len(g) >= 5), least=4)


def joined_initials(text: str) -> str:
    """Letters with full stops between them, as of a legal form, as one word."""
    return _INITIALS.sub(lambda m: m.group(1).replace(".", ""), text)


@functools.lru_cache(200_000)
def organisation(folded: str) -> str:
    """What tells an organisation or person from others: its own words in order,
    initials as single letters, short forms with a full stop."""
    text = joined_initials(folded)
    own, every = [], []
    for m in _WORD.finditer(text):
        w = m.group()
        dot = text[m.end() : m.end() + 1] == "."
        every.append(w)
        if w in LEGAL or w in GROUPS or w in SHORT or (w in TITLES and (len(w) > 1 or not dot)):
            continue
        if _BUSINESS.find(w) or w in _BEGINNINGS:
            continue
        if _GROUP.find(w):
            continue
        own.append(w + "." if dot and 1 < len(w) <= 4 else w)
    return " ".join(sorted(own or every))


class Project(NamedTuple):
    core: str  # the project's own name, or "" if the entry carries its promoter's
    unit: str  # phase, building or wing
    promoter: str  # the promoter's own words, if the entry carries them


@functools.lru_cache(200_000)
def project(folded: str) -> Project:
    """A project's own name and unit; a name of two own words and no kind of
    place or unit is that of a promoter."""
    text = folded.strip()
    bare = _PLACE_END.sub("", text) if text else text
    bare = bare or text
    core, unit, marks, pending = [], [], 0, ""
    spoken = joined_initials(bare)
    found = [(m.group(), spoken[m.end() : m.end() + 1] == ".") for m in _WORD.finditer(spoken)]
    for k, (w, dot) in enumerate(found):
        u = _UNIT.find(w)
        if u in PHASE or u in BUILDING:
            pending = "B" if u in BUILDING else "P"
            marks += 1
        elif pending and (len(w) == 1 or w in NUMBERS or w.isdigit()):
            unit.append(w.upper() if pending == "B" and w.isalpha() and w not in ("i",) else NUMBERS.get(w, w))
            pending = ""
        elif w in WINGS or u in WINGS:
            unit.append(WINGS.get(w) or WINGS[u])
            marks += 1
        elif w.isdigit() or (w in NUMBERS and not dot and k and len(found) > 1):
            unit.append(NUMBERS.get(w, str(int(w)) if w.isdigit() else w))
            marks += 1
        elif _FACILITY.find(w):
            marks += 1
        else:
            core.append(w)
    own = organisation(bare)
    words = own.split()
    business = any(w in BUSINESS and w not in ("data", "center") for w, _ in found) or (len(found) > 2 and found[-1][0] in LEGAL)
    if len(words) >= 2 and (business or len(core) >= 2 and not unit):
        places = sum(1 for w, _ in found if _FACILITY.find(w) and w not in ("dc", "data", "centers"))
        if not places:
            return Project("", "", own)
    if len(core) > 1 and len(words) == 1 and not unit and any(w in LEGAL for w in core):
        return Project("", "", own)
    if not core:  # a name that is near to a listed word
        core = [w for w, _ in found if w not in FACILITY and w not in PHASE and w not in BUILDING and w not in WINGS and w not in NUMBERS and not w.isdigit() and len(w) > 1]
    return Project("".join(w for w in core if w not in LEGAL or len(core) == 1), "".join(sorted(unit)), "")


@functools.lru_cache(200_000)
def place(folded: str) -> str:
    """A municipality's own words, without post code, country and small words."""
    text = _POSTCODE.sub(" ", _COUNTRY.sub(" ", folded.replace("'", " ")))
    words = _WORD.findall(text)
    own = [w for w in words if len(w) > 1 and not _PARTICLE.find(w)]
    return " ".join(own or words)


def place_likeness(a: str, b: str) -> float:
    """Likeness of two municipalities' own words; blanks that slipped don't count."""
    if a == b:
        return 1.0
    x, y = a.replace(" ", ""), b.replace(" ", "")
    if min(len(x), len(y)) >= 4 and (x.endswith(y) or y.endswith(x)):
        return 0.95
    return max(likeness(a, b), likeness(x, y))


_SCHEME = re.compile(r"^[a-z]+://")
_HOST = re.compile(r"^(?:www|m|amp|mobile)\.")
_TAIL = re.compile(r"[#?].*$")
_AMP = re.compile(r"(?:/amp|/index\.html?|/)+$")
_SLUG = re.compile(r"^([a-z]{4,}(?:-[a-z]+)*)-\d+$")
_ARTICLE = re.compile(r"\d{3,}$")
_ARCHIVE = re.compile(r"^(?:https?://)?[^/]*archive[^/]*/(?:web/)?\d{6,14}[a-z_]*/(?=https?:)")


def address(url: str | None) -> str:
    """A web address without what doesn't change the page."""
    u = (url or "").strip().lower()
    while "archive" in u:
        new = _ARCHIVE.sub("", u)
        if new == u:
            break
        u = new
    return _AMP.sub("", _TAIL.sub("", _HOST.sub("", _SCHEME.sub("", u))))


def slug(url: str) -> str:
    """The name in an address's last part, if it has one before a number."""
    m = _SLUG.match(url.rsplit("/", 1)[-1])
    return m.group(1).replace("-", "") if m else ""


def is_article(url: str) -> bool:
    return bool(_ARTICLE.search(url.rsplit("/", 1)[-1]))


def _pair(a: str, b: str) -> float:
    """How well two own words go together: 0 not at all, 1 the same."""
    if a == b:
        return 1.0
    x, y = a.rstrip("."), b.rstrip(".")
    if len(x) > len(y):
        x, y, a, b = y, x, b, a
    if not x:
        return 0.0
    if len(x) == 1:
        return 0.6 if x in (y[0], FULL_NAME.get(y.rstrip("."), y)[0]) else 0.0
    if x == y:
        return 1.0
    fx, fy = FULL_NAME.get(x, x), FULL_NAME.get(y, y)
    if fx == fy:
        return 0.95
    if a.endswith(".") and (y.startswith(x) or fy.startswith(x)):
        return 0.8
    d = near(x, y, 2)
    if d == 1 and len(x) >= 4:
        return 0.92
    if d == 1 and len(x) == 3 and x[0] == y[0]:
        return 0.8
    if d == 2 and len(x) >= 6:
        return 0.8
    if (x != fx or y != fy) and near(fx, fy, 1) <= 1:
        return 0.85
    return 0.0


@functools.lru_cache(100_000)
def same_name(a: str, b: str) -> float:
    """Likeness of two names' own words, 0 unless every word of the shorter has a
    partner in the longer and only initials are left over."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    scores, left, full = [], list(y), 0
    order = sorted(x, key=lambda w: -len(w.rstrip(".")))
    for w in order:
        best = max(left, key=lambda v: (_pair(w, v), len(v)))
        s = _pair(w, best)
        if s == 0:
            if len(w) == 1 and len(x) > 2:
                continue
            return 0.0
        left.remove(best)
        scores.append(s)
        full += s >= 0.8 and len(w.rstrip(".")) > 3 and w.rstrip(".") not in NICKNAMES and w.rstrip(".") not in FULL_NAME
    if any(len(v.rstrip(".")) > 1 for v in left) or not full:
        return 0.0
    if len(scores) < 2 and len(y) > 1:
        return 0.0
    return sum(scores) / len(scores)


def folded(values: list[str | None]) -> list[str]:
    """Comparison forms, empty for null, blanks put together."""
    return [" ".join(v.split()) if v else "" for v in key_array(pa.array(values, pa.string())).to_pylist()]
