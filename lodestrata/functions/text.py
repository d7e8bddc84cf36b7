"""Text functions as column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with accents and what they are without.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
BARE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def accent_fold(text: Column) -> Column:
    """Lower case, accents off, blanks put together."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, ACCENTED, BARE)), r"\s+", " "))


def slugify(text: Column) -> Column:
    return F.trim(F.regexp_replace(accent_fold(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def locale_number(text: Column) -> Column:
    """A number with a decimal comma, blanks between thousands and maybe a % sign;
    zero and what is no number are null."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[\s  %]", ""), ",", ".")
    return F.nullif(clean.try_cast("double"), F.lit(0.0))


def valid_email(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.coalesce(t.rlike(r"^[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$") & (F.length(t) <= 254), F.lit(False))


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tokens(text: Column, least: int = 1) -> Column:
    return F.filter(F.split(F.regexp_replace(accent_fold(text), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) >= least)


def longest_token(text: Column, stop: list[str], least: int = 3) -> Column:
    """The longest word that is no stop word, the first of several."""
    own = F.filter(tokens(text, least), lambda w: ~w.isin(*stop))
    return F.reduce(own, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))


def whole_word(text: Column, word: Column) -> Column:
    """Whether a word stands in a text as a word; both in comparison form."""
    return F.array_contains(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), word)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1))


def url_title(url: Column) -> Column:
    """Words of the last part of an address, without number and ending."""
    last = F.regexp_extract(url, r"([^/?#]*)/?(?:[?#].*)?$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[a-z]+$", ""), r"[-_0-9]+", " "))


def split_list(text: Column, pattern: str = "[;,]") -> Column:
    return F.filter(F.transform(F.split(text, pattern), F.trim), lambda x: F.length(x) > 0)


def right_of(text: Column, mark: str, most: int = 160) -> Column:
    """What stands right of the first mark, at most so many characters."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(F.trim(F.substr(text, at + len(mark), F.length(text))), 1, most))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("bigint"))


def place_key(text: Column) -> Column:
    """A municipality in comparison form, without a district's number."""
    return F.trim(F.regexp_replace(accent_fold(text), r"\s*\b\d+(?:er|e|eme)\s+arrondissement\b", ""))


def first_of(words: list[str], *texts: Column) -> Column:
    """The first of the words that stands in any of the texts as a word, or null."""
    folded = F.concat(F.lit(" "), F.regexp_replace(accent_fold(F.concat_ws(" ", *texts)), "[^a-z0-9]+", " "), F.lit(" "))
    found = F.lit(None).cast("string")
    for w in reversed(words):
        found = F.when(F.contains(folded, F.lit(f" {w} ")), w).otherwise(found)
    return found
