"""Scoring rules as column expressions, all inside whole-stage codegen.

Definitions are compiled into one expression each: a step table becomes a CASE,
a category table a literal map, a rubric a sum of CASEs. An input no rule covers
gives null, or an error where ``strict`` is set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a status means for scoring.
VALUED = ("measured", "announced", "estimated")
DECLARED = ("announced", "estimated")
# Lowest score of each letter, and of each mark of documentation.
LETTERS = ((80.0, "A"), (65.0, "B"), (50.0, "C"), (35.0, "D"), (0.0, "E"))
DOTS = ((0.80, 4), (0.60, 3), (0.40, 2))
CAP = 60.0
MIN_COVERAGE = 0.40
DECLARED_PENALTY = 0.5
CONFIDENCE = ((0.75, "high"), (0.45, "medium"))


def ladder(pairs: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """First value whose condition holds."""
    c = None
    for cond, value in pairs:
        v = value if isinstance(value, Column) else F.lit(value)
        c = F.when(cond, v) if c is None else c.when(cond, v)
    o = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return o if c is None else c.otherwise(o)


def by_steps(value: Column, steps: Sequence[tuple[float, float]], above: float | None = None) -> Column:
    """Score of the first step, in the order given, that the value doesn't exceed."""
    return F.when(value.isNull(), None).otherwise(ladder([(value <= up_to, score) for up_to, score in steps], above))


def at_least(value: Column, cuts: Sequence[tuple[float, object]], otherwise: object = None) -> Column:
    """Label of the first cut that the value reaches."""
    return F.when(value.isNull(), None).otherwise(ladder([(value >= cut, label) for cut, label in cuts], otherwise))


def between_bounds(value: Column, low: float, high: float, lower_is_better: bool = False) -> Column:
    """Position between two bounds as 0 to 100, clamped, turned if low is good."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))) * 100
    score = 100 - share if lower_is_better else share
    return F.when(value.isNull(), None).otherwise(score)


def by_category(value: Column, scores: Mapping[str, float], strict: bool = False) -> Column:
    """Score of a category; an unknown one is null, or an error."""
    table = F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])
    hit = F.get(F.array(table[value]), F.lit(0)) if not strict else table[value]
    if strict:
        return F.when(value.isNull(), None).when(hit.isNull(), F.raise_error(F.concat(F.lit("unknown category "), value)).cast("double")).otherwise(hit)
    return hit


def count_class(value: Column) -> Column:
    """A count as rubric key: itself up to 1, else 2_or_more."""
    return F.when(value >= 2, "2_or_more").otherwise(value.cast("string"))


def by_rubric(values: Mapping[str, Column], rubric: Mapping[str, Mapping[str, float]]) -> Column:
    """Sum of the points of several answers; missing answers give none."""
    parts = [F.coalesce(by_category(col, rubric[name]), F.lit(0.0)) for name, col in values.items()]
    return reduce(lambda a, b: a + b, parts)


def dispatch(kind: Column, cases: Mapping[str, Column]) -> Column:
    """The rule that a definition's kind names."""
    return ladder([(kind == k, c) for k, c in cases.items()])


def capped(score: Column, status: Column, cap: float = CAP) -> Column:
    """What is only declared or estimated can't score above the cap."""
    return F.when(status.isin(*DECLARED), F.least(score, F.lit(cap))).when(status == "measured", score)


def substantive(score: Column, status: Column, block: Column) -> Column:
    """Missing counts as zero outside the base block; elsewhere it is left out."""
    return F.when((status == "missing") & (block != "base"), F.lit(0.0)).otherwise(score)


def letter(score: Column, digits: int | None = 1) -> Column:
    """Letter of a score, cut on the rounded figure."""
    s = score if digits is None else F.round(score, digits)
    return at_least(s, LETTERS)


def reserved(grade: Column, verified: Column) -> Column:
    """The best letter is kept for sites with verified data."""
    return F.when((grade == "A") & ~verified, F.lit("B")).otherwise(grade)


def dots(coverage: Column) -> Column:
    return at_least(coverage, DOTS, 1)


def confidence_level(raw: Column) -> Column:
    return at_least(raw, CONFIDENCE, "low")


def guarded_ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part, F.nullif(whole, F.lit(0)))


def significant(value: Column, figures: int = 2) -> Column:
    """Rounded to a number of significant figures."""
    k = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - (figures - 1))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value / k) * k)


def prefix_class(code: Column, exact: Mapping[str, str], prefixes: Sequence[tuple[str, str]]) -> Column:
    """Class of a code: whole codes first, then prefixes in order."""
    return ladder([*((code == k, v) for k, v in exact.items()), *((code.startswith(p), v) for p, v in prefixes)])


def keyword_class(text: Column, words: Sequence[tuple[str, str]]) -> Column:
    """Class of the first pattern found in a text, case aside."""
    low = F.lower(text)
    return ladder([(low.rlike(p), v) for p, v in words])


def latest_of(columns: Sequence[str]) -> Column:
    """The value of the last of several dated columns that has one."""
    return F.coalesce(*[F.col(c) for c in sorted(columns, reverse=True)])


def flags(pairs: Sequence[tuple[Column, str]]) -> Column:
    """The names of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a place lies in (south, north, west, east); null without a place."""
    s, n, w, e = box
    return F.when(lat.isNotNull() & lon.isNotNull(), lat.between(s, n) & lon.between(w, e))
