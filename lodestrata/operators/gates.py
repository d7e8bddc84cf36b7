"""Integrity rules over site records, each as a table of violations.

Inputs are site records as ``readers.site_records`` reads them and the long fact
table of their indicators. Every rule returns (gate, entity, message); an empty
table is a pass. ``all_gates`` puts them together in one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import rules
from lodestrata.operators.stats import violations

# Indicators that an operator declares and a second source must confirm.
DECLARATIVE = ("E4", "W4", "F4", "F5", "L4", "L5", "T2")
#: A letter of the scale named as somebody's grade, in prose.
LETTER_IN_PROSE = r"(?i:\b(?:grade|graded|note|noted|noté|notée|rated|scored|letter|lettre)\b)[\s:«\"(]{0,4}(?:[a-zà-ÿ']+\s+){0,2}[A-E](?![\p{L}\p{N}+'’])"


def _rows(df: DataFrame, entity: str) -> DataFrame:
    return df.select(F.col(entity).cast("string").alias("entity"))


def id_is_file_name(sites: DataFrame) -> DataFrame:
    return violations([("id", _rows(sites.where(~F.col("id").eqNullSafe(F.col("stem"))), "stem"), "the id is not the file's name")])


def indicator_set(facts: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Sites that lack an indicator of the list or have one that isn't on it."""
    got = facts.groupBy("site_id").agg(F.collect_set("indicator_id").alias("own"), F.count("*").alias("n"))
    want = F.array(*[F.lit(x) for x in expected])
    return violations([
        ("indicators", _rows(got.where(F.size(F.array_except(want, "own")) > 0), "site_id"), "an indicator is absent"),
        ("indicators", _rows(got.where(F.size(F.array_except("own", want)) > 0), "site_id"), "an indicator is unknown"),
        ("indicators", _rows(got.where(F.col("n") > F.size("own")), "site_id"), "an indicator comes twice"),
    ])


def sources(facts: DataFrame) -> DataFrame:
    """A value needs a source, and where nothing was found or looked for there is none."""
    has = F.col("value_num").isNotNull() | F.col("value_str").isNotNull() | F.col("value_bool").isNotNull()
    return violations([
        ("source", _rows(facts.where(F.col("status").isin(*rules.VALUED) & F.col("source.url").isNull()), "site_id"), "a value without a source"),
        ("source", _rows(facts.where(~F.col("status").isin(*rules.VALUED) & has), "site_id"), "a value where there is none to have"),
        ("source", _rows(facts.where((F.col("status") == "not_collected") & F.col("source.url").isNotNull()), "site_id"), "a source where nobody looked"),
    ])


def declared_as_measured(facts: DataFrame, verification: str = "verification_source", ids: Sequence[str] = DECLARATIVE) -> DataFrame:
    bad = facts.where((F.col("status") == "measured") & F.col("indicator_id").isin(*ids) & F.col(f"{verification}.url").isNull())
    return violations([("verification", _rows(bad, "site_id"), "a declared figure counts as measured without a second source")])


def estimates_are_tagged(sites: DataFrame, facts: DataFrame, indicator: str = "L2") -> DataFrame:
    """A power figure that is estimated and the indicator made of it go together."""
    own = facts.where(F.col("indicator_id") == indicator).select(F.col("site_id").alias("id"), F.col("status").alias("_s"))
    both = sites.select("id", F.col("identity.power_mw_status").alias("_p")).join(own, "id")
    return violations([
        ("estimate", _rows(both.where(F.col("_p").eqNullSafe(F.lit("estimated")) & F.col("_s").isin("measured", "announced")), "id"), "an estimated power makes an untagged indicator"),
        ("estimate", _rows(both.where((F.col("_s") == "estimated") & ~F.col("_p").eqNullSafe(F.lit("estimated"))), "id"), "an estimated indicator without an estimated power"),
    ])


def journal(sites: DataFrame) -> DataFrame:
    """Entries after the first need a rationale."""
    e = sites.select("id", F.posexplode("score_history").alias("seq", "e")).where("seq > 0 and (e.rationale is null or trim(e.rationale) = '')")
    return violations([("journal", _rows(e, "id"), "a later entry without a rationale")])


def letters_in_prose(texts: DataFrame, key: str, text: str) -> DataFrame:
    return violations([("prose", _rows(texts.where(F.col(text).rlike(LETTER_IN_PROSE)), key), "the text names a grade")])


def banned_terms(texts: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """Texts that hold a term of a list as a word, whatever its case."""
    any_of = "|".join(re.escape(t) for t in terms)
    return violations([("terms", _rows(texts.where(F.col(text).rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{any_of})(?![\p{{L}}\p{{N}}])")) if terms else texts.where("false"), key), "the text holds a term that is not to be used")])


def weights(defs: DataFrame, group: str, weight: str, tolerance: float = 1e-9) -> DataFrame:
    bad = defs.groupBy(group).agg(F.sum(weight).alias("_w")).where(F.abs(F.col("_w") - 1) > tolerance)
    return violations([("weights", _rows(bad, group), "weights do not sum to 1")])


def monotone(scores: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """Scores that fall along a declared order."""
    w = W.partitionBy(key).orderBy(order)
    bad = scores.withColumn("_b", F.lag(score).over(w)).where(F.col(score) < F.col("_b")).select(key).distinct()
    return violations([("order", _rows(bad, key), "scores fall along the declared order")])


def pillar_references(defs: DataFrame, pillars: DataFrame, group: str = "pillar", key: str = "indicator") -> DataFrame:
    """Indicators of a pillar that isn't there, and indicators defined twice."""
    unknown = defs.join(pillars.select(F.col(group)).distinct(), group, "left_anti")
    twice = defs.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    return violations([("pillars", _rows(unknown, key), "the pillar is unknown"), ("pillars", _rows(twice, key), "the indicator is defined twice")])


def exact_order(defs: DataFrame, key: str = "indicator", order: str = "order", categories: str = "categories") -> DataFrame:
    """Of indicators (key, order array<string>, categories map<string,double>): an
    order that doesn't name just the categories, each once, and scores that rise
    along it."""
    c = F.coalesce(F.map_keys(categories), F.array().cast("array<string>"))
    other = F.sort_array(F.coalesce(order, F.array().cast("array<string>"))) != F.sort_array(c)
    along = F.transform(order, lambda x: F.col(categories)[x])
    rises = F.exists(F.arrays_zip(F.slice(along, F.lit(1), F.size(along) - 1).alias("a"), F.slice(along, F.lit(2), F.size(along)).alias("b")), lambda p: p["a"] < p["b"])
    own = defs.where(F.col(order).isNotNull())
    return violations([
        ("order", _rows(own.where(other), key), "the declared order does not cover the categories"),
        ("order", _rows(own.where(~other & (F.size(order) > 1) & rises), key), "scores rise along the declared order"),
    ])


def against_draft(sites: DataFrame, version: str, published: bool, prefix: str = "zz-") -> DataFrame:
    """Real records scored by a draft, and journal entries of another version."""
    e = sites.select("id", F.explode("score_history").alias("e")).where(~F.col("e.methodology_version").eqNullSafe(F.lit(version)))
    real = sites.where(~F.col("id").startswith(prefix))
    return violations([
        ("version", _rows(real.where(F.lit(not published)), "id"), "a real record is scored by a draft"),
        ("version", _rows(e, "id"), "a journal entry is of another version"),
    ])


#: What the dossier indicator says where a dossier can be read.
DOSSIER = ("full_dossier_online", "partial")


def read_traces(sites: DataFrame, facts: DataFrame, project_ids: Sequence[str], scored_ids: Sequence[str], dossier: str = "T2") -> DataFrame:
    """``missing`` needs a source where a dossier is open, and ``not_collected`` has no
    place in a published record."""
    t2 = facts.where((F.col("indicator_id") == dossier) & (F.col("status") == "measured") & F.col("value_str").isin(*DOSSIER)).select("site_id").distinct()
    missing = facts.where(F.col("indicator_id").isin(*project_ids) & (F.col("status") == "missing") & F.col("source").isNull()).join(t2, "site_id", "left_semi")
    public = sites.where(F.col("publication.status") == "published").select(F.col("id").alias("site_id"))
    open_ = facts.where(F.col("indicator_id").isin(*scored_ids) & (F.col("status") == "not_collected")).join(public, "site_id", "left_semi")
    return violations([
        ("trace", _rows(missing, "site_id"), "missing without a source although a dossier is open"),
        ("trace", _rows(open_, "site_id"), "not collected in a published record"),
    ])


#: How a title names where a power figure comes from, and registers.
POWER_FROM, REGISTER = r"(?i)puissance\s+[\d.]+\s*MW\s*\(([^)]+)\)", r"(?i)EED|RVO|registre r[ée]glementaire|regulatory register"


def power_provenance(facts: DataFrame, indicator: str = "L2") -> DataFrame:
    """A measured figure whose title names a source that is no register."""
    title = F.coalesce("source.title", F.lit(""))
    said = F.regexp_extract(title, POWER_FROM, 1)
    bad = facts.where((F.col("indicator_id") == indicator) & (F.col("status") == "measured") & (said != "") & ~said.rlike(REGISTER))
    return violations([("power", _rows(bad, "site_id"), "a measured figure rests on no register")])


def twice(df: DataFrame, key: str) -> DataFrame:
    return violations([("twice", _rows(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), key), "the id comes twice")])


def keys_of(raw: DataFrame, key: str, payload: str, wanted: Sequence[str]) -> DataFrame:
    """(entity, path, key) of every key of the list, at any depth of a JSON text; what
    is no JSON has none."""
    names = frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[str]] = [[], [], []]
            for entity, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    todo = [("$", json.loads(text))] if text else []
                except (ValueError, RecursionError):
                    continue
                while todo:
                    at, value = todo.pop()
                    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
                    for k, v in inner:
                        todo.append((f"{at}.{k}" if isinstance(value, dict) else f"{at}[{k}]", v))
                        if isinstance(value, dict) and k in names:
                            for c, x in zip(cols, (entity, at, k)):
                                c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["entity", "path", "key"])

    return raw.select(F.col(key).cast("string"), F.col(payload).cast("string")).where(F.col(key).isNotNull()).mapInArrow(run, "entity string, path string, key string")


#: Keys that an entry of facts only must not have.
GRADE_LIKE = ("grade", "grades", "score", "confidence", "letter", "note", "documentation")


def grade_like_keys(raw: DataFrame, key: str, payload: str) -> DataFrame:
    """Records in which a key, at any depth, is that of a judgement."""
    return violations([("keys", keys_of(raw, key, payload, GRADE_LIKE).select("entity").distinct(), "a key of a judgement")])


def all_gates(sites: DataFrame, facts: DataFrame, expected: Sequence[str], version: str | None = None, published: bool = True, project_ids: Sequence[str] = (), scored_ids: Sequence[str] = ()) -> DataFrame:
    """Every rule on records and their facts; those on versions need the active one."""
    parts = [indicator_set(facts, expected), sources(facts), declared_as_measured(facts), estimates_are_tagged(sites, facts), power_provenance(facts), journal(sites), read_traces(sites, facts, project_ids, scored_ids)]
    if version is not None:
        parts.append(against_draft(sites, version, published))
    out = id_is_file_name(sites)
    for part in parts:
        out = out.unionByName(part)
    return out
