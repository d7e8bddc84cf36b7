"""Queries on mixing sources to target weights (p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import mixing
from lodestrata.llm.language import language_of_label
from lodestrata.runtime import cut, table


def planned(spark: SparkSession, sf_dir: str, whole: bool) -> tuple[DataFrame, mixing.Node]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", language_of_label(F.col("lang")).alias("lang"), "text")
    counted = cut(mixing.sized(docs, "doc_id", "text", ["source", "lang"]), "sized")
    targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in table(spark, sf_dir, "mix_targets").collect() if r["source"] is not None}
    # one row per source and language
    sizes = [(r["source"], r["lang"], r["n"] or 0) for r in counted.where(F.col("source").isin(*targets)).groupBy("source", "lang").agg(F.sum("tokens").alias("n")).collect()]
    total = float(sum(n for s, _, n in sizes if s in targets)) if whole else None
    return counted, mixing.plan(sizes, targets, total)


def _report(spark: SparkSession, sf_dir: str, whole: bool) -> DataFrame:
    counted, root = planned(spark, sf_dir, whole)
    chosen = mixing.select(counted, root).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.count("*").alias("n_documents"))
    sizes = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    per = table(spark, sf_dir, "mix_targets").join(sizes, "source", "left").join(chosen, "source", "left").fillna(0, ["tokens", "used", "n_documents"])
    all_ = per.agg(F.sum("used").alias("_all"))
    return per.crossJoin(F.broadcast(all_)).select(
        "source", "tokens", "n_documents", "used", F.round(F.try_divide("used", "tokens"), 4).alias("times_used"), "max_repeats", "target_share", F.round(F.try_divide("used", "_all"), 6).alias("actual_share")
    )


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source is used and its actual share, at the largest total
    that meets every target."""
    return _report(spark, sf_dir, whole=False)


def p9_mix_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at a total as large as the corpus: small sources fall short, and
    the others take over what is missing."""
    return _report(spark, sf_dir, whole=True)


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents and how often each is repeated."""
    return mixing.select(*planned(spark, sf_dir, whole=False))


QUERIES = {f.__name__: f for f in (p9_mix, p9_mix_whole, p9_selection)}
ORACLE: dict[str, str] = {}
