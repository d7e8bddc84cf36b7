"""Queries on languages of documents (p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import language
from lodestrata.runtime import table


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language in which each document holds whole sentences, or the language of
    a document that holds none."""
    docs = table(spark, sf_dir, "documents")
    training = language.cleaned(language.labelled_sample(docs, "lang", "text"))
    return language.segment_languages(docs, "doc_id", "lang", "text", training)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the documents whose label does not tell their one language."""
    wrong = p10_segments(spark, sf_dir).where("n_sentences > 0 and (n_langs > 1 or label is null or label <> main)")
    return wrong.select("doc_id", "lang").distinct()


QUERIES = {f.__name__: f for f in (p10_found, p10_segments)}
ORACLE: dict[str, str] = {}
