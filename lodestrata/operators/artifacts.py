"""Public projections of scored sites: what is shown, and how exactly.

``scores`` has one row per site: id, site_grade, site_score, process_grade,
confidence and ``pillars``, a map from pillar to letter. ``build`` gives the whole
set of artifacts as DataFrames by name; ``write`` stores them, rows of one kind
per folder, partitioned where a reader asks for one site.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import rules
from lodestrata.operators import ranking, spatial
from lodestrata.operators.stats import medians

FIXTURE_PREFIX = "zz-"


def size_tier(power: Column) -> Column:
    """0 unknown, 1 below 10 MW, 2 below 50 MW, 3 from there on."""
    return F.coalesce(rules.at_least(power, [(50.0, 3), (10.0, 2)], 1), F.lit(0))


def real_sites(sites: DataFrame) -> DataFrame:
    return sites.where(~F.col("id").startswith(FIXTURE_PREFIX))


def public_points(sites: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per placed site: coordinates to two decimals, size tier instead of
    power, letters, and whether the best letter was held back."""
    at = F.col("identity.coordinates")
    s = sites.where(at.lat.isNotNull() & at.lon.isNotNull())
    s = s.select("id", F.col("identity.name").alias("name"), F.col("identity.country").alias("country"), F.col("identity.project_status").alias("project_status"), F.round(at.lat, 2).alias("lat"), F.round(at.lon, 2).alias("lon"), size_tier(F.col("identity.power_mw")).alias("size_tier"))
    return s.join(scores, "id")


def with_journal_fields(scores: DataFrame, version: str) -> DataFrame:
    """The core of a journal entry, by which states are compared."""
    return scores.select("id", F.struct(F.lit(version).alias("methodology_version"), F.struct(F.col("site_grade").alias("site"), F.col("process_grade").alias("project_process")).alias("grades"), F.col("confidence").alias("confidence")).alias("core"))


def unrecorded_changes(sites: DataFrame, now: DataFrame) -> DataFrame:
    """(id, recorded, core): sites whose last journal entry is not the present state."""
    last = F.element_at("score_history", -1)
    rec = sites.select("id", F.when(F.size("score_history") > 0, F.struct(last.methodology_version.alias("methodology_version"), last.grades.alias("grades"), last.confidence.alias("confidence"))).alias("recorded"))
    return rec.join(now, "id").where(~F.col("recorded").eqNullSafe(F.col("core")))


def masked(scores: DataFrame, hidden: Column, grades: list[str], values: list[str], sentinel: str = "pending") -> DataFrame:
    out = scores
    for g in grades:
        out = out.withColumn(g, F.when(hidden, F.lit(sentinel)).otherwise(F.col(g)))
    for v in values:
        out = out.withColumn(v, F.when(~hidden, F.col(v)))
    return out


def summary(sites: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per site for lists and rankings."""
    i = F.col("identity")
    own = ("name", "operator", "municipality", "country", "project_status", "power_mw", "power_mw_status")
    s = sites.select("id", *[i[c].alias(c) for c in own], i["vintage"]["expected_commissioning"].alias("expected_commissioning"), F.col("publication.status").alias("publication_status"))
    return s.join(scores, "id")


def history(sites: DataFrame) -> DataFrame:
    """Every journal entry with its site and its place in the journal."""
    e = sites.select(F.col("id").alias("dc_id"), F.col("identity.name").alias("dc_name"), F.posexplode("score_history").alias("seq", "_e"))
    return e.select("dc_id", "dc_name", "seq", "_e.*")


def details(facts: DataFrame, defs: DataFrame) -> DataFrame:
    """The indicators of each site with their labels; ``defs`` (indicator_id, label,
    pillar, block) says which ones are shown."""
    return facts.join(F.broadcast(defs), "indicator_id")  # defs: one row per indicator of the methodology


def watch_features(entries: DataFrame) -> DataFrame:
    """The placed watchlist entries, coordinates to two decimals, with the kinds of their facts."""
    at = F.col("coordinates")
    kinds = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce("facts", F.array().cast(entries.schema["facts"].dataType)), lambda f: f["kind"]))))
    return entries.where(at.lat.isNotNull() & at.lon.isNotNull()).select("id", "name", "operator", "municipality", "country", "project_status", F.round(at.lat, 2).alias("lat"), F.round(at.lon, 2).alias("lon"), kinds.alias("kinds"))


def graded_pillars(pillars: Column) -> Column:
    """How many pillars have a letter."""
    return F.coalesce(F.size(F.map_filter(pillars, lambda k, v: v.isNotNull() & (v != "insufficient_data"))), F.lit(0))


def ordinary(sites: DataFrame, watched: DataFrame, most: int = 25, least_pillars: int = 4, near_deg: float = 0.05) -> DataFrame:
    """(id, score, gap): the sites closest to the median of all scores that nothing
    speaks against. ``sites``: id, score, operating, pillars, contested, lat, lon;
    ``watched``: lat, lon. A site without a place has nothing near it."""
    mid = medians(sites, "score").select(F.round("median", 1).alias("mid"))
    good = sites.where(F.col("score").isNotNull() & F.col("operating") & ~F.coalesce("contested", F.lit(False)) & (F.col("pillars") >= least_pillars))
    placed = good.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    alone = spatial.outside_boxes(placed.select("id", "lat", "lon"), watched.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), near_deg).select("id")
    rest = good.where(F.col("lat").isNull() | F.col("lon").isNull()).select("id").unionByName(alone)
    gaps = good.select("id", "score").join(rest, "id").crossJoin(F.broadcast(mid)).withColumn("gap", F.round(F.abs(F.col("score") - F.col("mid")), 2))  # one row
    return gaps.orderBy(F.abs(F.col("score") - F.col("mid")), "id").limit(most).select("id", "score", "gap")


def wall(scored: DataFrame, most: int = 90) -> DataFrame:
    """Scored sites dealt out by letter and country in turns."""
    return ranking.round_robin(scored, "grade", "country", "id", most)


def build(sites: DataFrame, facts: DataFrame, defs: DataFrame, scores: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """All artifacts by name. Made-up records are in none of the public ones."""
    real = real_sites(sites)
    at = F.col("identity.coordinates")
    own = real.select("id", (F.col("identity.project_status") == "operational").alias("operating"), F.col("identity.country").alias("country"), (F.size("contestation") > 0).alias("contested"), at.lat.alias("lat"), at.lon.alias("lon")).join(
        scores.select("id", F.col("site_score").alias("score"), F.col("site_grade").alias("grade"), graded_pillars(F.col("pillars")).alias("pillars")), "id"
    )
    watched = entries.select(F.col("coordinates.lat").alias("lat"), F.col("coordinates.lon").alias("lon"))
    return {
        "scores": summary(real, scores), "map": public_points(real, scores.select("id", "site_grade")), "details": details(facts, defs), "audit": history(real), "watchlist": watch_features(entries),
        "ordinary": ordinary(own, watched), "wall": wall(own.where("score is not null")),
    }


def write(artifacts: dict[str, DataFrame], path: str, single: Sequence[str] = ("details",)) -> None:
    """Every artifact in its folder; those of single sites partitioned by country of
    their ids, so that one site's rows are found without reading all."""
    for name, df in artifacts.items():
        out = df.withColumn("part", F.substring("site_id", 1, 2)) if name in single and "site_id" in df.columns else df
        w = out.write.mode("overwrite")
        (w.partitionBy("part") if "part" in out.columns else w).json(f"{path}/{name}")
