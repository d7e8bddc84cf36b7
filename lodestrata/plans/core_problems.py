"""Queries of the three general problems: p3 (places), p4 (history), p5 (nesting)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import history, nearby, nested
from lodestrata.runtime import cut, shared_path, table

NEAR_M = 2000.0


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites within 2 km of each watchlist entry, and the zones that contain it."""
    watch, sites = table(spark, sf_dir, "watchlist"), table(spark, sf_dir, "sample_sites")
    entries = nearby.placed(watch, "watch_no", "coordinates.lat", "coordinates.lon", "received_at")
    places = nearby.placed(sites, "site_no", "lat", "lon", "loaded_at")
    close = nearby.points_within(
        entries, places, NEAR_M,
        query_sample=(watch.select("coordinates.lat", "coordinates.lon"), watch.count()),
        candidate_sample=(sites.select("lat", "lon"), sites.count()),
    )
    edges = nearby.ring_edges(table(spark, sf_dir, "zones"), "zone_no", "ring")
    inside = nearby.points_in_regions(entries, edges)
    return close.select(F.col("query_id").alias("watch_no"), F.lit("site").alias("other"), F.col("candidate_id").alias("other_no")).unionByName(
        inside.select(F.col("id").alias("watch_no"), F.lit("zone").alias("other"), F.col("region").alias("other_no"))
    )


AUDIT_SATELLITES = {"method": ["methodology_version"], "grade": ["site_grade"]}


def audit_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.observations(
        table(spark, sf_dir, "audit"),
        key=F.col("dc_id"),
        day=history.day_of(F.col("date")),
        recorded=F.col("recorded_at"),
        attributes={"methodology_version": history.version_text(F.col("methodology_version")), "site_grade": history.grade_text(F.col("grades.site"))},
        required=["site_grade"],
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of each site's methodology and site grade, from satellites split by
    the rates at which they change."""
    obs = cut(audit_observations(spark, sf_dir), "observations", by=["key"])
    sats = history.satellites(obs, history.split_by_rate(obs, ["methodology_version", "site_grade"]))
    return history.as_text(history.versions(sats), "dc_id")


def p4_satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The satellite rows themselves, with their values."""
    sats = history.satellites(audit_observations(spark, sf_dir), AUDIT_SATELLITES)
    return sats.select("satellite", F.col("key").alias("dc_id"), F.date_format("day", "yyyy-MM-dd").alias("valid_from"), "hash_diff", F.concat_ws("|", F.map_values("payload")).alias("values"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named leaves of the indicators and facts in the raw payloads: written by tag,
    read as typed tables."""
    path = shared_path(spark, "nested")
    nested.write_tables(nested.tagged(table(spark, sf_dir, "raw_records"), "record_no", "payload"), path)
    rows = nested.read_tables(spark, path)
    wanted = {
        "indicator_proxies": ("indicator", ["public_inquiry_held"]),
        "indicator_source": ("indicator", ["archived_url"]),
        "fact": ("fact", ["kind"]),
        "fact_source": ("fact", ["url"]),
    }
    return nested.leaves(rows, wanted).distinct()


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each flat table has, how many are roots, and how many of their keys differ."""
    rows = nested.tagged(table(spark, sf_dir, "raw_records"), "record_no", "payload")
    # keys are counted by their records, each of which lies in one task
    own = rows.groupBy("tag", "record_no").agg(F.count("*").alias("n"), F.count_if(F.col("parent_key").isNull()).alias("roots"), F.size(F.collect_set("row_key")).alias("keys"))
    return own.groupBy("tag").agg(F.sum("n").alias("n_rows"), F.sum("roots").alias("n_roots"), F.sum("keys").alias("n_keys"))


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p4_satellites, p5_found, p5_tables)}

_PLACED = """
    SELECT id, arg_max(lat, (newest, lat, lon)) AS lat, arg_max(lon, (newest, lat, lon)) AS lon FROM ({rows})
    WHERE id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)
      AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)
    GROUP BY id
"""
_AUDIT_OBS = r"""
    d AS (SELECT dc_id, audit_no, recorded_at,
                 regexp_extract(date, '^\s*(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})', ['y', 'm', 'd']) AS p,
                 nullif(regexp_replace(lower(trim(methodology_version)), '^v\.?\s*', ''), '') AS version,
                 nullif(upper(trim(grades.site)), '') AS grade
          FROM audit WHERE date IS NOT NULL AND dc_id IS NOT NULL),
    o AS (SELECT dc_id, try_cast(p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') AS DATE) AS day,
                 arg_max({{'v': version, 'g': grade}}, (recorded_at, coalesce(version, ''), grade)) AS s
          FROM d WHERE grade IS NOT NULL GROUP BY ALL HAVING day IS NOT NULL),
    l AS (SELECT dc_id, day, s.v AS v, s.g AS g, row_number() OVER w AS n, lag(s.v) OVER w AS pv, lag(s.g) OVER w AS pg
          FROM o WINDOW w AS (PARTITION BY dc_id ORDER BY day))
""".replace("{{", "{").replace("}}", "}")

ORACLE = {
    "p3_found": f"""
        WITH w AS ({_PLACED.format(rows="SELECT watch_no AS id, coordinates.lat AS lat, coordinates.lon AS lon, received_at AS newest FROM watchlist")}),
             s AS ({_PLACED.format(rows="SELECT site_no AS id, lat, lon, loaded_at AS newest FROM sample_sites")}),
             e AS (SELECT zone_no, ring[i].lon AS xa, ring[i].lat AS ya, ring[1 + i % len(ring)].lon AS xb, ring[1 + i % len(ring)].lat AS yb
                   FROM zones, LATERAL (SELECT unnest(range(1, len(ring) + 1)) AS i)),
             inside AS (SELECT w.id, e.zone_no FROM w JOIN e ON (least(xa, xb) <= w.lon AND w.lon < greatest(xa, xb))
                        AND ya + (w.lon - xa) * (yb - ya) / (xb - xa) > w.lat
                        GROUP BY w.id, e.zone_no HAVING count(*) % 2 = 1)
        SELECT w.id AS watch_no, 'site' AS other, s.id AS other_no FROM w JOIN s ON s.lat BETWEEN w.lat - 0.0181 AND w.lat + 0.0181
            AND 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - w.lat) / 2), 2)
                + cos(radians(s.lat)) * cos(radians(w.lat)) * pow(sin(radians(s.lon - w.lon) / 2), 2)))) <= 2000
        UNION ALL SELECT id, 'zone', zone_no FROM inside
    """,
    "p4_found": f"""
        WITH {_AUDIT_OBS}
        SELECT dc_id, strftime(day, '%Y-%m-%d') AS valid_from,
               coalesce(strftime(lead(day) OVER (PARTITION BY dc_id ORDER BY day), '%Y-%m-%d'), '9999-12-31') AS valid_to
        FROM l WHERE n = 1 OR v IS DISTINCT FROM pv OR g IS DISTINCT FROM pg
    """,
    "p4_satellites": f"""
        WITH {_AUDIT_OBS}
        SELECT 'method' AS satellite, dc_id, strftime(day, '%Y-%m-%d') AS valid_from,
               sha256(CASE WHEN v IS NULL THEN '-' ELSE '=' || v END) AS hash_diff, coalesce(v, '') AS values
        FROM l WHERE n = 1 OR v IS DISTINCT FROM pv
        UNION ALL
        SELECT 'grade', dc_id, strftime(day, '%Y-%m-%d'), sha256('=' || g), g FROM l WHERE n = 1 OR g IS DISTINCT FROM pg
    """,
}
