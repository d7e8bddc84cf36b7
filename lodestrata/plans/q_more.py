"""Queries on records: matching, patching, showing, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import artifacts, nearby, records
from lodestrata.plans.core_problems import _PLACED
from lodestrata.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query("""SELECT DISTINCT id, coalesce(nullif(trim(operator), ''), nullif(trim(municipality), '')) AS value, CASE WHEN nullif(trim(operator), '') IS NOT NULL THEN 'first' WHEN nullif(trim(municipality), '') IS NOT NULL THEN 'second' END AS origin,
    nullif(trim(operator), '') = nullif(trim(municipality), '') AS agrees FROM scores""")
def first_known_source(spark: SparkSession, d: str) -> DataFrame:
    own = lambda c: F.nullif(F.trim(c), F.lit(""))
    value, origin, agrees = records.first_known(own("operator"), own("municipality"))
    return table(spark, d, "scores").select("id", value.alias("value"), origin.alias("origin"), agrees.alias("agrees")).distinct()


_CENTRES = "SELECT zone_no, avg(p.lat) AS lat, avg(p.lon) AS lon FROM (SELECT zone_no, unnest(ring) AS p FROM zones) GROUP BY zone_no"


@query(f"""WITH w AS ({_PLACED.format(rows="SELECT watch_no AS id, coordinates.lat AS lat, coordinates.lon AS lon, received_at AS newest FROM watchlist")}),
    e AS (SELECT zone_no, ring[i].lon AS xa, ring[i].lat AS ya, ring[1 + i % len(ring)].lon AS xb, ring[1 + i % len(ring)].lat AS yb FROM zones, LATERAL (SELECT unnest(range(1, len(ring) + 1)) AS i)),
    inside AS (SELECT id, min(zone_no) AS z FROM (SELECT w.id, e.zone_no FROM w JOIN e ON (least(xa, xb) <= w.lon AND w.lon < greatest(xa, xb)) AND ya + (w.lon - xa) * (yb - ya) / (xb - xa) > w.lat GROUP BY w.id, e.zone_no HAVING count(*) % 2 = 1) GROUP BY id),
    c AS ({_CENTRES}),
    near AS (SELECT w.id, min_by(c.zone_no, (round(2 * asin(sqrt(least(1.0, pow(sin(radians(c.lat - w.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(w.lat)) * pow(sin(radians(c.lon - w.lon) / 2), 2)))), 12), c.zone_no)) AS z FROM w, c GROUP BY w.id)
    SELECT w.id AS watch_no, coalesce(i.z, n.z) AS zone_no, i.z IS NOT NULL AS exact FROM w LEFT JOIN inside i USING (id) JOIN near n USING (id)""")
def region_or_nearest(spark: SparkSession, d: str) -> DataFrame:
    zones = table(spark, d, "zones")
    points = nearby.placed(table(spark, d, "watchlist"), "watch_no", "coordinates.lat", "coordinates.lon", "received_at")
    centres = zones.select("zone_no", F.explode("ring").alias("p")).groupBy(F.col("zone_no").alias("id")).agg(F.avg("p.lat").alias("lat"), F.avg("p.lon").alias("lon"))
    return records.region_or_nearest(points, nearby.ring_edges(zones, "zone_no", "ring"), centres).select(F.col("id").alias("watch_no"), F.col("region").alias("zone_no"), "exact")


@query("""WITH c AS (SELECT o_custkey AS k, o_orderpriority AS p, min(o_orderdate) AS t FROM orders GROUP BY ALL)
    SELECT c_custkey, array_to_string(list_concat([c_mktsegment], coalesce((SELECT list(p ORDER BY t, p) FROM c WHERE k = c_custkey AND p <> c_mktsegment), [])), ',') AS labels FROM customer""")
def array_append(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select("c_custkey", F.array("c_mktsegment").alias("labels"))
    more = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("p")).agg(F.min("o_orderdate").alias("t"))
    return records.appended(base, more, "c_custkey", "labels", "p", "t").select("c_custkey", F.array_join("labels", ",").alias("labels"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value, CASE WHEN event_type = 'error' THEN 'void' ELSE event_type END AS event_type FROM events")
def update_where(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("event_type") == "error"
    return records.updated(table(spark, d, "events").select("event_id", "value", "event_type"), hit, {"value": F.lit(0.0), "event_type": F.lit("void")})


@query("""WITH b AS (SELECT c_nationkey AS n, c_mktsegment AS s, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY ALL), m AS (SELECT n, s, round(v - avg(v) OVER (PARTITION BY n), 2) AS v FROM b)
    SELECT n AS n_nationkey, min_by(s, (-v, s)) FILTER (v > 0) AS bonus, min_by(s, (v, s)) FILTER (v < 0) AS friction FROM m GROUP BY n""")
def strongest_story(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    mean = b.groupBy("n_nationkey").agg(F.avg("v").alias("m"))
    return records.strongest(b.join(mean, "n_nationkey").withColumn("v", F.round(F.col("v") - F.col("m"), 2)), "n_nationkey", "c_mktsegment", "v")


@query("SELECT id, name, power_mw FROM (SELECT DISTINCT id, name, operator, power_mw, updated_at FROM scores WHERE project_status = 'operational') WHERE contains(translate(lower(operator), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'reseaux') OR contains(translate(lower(name), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'reseaux')")
def search_shown(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scores").select("id", "name", "operator", "power_mw", "updated_at", "project_status").distinct()
    return records.shown(s, "power_mw", "id", "Réseaux", ["operator", "name"], F.col("project_status") == "operational").select("id", "name", "power_mw")


@query("""WITH g AS (SELECT o_orderpriority AS label, 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) AS s FROM orders GROUP BY ALL), r AS (SELECT label, round(CASE WHEN label IN ('1-URGENT', '5-LOW') THEN 100 - s ELSE s END, 4) AS share FROM g)
    SELECT label, share, row_number() OVER (ORDER BY share DESC, label) AS position FROM r""")
def shares_ranked(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg((100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("share"))
    return records.ranked_shares(g, "label", "share", ["1-URGENT", "5-LOW"])


@query("SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_nationkey) AS items FROM nation GROUP BY n_regionkey")
def grouped_items(spark: SparkSession, d: str) -> DataFrame:
    return records.grouped(table(spark, d, "nation").withColumnRenamed("n_regionkey", "region"), "region", "n_name", ["n_nationkey"])


_HALF = "SELECT country, count(*) >= 20 AS eligible, max(grades.site.grade) AS grade, bool_or(power_mw_status = 'measured') AS reserved FROM (SELECT DISTINCT id, country, grades, power_mw_status, updated_at FROM scores) WHERE {} GROUP BY country"
_CUT = "(SELECT min(updated_at) + INTERVAL 20 DAY FROM scores)"


@query(f"""WITH o AS ({_HALF.format("updated_at <= " + _CUT)}), n AS ({_HALF.format("true")})
    SELECT n.country, CASE WHEN o.country IS NULL THEN 'new_country' WHEN n.eligible IS DISTINCT FROM o.eligible THEN 'eligibility_change' WHEN n.grade IS DISTINCT FROM o.grade THEN 'grade_change' ELSE 'reserve_change' END AS event
    FROM n LEFT JOIN o USING (country) WHERE o.country IS NULL OR (n.eligible, n.grade, n.reserved) IS DISTINCT FROM (o.eligible, o.grade, o.reserved)""")
def state_change_events(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scores").select("id", "country", "grades", "power_mw_status", "updated_at").distinct()
    middle = s.agg((F.min("updated_at") + F.expr("interval 20 days")).alias("cut"))
    state = lambda df: df.groupBy("country").agg((F.count("*") >= 20).alias("eligible"), F.max("grades.site.grade").alias("grade"), F.bool_or(F.col("power_mw_status") == "measured").alias("reserved"))
    before = s.crossJoin(F.broadcast(middle)).where("updated_at <= cut")  # one row
    return records.state_changes(state(before), state(s), "country", [("eligible", "eligibility_change"), ("grade", "grade_change"), ("reserved", "reserve_change")], "new_country")


_PLAIN = "trim(regexp_replace(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT doc_id, ' ' || {_PLAIN.format("text")} || ' ' AS t FROM documents WHERE regexp_matches(text, 'MW')), p AS (SELECT DISTINCT municipality AS place, {_PLAIN.format("municipality")} AS n FROM scores WHERE municipality IS NOT NULL),
    q AS (SELECT place, n FROM p WHERE n <> '' AND len(string_split(n, ' ')) >= 1)
    SELECT doc_id, min_by(place, (instr(t, ' ' || n || ' '), -len(string_split(n, ' ')), place)) AS place FROM t JOIN q ON contains(t, ' ' || n || ' ') GROUP BY doc_id""")
def first_place_mentioned(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "scores").where("municipality is not null").select("municipality").distinct()
    return records.first_mention(table(spark, d, "documents"), "doc_id", "text", places, "municipality", "MW")


@query("""WITH r AS (SELECT country || '/' || lower(name) AS k, watch_no, name, source.url AS url, municipality FROM watchlist WHERE country IS NOT NULL AND name IS NOT NULL), f AS (SELECT k, url, min(watch_no) AS f FROM r WHERE url IS NOT NULL GROUP BY ALL)
    SELECT k AS merge_key, min(watch_no) AS watch_no, arg_min(name, watch_no) AS name, coalesce((SELECT string_agg(url, ';' ORDER BY f, url) FROM f WHERE f.k = r.k), '') AS sources,
    coalesce((SELECT string_agg(url, ';' ORDER BY f, url) FROM f WHERE f.k = r.k AND url <> (SELECT arg_min(url, (f, url)) FROM f g WHERE g.k = r.k)), '') AS also_in, arg_min(municipality, watch_no) FILTER (municipality IS NOT NULL) AS municipality FROM r GROUP BY k""")
def merge_in_order(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "watchlist").select("watch_no", "name", "country", "municipality", F.col("source.url").alias("url"))
    return records.merged_in_order(w, F.concat("country", F.lit("/"), F.lower("name")), ["watch_no"], "url", ["watch_no", "name"], "municipality")


def _hmac_sql(secret: bytes, column: str) -> str:
    key = secret.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({column}))))"


@query(f"SELECT DISTINCT id, {_hmac_sql(b'a public example', 'id')} AS token FROM scores WHERE id IS NOT NULL")
def keyed_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scores").where("id is not null").select("id", records.keyed_hash(F.col("id"), b"a public example").alias("token")).distinct()


_SITES = "SELECT id, max(grades.site.score) AS score, bool_or(project_status = 'operational') AS operating, max(name) AS name FROM scores WHERE id IS NOT NULL GROUP BY id"


@query(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM ({_SITES})), p AS (SELECT watch_no, coordinates.lat AS lat, coordinates.lon AS lon FROM watchlist), k AS (SELECT site_id AS id, count(DISTINCT indicator_id) FILTER (status = 'measured') AS pillars, bool_or(status = 'not_collected' AND indicator_id = 'T2') AS contested FROM indicators GROUP BY site_id),
    a AS (SELECT s.id, s.score, s.operating, coalesce(k.pillars, 0) AS pillars, k.contested, y.lat, y.lon FROM s LEFT JOIN k USING (id) LEFT JOIN (SELECT id, min(lat) AS lat, min(lon) AS lon FROM (SELECT 's' || site_no AS id, lat, lon FROM sample_sites) GROUP BY id) y ON y.id = s.id),
    g AS (SELECT a.id, a.score, abs(a.score - round((SELECT median(score) FROM a), 1)) AS gap FROM a WHERE score IS NOT NULL AND operating AND NOT coalesce(contested, false) AND pillars >= 4)
    SELECT id, score, round(gap, 2) AS gap FROM g ORDER BY gap, id LIMIT 25""")
def showcase_ordinary(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scores").where("id is not null").groupBy("id").agg(F.max("grades.site.score").alias("score"), F.bool_or(F.col("project_status") == "operational").alias("operating"))
    k = table(spark, d, "indicators").groupBy(F.col("site_id").alias("id")).agg(F.count_distinct(F.when(F.col("status") == "measured", F.col("indicator_id"))).alias("pillars"), F.bool_or((F.col("status") == "not_collected") & (F.col("indicator_id") == "T2")).alias("contested"))
    none = F.lit(None).cast("double")
    sites = s.join(k, "id", "left").withColumns({"pillars": F.coalesce("pillars", F.lit(0)), "lat": none, "lon": none})
    return artifacts.ordinary(sites, table(spark, d, "watchlist").select("coordinates.lat", "coordinates.lon"))


@query("SELECT dc_id, dc_name, row_number() OVER (PARTITION BY dc_id ORDER BY audit_no) - 1 AS seq, event FROM (SELECT dc_id, any_value(dc_name) OVER (PARTITION BY dc_id ORDER BY audit_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dc_name, audit_no, event FROM audit WHERE dc_id IS NOT NULL)")
def audit_history(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit").where("dc_id is not null")
    rows = F.array_sort(F.collect_list(F.struct("audit_no", "event")))
    name = F.min_by("dc_name", F.when(F.col("dc_name").isNotNull(), F.col("audit_no")))
    s = a.groupBy(F.col("dc_id").alias("id")).agg(F.struct(name.alias("name")).alias("identity"), rows.alias("score_history"))
    return artifacts.history(s).select("dc_id", "dc_name", "seq", "event")


@query("""SELECT watch_no, round(coordinates.lat, 2) AS lat, round(coordinates.lon, 2) AS lon, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(facts, lambda f: f.kind), lambda k: k IS NOT NULL))), ','), '') AS kinds
    FROM watchlist WHERE coordinates.lat IS NOT NULL AND coordinates.lon IS NOT NULL""")
def watch_map(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "watchlist").withColumn("id", F.col("watch_no"))
    return artifacts.watch_features(w).select(F.col("id").alias("watch_no"), "lat", "lon", F.array_join("kinds", ",").alias("kinds"))
