"""Queries on joins, merges, distances, windows and rankings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import geo, rules, text
from lodestrata.operators import nearby, ranking, spatial, tables
from lodestrata.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Joins


@query("SELECT l_orderkey, l_linenumber, p_brand, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 10")
def fact_dim_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, d, "lineitem").join(p, "l_partkey").select("l_orderkey", "l_linenumber", "p_brand", "l_quantity")


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey")
def left_join_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return tables.lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), n, ["c_nationkey"], {"n_name": "unknown"}).select("c_custkey", "n_name")


@query("SELECT id, name FROM (SELECT DISTINCT id, name FROM scores) s WHERE EXISTS (SELECT 1 FROM indicators i WHERE i.site_id = s.id AND contains(lower(i.source.title), 'registre'))")
def semi_join_keyword(spark: SparkSession, d: str) -> DataFrame:
    hit = table(spark, d, "indicators").where(F.lower("source.title").contains("registre")).select(F.col("site_id").alias("id"))
    return table(spark, d, "scores").select("id", "name").distinct().join(hit, "id", "left_semi")


@query("SELECT DISTINCT dc_id FROM audit WHERE dc_id NOT IN (SELECT id FROM scores WHERE id IS NOT NULL)")
def anti_join_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audit").select("dc_id").distinct().join(table(spark, d, "scores").select(F.col("id").alias("dc_id")), "dc_id", "left_anti")


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT id FROM scores) a FULL JOIN (SELECT DISTINCT dc_id AS id FROM audit) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def full_outer_diff(spark: SparkSession, d: str) -> DataFrame:
    return tables.set_difference(table(spark, d, "scores").select("id"), table(spark, d, "audit").select(F.col("dc_id").alias("id")), "id")


@query("""SELECT c_custkey, n_name, r_name, coalesce(o.o_orderpriority, 'none') AS first_priority FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
    LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def first_link_star_join(spark: SparkSession, d: str) -> DataFrame:
    first = tables.first_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], ["o_orderkey"]).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("first_priority"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(table(spark, d, "nation"), "n_nationkey")
    c = tables.lookup(c.withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, d, "region"), ["r_regionkey"])
    return tables.lookup(c, first, ["c_custkey"], {"first_priority": "none"}).select("c_custkey", "n_name", "r_name", "first_priority")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '([A-Z][a-z]+) am ', 1), lambda x: upper(x)))), ',') AS streets FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+ am ')")
def extract_translate_set(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("([A-Z][a-z]+) am "), 1)
    return table(spark, d, "documents").where(F.col("text").rlike("[A-Z][a-z]+ am ")).select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(found, F.upper))), ",").alias("streets"))


@query("SELECT source, string_agg(publisher, ',' ORDER BY publisher) AS publishers FROM (SELECT DISTINCT source, publisher FROM documents WHERE publisher IS NOT NULL) GROUP BY source")
def collect_sorted_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("publisher")), ",").alias("publishers"))


@query("SELECT feed, count(*) AS n, count(label) AS n_labelled FROM (SELECT 'order' AS feed, o_orderkey AS key, o_orderpriority AS label FROM orders UNION ALL SELECT 'customer', c_custkey, NULL FROM customer) GROUP BY feed")
def union_feeds(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.lit("order").alias("feed"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("label"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("feed"), F.col("c_custkey").alias("key"))
    return o.unionByName(c, allowMissingColumns=True).groupBy("feed").agg(F.count("*").alias("n"), F.count("label").alias("n_labelled"))


@query("""WITH r AS (SELECT watch_no, name, country, source.url AS url, country || '/' || CASE WHEN coordinates.lat IS NOT NULL AND coordinates.lon IS NOT NULL THEN round(coordinates.lat, 3)::VARCHAR || '/' || round(coordinates.lon, 3)::VARCHAR ELSE lower(name) END AS k FROM watchlist)
    SELECT min(watch_no) AS watch_no, arg_min(name, watch_no) AS name, string_agg(DISTINCT url, ';' ORDER BY url) AS sources, count(*) AS n_records FROM r WHERE k IS NOT NULL GROUP BY k""")
def merge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "watchlist").select("watch_no", "name", "country", F.col("source.url").alias("url"), F.round("coordinates.lat", 3).alias("lat"), F.round("coordinates.lon", 3).alias("lon"))
    place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat_ws("/", F.col("lat").cast("string"), F.col("lon").cast("string"))).otherwise(F.lower("name"))
    return tables.merge_sources(w, F.concat("country", F.lit("/"), place), ["watch_no"], "url", ["watch_no", "name"]).drop("merge_key")


@query("""SELECT k, coalesce(n.spent, b.c_acctbal) AS amount, CASE WHEN n.k IS NULL THEN b.c_mktsegment WHEN b.k IS NULL THEN 'unknown' WHEN b.c_mktsegment = 'BUILDING' THEN b.c_mktsegment ELSE n.standing END AS standing
    FROM (SELECT c_custkey AS k, c_acctbal, c_mktsegment FROM customer) b
    FULL JOIN (SELECT CAST(user_id AS BIGINT) AS k, round(sum(value), 2) AS spent, 'active' AS standing FROM events WHERE user_id IS NOT NULL GROUP BY user_id) n USING (k)""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("standing"))
    new = table(spark, d, "events").where("user_id is not null").groupBy(F.col("user_id").cast("bigint").alias("k")).agg(F.round(F.sum("value"), 2).alias("amount"), F.lit("active").alias("standing"))
    old, now = F.col("o_standing"), F.col("n_standing")
    standing = F.when(now.isNull(), old).when(old.isNull(), F.lit("unknown")).when(old == "BUILDING", old).otherwise(now)
    return tables.merged(base, new, "k", {"standing": standing}, ["amount"])


# Distances

_PLACE = "(({k} * 37 % 1800) / 10.0 - 90)::DOUBLE AS lat, (({k} * 91 % 3600) / 10.0 - 180)::DOUBLE AS lon"
_PTS = f"c AS (SELECT c_custkey AS id, {_PLACE.format(k='c_custkey')} FROM customer), s AS (SELECT s_suppkey AS id, s_acctbal, {_PLACE.format(k='s_suppkey')} FROM supplier)"
_DIST = "2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2))))"


def spots(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    k = F.col(key)
    return table(spark, d, name).withColumn("id", k).withColumn("lat", (F.pmod(k * 37, F.lit(1800)) / 10.0 - 90).cast("double")).withColumn("lon", (F.pmod(k * 91, F.lit(3600)) / 10.0 - 180).cast("double"))


def _both(spark, d):
    cols = ["id", "lat", "lon"]
    return spots(spark, d, "customer", "c_custkey").select(*cols), spots(spark, d, "supplier", "s_suppkey").select(*cols, "s_acctbal")


@query(f"WITH {_PTS} SELECT c.id AS c_custkey, s.id AS s_suppkey, round({_DIST} / 1000, 3) AS km FROM c JOIN s ON {_DIST} <= 500000")
def radius_join(spark: SparkSession, d: str) -> DataFrame:
    c, s = _both(spark, d)
    return nearby.points_within(c, s, 500_000.0).select(F.col("query_id").alias("c_custkey"), F.col("candidate_id").alias("s_suppkey"), F.round(F.col("metres") / 1000, 3).alias("km"))


@query(f"WITH {_PTS} SELECT c.id AS c_custkey, min(s.id) AS twin FROM c LEFT JOIN s ON {_DIST} <= 300000 GROUP BY c.id")
def radius_dedupe(spark: SparkSession, d: str) -> DataFrame:
    c, s = _both(spark, d)
    return spatial.distance_dedupe(c, s, 300_000.0).select(F.col("id").alias("c_custkey"), "twin")


@query(f"WITH {_PTS} SELECT c.id AS c_custkey FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE abs(s.lat - c.lat) < 5.05 AND abs(s.lon - c.lon) < 5.05)")
def box_anti_join(spark: SparkSession, d: str) -> DataFrame:
    c, s = _both(spark, d)
    return spatial.outside_boxes(c, s, 5.05).select(F.col("id").alias("c_custkey"))


@query(f"WITH {_PTS} SELECT c.id AS c_custkey, arg_min(s.id, (round({_DIST}, 3), s.id)) AS s_suppkey, round(min({_DIST}) / 1000, 3) AS km FROM c CROSS JOIN s GROUP BY c.id")
def nearest_neighbour(spark: SparkSession, d: str) -> DataFrame:
    c, s = _both(spark, d)
    return spatial.nearest(c, s.select("id", "lat", "lon")).select(F.col("query_id").alias("c_custkey"), F.col("candidate_id").alias("s_suppkey"), F.round(F.col("metres") / 1000, 3).alias("km"))


@query(f"WITH {_PTS}, p AS (SELECT * FROM s WHERE s_acctbal > 5000 OR NOT EXISTS (SELECT 1 FROM s WHERE s_acctbal > 5000)) SELECT c.id AS c_custkey, arg_min(s.id, (round({_DIST}, 3), s.id)) AS s_suppkey FROM c CROSS JOIN p s GROUP BY c.id")
def nearest_preferring(spark: SparkSession, d: str) -> DataFrame:
    c, s = _both(spark, d)
    good = s.where("s_acctbal > 5000")
    pool = s if good.isEmpty() else good
    return spatial.nearest(c, pool.select("id", "lat", "lon")).select(F.col("query_id").alias("c_custkey"), F.col("candidate_id").alias("s_suppkey"))


@query(f"WITH {_PTS} SELECT c.id AS c_custkey, CASE WHEN min({_DIST}) <= 100000 THEN 'overlap' WHEN min({_DIST}) <= 500000 THEN 'adjacent' WHEN min({_DIST}) <= 900000 THEN 'near' ELSE 'distant' END AS ring FROM c CROSS JOIN s GROUP BY c.id")
def ring_category(spark: SparkSession, d: str) -> DataFrame:
    c, s = _both(spark, d)
    r = spatial.rings(c, s, [100_000.0, 500_000.0, 900_000.0])
    return r.select(F.col("id").alias("c_custkey"), F.coalesce(F.get(F.array(F.lit("overlap"), F.lit("adjacent"), F.lit("near")), F.col("ring")), F.lit("distant")).alias("ring"))


@query(f"""WITH {_PTS}, m AS (SELECT c.id, s.id AS sid, (CASE WHEN {_DIST} <= 200000 THEN 0 WHEN {_DIST} <= 600000 THEN 1 ELSE 2 END) AS buf, s.id % 3 AS layer FROM c JOIN s ON {_DIST} <= 1200000 WHERE s.s_acctbal > 0)
    SELECT id AS c_custkey, arg_min(sid, (buf, layer, sid)) AS s_suppkey, min(buf)::INT AS buffer FROM m GROUP BY id""")
def escalating_match(spark: SparkSession, d: str) -> DataFrame:
    c, s = _both(spark, d)
    best = nearby.first_within(c, s.where("s_acctbal > 0").withColumn("layer", F.pmod("id", F.lit(3))), [200_000.0, 600_000.0, 1_200_000.0])
    return best.select(F.col("query_id").alias("c_custkey"), F.col("candidate_id").alias("s_suppkey"), F.col("ring").alias("buffer"))


@query(f"WITH {_PTS}, n AS (SELECT c.id, count(*) FILTER ({_DIST} <= 200000) AS a, count(*) FILTER ({_DIST} <= 500000) AS b FROM c CROSS JOIN s GROUP BY c.id) SELECT id AS c_custkey, a AS n_close, b AS n_near, CASE WHEN a > 0 THEN 'high' WHEN b > 0 THEN 'low' ELSE 'none' END AS hazard FROM n")
def hazard_band(spark: SparkSession, d: str) -> DataFrame:
    c, s = _both(spark, d)
    n = spatial.counts_within(c, s, [200_000.0, 500_000.0])
    return n.select(F.col("id").alias("c_custkey"), F.col("n_0").alias("n_close"), F.col("n_1").alias("n_near"), rules.ladder([(F.col("n_0") > 0, "high"), (F.col("n_1") > 0, "low")], "none").alias("hazard"))


@query(f"WITH {_PTS} SELECT s.id AS s_suppkey, round(2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(48.85 - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(48.85)) * pow(sin(radians(2.35 - s.lon) / 2), 2)))), 2) AS metres FROM s")
def haversine_expr(spark: SparkSession, d: str) -> DataFrame:
    return spots(spark, d, "supplier", "s_suppkey").select("s_suppkey", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(48.85), F.lit(2.35)), 2).alias("metres"))


@query(f"WITH {_PTS}, t AS (SELECT id, lon, radians(greatest(-85.05112878, least(85.05112878, lat))) AS a FROM s) SELECT id AS s_suppkey, round((lon + 180) / 360 * 65536, 3) AS x, round((1 - ln(tan(a) + 1 / cos(a)) / pi()) / 2 * 65536, 3) + 0.0 AS y FROM t")
def mercator_pixel(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.mercator_pixel(F.col("lat"), F.col("lon"), 8)
    return spots(spark, d, "supplier", "s_suppkey").select("s_suppkey", F.round(x, 3).alias("x"), (F.round(y, 3) + 0.0).alias("y"))


_E2 = 2 / 298.257222101 - (1 / 298.257222101) ** 2


def _q(s: str) -> str:
    return f"((1 - {_E2!r}) * ({s} / (1 - {_E2!r} * {s} * {s}) - ln((1 - sqrt({_E2!r}) * {s}) / (1 + sqrt({_E2!r}) * {s})) / (2 * sqrt({_E2!r}))))"


@query(f"""WITH k AS (SELECT {_q('1.0::DOUBLE')} AS qp, {_q('sin(radians(52.0))')} AS q0), g AS (SELECT qp, asin(q0 / qp) AS b0, 6378137.0 * sqrt(qp / 2) AS r FROM k),
    h AS (SELECT *, 6378137.0 * cos(radians(52.0)) / sqrt(1 - {_E2!r} * pow(sin(radians(52.0)), 2)) / (r * cos(b0)) AS dd FROM g),
    z AS (SELECT c_custkey, (c_custkey % 300) / 10.0 + 35 AS lat, (c_custkey * 7 % 400) / 10.0 - 10 AS lon FROM customer),
    y AS (SELECT c_custkey, asin({_q('sin(radians(lat))')} / qp) AS b, radians(lon - 10) AS o, b0, r, dd FROM z, h),
    x AS (SELECT *, r * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(o))) AS kk FROM y)
    SELECT c_custkey, round(4321000 + kk * dd * cos(b) * sin(o), 2) AS easting, round(3210000 + kk / dd * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(o)), 2) AS northing FROM x""")
def laea_projection(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    e, n = geo.laea(F.pmod(k, F.lit(300)) / 10.0 + 35, F.pmod(k * 7, F.lit(400)) / 10.0 - 10)
    return table(spark, d, "customer").select("c_custkey", F.round(e, 2).alias("easting"), F.round(n, 2).alias("northing"))


@query("SELECT watch_no, (coordinates.lat BETWEEN -30 AND 30 AND coordinates.lon BETWEEN -100 AND 100) AS inside FROM watchlist WHERE coordinates.lat IS NOT NULL AND coordinates.lon IS NOT NULL AND NOT isnan(coordinates.lat) AND NOT isnan(coordinates.lon)")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "watchlist").where("coordinates.lat is not null and coordinates.lon is not null and not isnan(coordinates.lat) and not isnan(coordinates.lon)")
    return w.select("watch_no", rules.in_box(F.col("coordinates.lat"), F.col("coordinates.lon"), (-30.0, 30.0, -100.0, 100.0)).alias("inside"))


@query("SELECT floor(lat / 10)::BIGINT AS cell_lat, floor(lon / 10)::BIGINT AS cell_lon, count(*) FILTER (project_status = 'operational') AS operational, count(*) FILTER (project_status = 'announced') AS announced, count(*) AS n FROM sample_sites WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 GROUP BY ALL")
def grid_cluster_pivot(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sample_sites").where("lat between -90 and 90 and lon between -180 and 180")
    return s.groupBy(F.floor(F.col("lat") / 10).alias("cell_lat"), F.floor(F.col("lon") / 10).alias("cell_lon")).agg(F.count_if(F.col("project_status") == "operational").alias("operational"), F.count_if(F.col("project_status") == "announced").alias("announced"), F.count("*").alias("n"))


@query("SELECT watch_no, round(coordinates.lon, 2) AS lon, round(coordinates.lat, 2) AS lat, coalesce(len(facts), 0) > 0 AS has_facts FROM watchlist WHERE coordinates.lat BETWEEN -90 AND 90 AND coordinates.lon BETWEEN -180 AND 180")
def point_flags(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "watchlist").where("coordinates.lat between -90 and 90 and coordinates.lon between -180 and 180")
    return w.select("watch_no", F.round("coordinates.lon", 2).alias("lon"), F.round("coordinates.lat", 2).alias("lat"), (F.coalesce(F.size("facts"), F.lit(0)) > 0).alias("has_facts"))


# Windows and rankings


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1 ORDER BY ts DESC, event_id LIMIT 2000")
def qualify_latest_limit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return tables.last_per_key(e, ["user_id"], ["ts", "event_id"]).orderBy(F.desc("ts"), "event_id").limit(2000).select("event_id", "user_id", "ts")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return tables.first_per_key(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT id, arg_max(project_status, updated_at) AS project_status, max(updated_at) AS updated_at FROM scores GROUP BY id")
def latest_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    return tables.last_per_key(table(spark, d, "scores").select("id", "updated_at", "project_status"), ["id"], ["updated_at", "project_status"]).select("id", "project_status", "updated_at")


@query("""WITH a AS (SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS rc FROM customer), b AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY rc, c_nationkey) AS rg FROM a)
    SELECT c_custkey, c_mktsegment, c_nationkey, rg::INT AS turn FROM b ORDER BY rg, c_mktsegment LIMIT 90""")
def round_robin_wall(spark: SparkSession, d: str) -> DataFrame:
    return ranking.round_robin(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_mktsegment", "c_nationkey", "c_custkey", 90)


@query("SELECT c_custkey, c_acctbal, round(abs(c_acctbal - m), 4) AS gap FROM customer, (SELECT round(median(c_acctbal), 1) AS m FROM customer) ORDER BY abs(c_acctbal - m), c_custkey LIMIT 25")
def closest_to_median(spark: SparkSession, d: str) -> DataFrame:
    return ranking.closest_to_median(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 25).select("c_custkey", "c_acctbal", F.round("gap", 4).alias("gap"))


@query("SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE r = n // 2 + 1")
def middle_row(spark: SparkSession, d: str) -> DataFrame:
    return ranking.middle_row(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey")


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_size = 7 AND p_retailprice > 1500 AND p_brand = 'Brand#99' THEN 3 WHEN p_size = 7 AND p_retailprice > 1500 THEN 2 WHEN p_size = 7 THEN 1 ELSE 0 END AS n_met FROM part)
    SELECT p_partkey, n_met FROM m WHERE n_met = (SELECT max(n_met) FROM m)""")
def relaxed_criteria(spark: SparkSession, d: str) -> DataFrame:
    return ranking.relaxed(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand"), [F.col("p_size") == 7, F.col("p_retailprice") > 1500, F.col("p_brand") == "Brand#99"]).select("p_partkey", "n_met")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def top_one_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(1)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


@query("SELECT n_nationkey, CASE WHEN up = 1 THEN 'best' WHEN down = 1 THEN 'worst' ELSE 'second_worst' END AS pick FROM (SELECT c_nationkey AS n_nationkey, row_number() OVER (ORDER BY round(avg(c_acctbal), 6) DESC, c_nationkey) AS up, row_number() OVER (ORDER BY round(avg(c_acctbal), 6), c_nationkey) AS down FROM customer GROUP BY c_nationkey) WHERE up = 1 OR down <= 2")
def top_bottom_pick(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.avg("c_acctbal"), 6).alias("m"))
    w = W.partitionBy(F.lit(0))  # one row per nation
    r = m.withColumn("up", F.row_number().over(w.orderBy(F.desc("m"), "n_nationkey"))).withColumn("down", F.row_number().over(w.orderBy("m", "n_nationkey")))
    return r.where("up = 1 or down <= 2").select("n_nationkey", rules.ladder([(F.col("up") == 1, "best"), (F.col("down") == 1, "worst")], "second_worst").alias("pick"))


@query("SELECT date, dc_id, audit_no FROM audit WHERE event = 'regrade' OR rationale IS NOT NULL ORDER BY date, dc_id, audit_no")
def audit_sort(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audit").where("event = 'regrade' or rationale is not null").select("date", "dc_id", "audit_no").orderBy("date", "dc_id", "audit_no")


@query("SELECT id, row_number() OVER (ORDER BY coalesce(score, -1) DESC, id) AS position FROM (SELECT id, max(grades.site.score) AS score, any_value(country) AS country FROM scores WHERE contains(lower(name), 'campus') GROUP BY id)")
def ranked_search(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scores").where(F.lower("name").contains("campus")).groupBy("id").agg(F.max("grades.site.score").alias("score"))
    return ranking.global_rank(s.withColumn("score", F.coalesce("score", F.lit(-1.0))), [F.desc("score"), F.col("id")]).select("id", "position")


@query("SELECT c_custkey, least(99, greatest(1, ceil(round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) * 100, 6))))::INT AS pct_at_or_below, least(99, greatest(1, ceil(round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) * 100, 6))))::INT AS pct_at_or_above FROM customer")
def percentile_label(spark: SparkSession, d: str) -> DataFrame:
    return ranking.percentile_labels(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", ["c_nationkey"]).select("c_custkey", "pct_at_or_below", "pct_at_or_above")


@query("""WITH s AS (SELECT s_suppkey, s_name, s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    k0 AS (SELECT a.s_suppkey, b.s_suppkey AS related, b.s_name AS o, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_name, b.s_suppkey) AS r FROM s a JOIN s b USING (s_nationkey) WHERE a.s_suppkey <> b.s_suppkey QUALIFY r <= 3),
    k1 AS (SELECT a.s_suppkey, b.s_suppkey AS related, b.s_name AS o, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_name, b.s_suppkey) AS r FROM s a JOIN s b USING (n_regionkey) WHERE a.s_suppkey <> b.s_suppkey AND (a.s_suppkey, b.s_suppkey) NOT IN (SELECT s_suppkey, related FROM k0) QUALIFY r <= 6),
    f AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY relation, o, related) AS position FROM (SELECT *, 0 AS relation FROM k0 UNION ALL SELECT *, 1 FROM k1)) SELECT s_suppkey, related, position, relation FROM f WHERE position <= 6""")
def related_quota(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    return ranking.related(s, "s_suppkey", [("s_nationkey", 3), ("n_regionkey", 6)], "s_name", 6)


@query("""WITH v AS (SELECT audit_no, dc_id, coalesce(grades.site, '') AS g, confidence AS c, lag(coalesce(grades.site, '')) OVER w AS pg, lag(confidence) OVER w AS pc, row_number() OVER w AS n FROM audit WINDOW w AS (PARTITION BY dc_id ORDER BY recorded_at, audit_no))
    SELECT audit_no, dc_id, CASE WHEN n = 1 THEN 'new' WHEN g IS DISTINCT FROM pg THEN 'g' ELSE 'c' END AS changed FROM v WHERE n = 1 OR g IS DISTINCT FROM pg OR c IS DISTINCT FROM pc""")
def change_events(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit").select("audit_no", "dc_id", "recorded_at", F.coalesce("grades.site", F.lit("")).alias("g"), F.col("confidence").alias("c"))
    return ranking.change_events(a, "dc_id", ["recorded_at", "audit_no"], ["g", "c"]).select("audit_no", "dc_id", "changed")


@query("""WITH l AS (SELECT dc_id, arg_max({'g': grades.site, 'n': audit_no}, (recorded_at, audit_no)) AS r FROM audit GROUP BY dc_id), s AS (SELECT id, arg_max({'g': grades.site.grade}, updated_at) AS r FROM scores GROUP BY id)
    SELECT id, l.r.g AS recorded, s.r.g AS now FROM s JOIN l ON dc_id = id WHERE l.r.g IS DISTINCT FROM s.r.g""")
def last_state_compare(spark: SparkSession, d: str) -> DataFrame:
    last = tables.last_per_key(table(spark, d, "audit").select("dc_id", "recorded_at", "audit_no", F.col("grades.site").alias("recorded")), ["dc_id"], ["recorded_at", "audit_no"])
    now = tables.last_per_key(table(spark, d, "scores").select("id", "updated_at", F.col("grades.site.grade").alias("now")), ["id"], ["updated_at", "now"])
    return now.join(last.withColumnRenamed("dc_id", "id"), "id").where(~F.col("recorded").eqNullSafe(F.col("now"))).select("id", "recorded", "now")


# Binding by words

_FOLD = "translate(lower(x), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def _toks(x: str, least: int) -> str:
    return f"list_filter(string_split(regexp_replace({_FOLD.replace('x', x, 1)}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= {least})"


_BIND = f"""w AS (SELECT watch_no, municipality AS m, {_toks('name', 5)} AS t FROM watchlist WHERE municipality IS NOT NULL), s AS (SELECT DISTINCT municipality AS m, power_mw, {_toks('name', 5)} AS t FROM scores),
    h AS (SELECT watch_no, round(power_mw, 1) AS mw FROM w JOIN s USING (m) WHERE list_has_any(list_filter(w.t, lambda v: NOT list_contains(['centre', 'donnees', 'center', 'centro', 'datos', 'campus', 'server', 'datacenter', 'rechenzentrum', 'digitale', 'numerique', 'projekt', 'project', 'projet', 'proyecto', 'building', 'batiment', 'phase', 'north', 'south'], v)), s.t))"""


@query(f"WITH {_BIND} SELECT watch_no, CASE WHEN count(DISTINCT mw) = 0 THEN 'absent' WHEN count(DISTINCT mw) = 1 THEN 'propose' ELSE 'ambiguous' END AS decision, CASE WHEN count(DISTINCT mw) = 1 THEN max(mw) END AS power_mw FROM w LEFT JOIN h USING (watch_no) GROUP BY watch_no")
def token_bind_decision(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.operators.binding import GENERIC, bind

    w = table(spark, d, "watchlist").select("watch_no", F.col("municipality").alias("m"), "name")
    s = table(spark, d, "scores").select(F.col("municipality").alias("m"), "name", F.round("power_mw", 1).alias("mw")).distinct()
    return bind(w, s, "watch_no", "m", "name", "mw", GENERIC).select("watch_no", "decision", F.col("value").alias("power_mw"))


@query(f"""WITH {_BIND}, o AS (SELECT DISTINCT operator, round(power_mw, 1) AS mw FROM scores WHERE operator IS NOT NULL), f AS (SELECT w.watch_no, mw FROM watchlist w JOIN o ON o.operator = w.operator)
    SELECT watch_no, CASE WHEN count(DISTINCT h.mw) = 1 THEN 'propose' WHEN count(DISTINCT h.mw) > 1 THEN 'ambiguous' WHEN count(DISTINCT f.mw) > 0 THEN 'ambiguous' WHEN count(f.watch_no) > 0 THEN 'withheld' ELSE 'absent' END AS decision FROM watchlist LEFT JOIN h USING (watch_no) LEFT JOIN f USING (watch_no) GROUP BY watch_no""")
def token_bind_fallback(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.operators.binding import GENERIC, bind_or_operator

    w = table(spark, d, "watchlist").select("watch_no", F.col("municipality").alias("m"), "name", "operator")
    s = table(spark, d, "scores").select(F.col("municipality").alias("m"), "name", "operator", F.round("power_mw", 1).alias("mw")).distinct()
    return bind_or_operator(w, s, "watch_no", "m", "name", "operator", "mw", GENERIC).select("watch_no", "decision")


_WORDS = "string_split(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'), ' ')"


@query(f"WITH t AS (SELECT doc_id, unnest(list_distinct({_WORDS})) AS w FROM documents), o AS (SELECT DISTINCT split_part(translate(lower(operator), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), ' ', 1) AS w FROM scores WHERE operator IS NOT NULL) SELECT doc_id, w AS word FROM t JOIN o USING (w) WHERE length(w) >= 6")
def word_match_join(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.regexp_replace(F.translate(F.lower("text"), text.ACCENTED, text.BARE), "[^a-z0-9]+", " "), " "))).alias("word")).where(F.length("word") >= 6)
    o = table(spark, d, "scores").where("operator is not null").select(F.get(F.split(F.translate(F.lower("operator"), text.ACCENTED, text.BARE), " "), F.lit(0)).alias("word")).distinct()
    return t.join(o, "word").select("doc_id", "word")
