"""Queries on statistics, texts, filters, gates and records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import rules, text
from lodestrata.operators import gates, scoring, stats, tables
from lodestrata.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Statistics

_IND = "i AS (SELECT DISTINCT row_no, site_id, indicator_id, status, value_num, substr(site_id, 1, 2) AS country FROM indicators)"


def indicators(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indicators").select("row_no", "site_id", "indicator_id", "status", "value_num", F.substring("site_id", 1, 2).alias("country")).distinct()


@query(f"""WITH {_IND}, p AS (SELECT indicator_id, country, count(*) FILTER (status IN ('measured', 'announced', 'verified')) AS a, count(*) FILTER (status IN ('measured', 'announced', 'verified') AND value_num > 50) AS pos, count(*) FILTER (status = 'missing') AS m, count(*) FILTER (coalesce(status = 'not_collected', true)) AS nc FROM i GROUP BY ALL)
    SELECT indicator_id, sum(a)::BIGINT AS n, sum(pos)::BIGINT AS n_positive, sum(m)::BIGINT AS excluded_missing, sum(nc)::BIGINT AS excluded_not_collected, string_agg(country, ',' ORDER BY country) AS wired, CASE WHEN sum(a) >= 5 THEN round(sum(pos) / sum(a), 4) END AS share FROM p WHERE a > 0 GROUP BY indicator_id""")
def wired_share(spark: SparkSession, d: str) -> DataFrame:
    return stats.wired_share(indicators(spark, d), "country", "status", F.col("value_num") > 50, ["indicator_id"])


_SC = "s AS (SELECT id, arg_max({'c': country, 'p': project_status, 'mw': power_mw, 'g': grades.site.score, 'd': confidence.score, 'l': confidence.level, 'ps': power_mw_status, 'm': municipality, 'pp': grades.project_process.grade, 'sg': grades.site.grade}, updated_at) AS r FROM scores GROUP BY id)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scores").select("id", "updated_at", F.col("country").alias("c"), F.col("project_status").alias("p"), F.col("power_mw").alias("mw"), F.col("grades.site.score").alias("g"), F.col("confidence.score").alias("d"), F.col("confidence.level").alias("l"), F.col("power_mw_status").alias("ps"), F.col("municipality").alias("m"), F.col("grades.project_process.grade").alias("pp"), F.col("grades.site.grade").alias("sg"))
    return tables.last_per_key(s, ["id"], ["updated_at"])


@query(f"WITH {_SC} SELECT r.p AS status, count(*) AS n, count(r.mw) AS n_disclosed, round(sum(r.mw), 2) AS total_mw, string_agg(DISTINCT r.c, ',' ORDER BY r.c) AS countries FROM s WHERE r.p IN ('announced', 'permitting', 'under_construction') GROUP BY r.p")
def pipeline_disclosure(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).where(F.col("p").isin("announced", "permitting", "under_construction"))
    return s.groupBy(F.col("p").alias("status")).agg(F.count("*").alias("n"), F.count("mw").alias("n_disclosed"), F.round(F.sum("mw"), 2).alias("total_mw"), F.array_join(F.array_sort(F.collect_set("c")), ",").alias("countries"))


@query(f"WITH {_SC} SELECT r.c AS country, count(*) AS n, count(r.mw) AS n_disclosed, round(sum(r.mw), 2) AS total, CASE WHEN count(*) >= 5 THEN round(count(r.mw) / count(*), 4) END AS share FROM s GROUP BY r.c")
def disclosure_share(spark: SparkSession, d: str) -> DataFrame:
    return stats.disclosure(scores(spark, d).withColumnRenamed("c", "country"), "mw", ["country"])


@query(f"WITH {_IND}, r AS (SELECT site_id, country, avg((status IN ('measured', 'announced'))::INT) AS ratio FROM i GROUP BY ALL) SELECT country, round(avg(ratio) * 100, 4) AS mean_pct FROM r GROUP BY country")
def mean_of_ratios(spark: SparkSession, d: str) -> DataFrame:
    per = indicators(spark, d).groupBy("site_id", "country").agg(F.avg(F.col("status").isin("measured", "announced").cast("int")).alias("r"))
    return per.groupBy("country").agg(F.round(F.avg("r") * 100, 4).alias("mean_pct"))


@query(f"WITH {_SC}, p AS (SELECT r, unnest(['all', 'c=' || r.c, 'p=' || r.p]) AS perimeter FROM s) SELECT perimeter, count(*) AS n, round(avg(r.g), 6) AS mean_score FROM p WHERE perimeter IS NOT NULL GROUP BY perimeter")
def perimeter_rollup(spark: SparkSession, d: str) -> DataFrame:
    return stats.perimeters(scores(spark, d), ["c", "p"]).groupBy("perimeter").agg(F.count("*").alias("n"), F.round(F.avg("g"), 6).alias("mean_score"))


@query(f"WITH {_IND} SELECT site_id, count(*) FILTER (indicator_id = 'W1' AND value_num > 50)::BIGINT + count(*) FILTER (indicator_id = 'E1' AND value_num > 50)::BIGINT + count(*) FILTER (indicator_id = 'L3' AND value_num > 50)::BIGINT AS frictions, max(value_num) FILTER (indicator_id = 'E1') AS e1, max(value_num) FILTER (indicator_id = 'W1') AS w1 FROM i GROUP BY site_id")
def friction_count(spark: SparkSession, d: str) -> DataFrame:
    high = F.col("value_num") > 50
    i = indicators(spark, d).groupBy("site_id")
    n = [F.count_if((F.col("indicator_id") == k) & high) for k in ("W1", "E1", "L3")]
    return i.agg((n[0] + n[1] + n[2]).alias("frictions"), F.max(F.when(F.col("indicator_id") == "E1", F.col("value_num"))).alias("e1"), F.max(F.when(F.col("indicator_id") == "W1", F.col("value_num"))).alias("w1"))


@query("WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS o FROM orders GROUP BY ALL) SELECT o_custkey, arg_min(o_orderpriority, (-n, o)) AS modal FROM n GROUP BY o_custkey")
def modal_value(spark: SparkSession, d: str) -> DataFrame:
    return stats.modal(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 4) AS pct FROM events GROUP BY event_type")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = e.agg(F.sum("n").alias("t"))
    return e.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(F.col("n") / F.col("t") * 100, 4).alias("pct"))


@query(f"WITH {_SC} SELECT id, r.sg AS site_grade, r.pp AS process_grade FROM s WHERE r.sg IN ('D', 'E') OR r.pp IN ('D', 'E')")
def exposure_list(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).where(F.col("sg").isin("D", "E") | F.col("pp").isin("D", "E")).select("id", F.col("sg").alias("site_grade"), F.col("pp").alias("process_grade"))


@query("SELECT greatest((SELECT max(updated_at) FROM scores), (SELECT max(recorded_at) FROM audit)) AS index_date, coalesce((SELECT max(recorded_at) FROM audit), (SELECT max(updated_at) FROM scores)) AS stats_date")
def corpus_date(spark: SparkSession, d: str) -> DataFrame:
    a, s = table(spark, d, "audit").agg(F.max("recorded_at").alias("a")), table(spark, d, "scores").agg(F.max("updated_at").alias("s"))
    return a.crossJoin(s).select(F.greatest("a", "s").alias("index_date"), F.coalesce("a", "s").alias("stats_date"))


@query(f"""WITH {_SC}, a AS (SELECT r.c AS country, count(r.g) AS n, round(avg(r.g), 1) AS mean, round(median(r.d), 3) AS doc, bool_or(r.ps = 'measured') AS v, count(*) FILTER (r.g IS NOT NULL AND r.mw > 0) AS nw,
        round(sum(r.g * r.mw) FILTER (r.g IS NOT NULL AND r.mw > 0) / sum(r.mw) FILTER (r.g IS NOT NULL AND r.mw > 0), 1) AS wm FROM s GROUP BY r.c),
    b AS (SELECT *, CASE WHEN mean >= 80 THEN 'A' WHEN mean >= 65 THEN 'B' WHEN mean >= 50 THEN 'C' WHEN mean >= 35 THEN 'D' WHEN mean >= 0 THEN 'E' END AS g FROM a)
    SELECT country, n, n >= 5 AS eligible, CASE WHEN n >= 5 THEN mean END AS mean, CASE WHEN n >= 5 THEN CASE WHEN g = 'A' AND NOT coalesce(v, false) THEN 'B' ELSE g END END AS grade,
        CASE WHEN n >= 5 THEN CASE WHEN doc >= 0.75 THEN 'solid' WHEN doc >= 0.5 THEN 'middling' ELSE 'weak' END END AS documentation, CASE WHEN n >= 5 AND nw >= 5 THEN wm END AS weighted_mean FROM b""")
def country_index(spark: SparkSession, d: str) -> DataFrame:
    return stats.index(scores(spark, d).withColumnRenamed("c", "country"), "country", "g", "mw", "d", F.col("ps") == "measured")


@query("SELECT c_nationkey, round(median(c_acctbal), 4) AS mid FROM customer GROUP BY c_nationkey")
def median_of_group(spark: SparkSession, d: str) -> DataFrame:
    return stats.medians(table(spark, d, "customer"), "c_acctbal", ["c_nationkey"]).select("c_nationkey", F.round("median", 4).alias("mid"))


@query("SELECT l_suppkey, CASE WHEN count(*) FILTER (l_quantity > 0) >= 5 THEN round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 3) END AS weighted FROM lineitem GROUP BY l_suppkey")
def value_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.when(F.count_if(q > 0) >= 5, F.round(scoring.weighted_mean(F.col("l_extendedprice"), q), 3)).alias("weighted"))


@query("WITH k AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS v FROM customer) SELECT c_custkey, round(coalesce(v, median(v) OVER (PARTITION BY c_nationkey)), 4) AS filled FROM k")
def median_backfill(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("v"))
    mid = stats.medians(k, "v", ["c_nationkey"], "mid")
    return tables.lookup(k, mid, ["c_nationkey"]).select("c_custkey", F.round(F.coalesce("v", "mid"), 4).alias("filled"))


@query(f"WITH {_IND} SELECT indicator_id, count(*) AS n_rows, count(DISTINCT site_id) AS n_sites, count(*) FILTER (status = 'measured') AS measured, count(*) FILTER (status = 'announced') AS announced, count(*) FILTER (status = 'estimated') AS estimated, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'not_collected') AS not_collected FROM i GROUP BY indicator_id")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    i = indicators(spark, d).groupBy("indicator_id")
    return i.agg(F.count("*").alias("n_rows"), F.countDistinct("site_id").alias("n_sites"), *[F.count_if(F.col("status") == s).alias(s) for s in ("measured", "announced", "estimated", "missing", "not_collected")])


@query("SELECT f.kind AS kind, country, count(*) AS n FROM (SELECT country, unnest(facts) AS f FROM watchlist) WHERE f.kind IS NOT NULL GROUP BY ALL")
def explode_tally(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "watchlist").select("country", F.explode("facts").alias("f")).where("f.kind is not null").groupBy(F.col("f.kind").alias("kind"), "country").agg(F.count("*").alias("n"))


@query("SELECT country, CASE WHEN count(*) FILTER (regexp_matches(lower(name), 'data ?center|datacenter|rechenzentrum|centre de donn')) * 2 >= count(*) THEN 'data' ELSE 'other' END AS class FROM (SELECT country, name, row_number() OVER (PARTITION BY country ORDER BY watch_no) AS r FROM watchlist) WHERE r <= 40 GROUP BY country")
def majority_class(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = table(spark, d, "watchlist").select("country", "name", F.row_number().over(W.partitionBy("country").orderBy("watch_no")).alias("r")).where("r <= 40")
    hit = F.lower("name").rlike("data ?center|datacenter|rechenzentrum|centre de donn")
    return w.groupBy("country").agg(F.when(F.count_if(hit) * 2 >= F.count("*"), "data").otherwise("other").alias("class"))


@query("SELECT l_suppkey, CASE WHEN count(DISTINCT l_partkey) < 400 THEN count(DISTINCT l_partkey) END AS n_parts FROM lineitem GROUP BY l_suppkey")
def capped_distinct_count(spark: SparkSession, d: str) -> DataFrame:
    n = F.countDistinct("l_partkey")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.when(n < 400, n).alias("n_parts"))


@query("WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders GROUP BY ALL), l AS (SELECT o_custkey, max(y) AS y, arg_max(s, y) AS s FROM y GROUP BY o_custkey) SELECT o_custkey, y::INT AS last_year, CASE WHEN s < 100000 THEN 'low' WHEN s <= 400000 THEN 'moderate' WHEN s <= 900000 THEN 'high' ELSE 'very_high' END AS band FROM l")
def latest_year_sum_band(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("s"))
    m = y.groupBy("o_custkey").agg(F.max("y").alias("last_year"), F.max_by("s", "y").alias("s"))
    return m.select("o_custkey", "last_year", rules.ladder([(F.col("s") < 100000, "low"), (F.col("s") <= 400000, "moderate"), (F.col("s") <= 900000, "high")], "very_high").alias("band"))


@query("SELECT event_type, round(avg(value), 6) AS mean, count(value) AS n FROM events WHERE ts >= date_trunc('month', TIMESTAMP '2024-01-25') - INTERVAL 11 MONTH AND ts < TIMESTAMP '2024-01-25' GROUP BY event_type")
def avg_window_trailing_year(spark: SparkSession, d: str) -> DataFrame:
    end = F.lit("2024-01-25").cast("timestamp")
    e = table(spark, d, "events").where((F.col("ts") >= F.add_months(F.trunc(end, "month"), -11)) & (F.col("ts") < end))
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts FROM events GROUP BY user_id")
def max_by_latest(spark: SparkSession, d: str) -> DataFrame:
    return tables.last_per_key(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("last_type"), F.col("ts").alias("last_ts"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderpriority) AS worst FROM orders GROUP BY o_custkey")
def max_by_rank(spark: SparkSession, d: str) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for kv in {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}.items() for x in kv])
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", rank[F.col("o_orderpriority")]).alias("worst"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity) / sum(sum(l_quantity)) OVER () * 100, 4) AS pct, round(100 - sum(l_quantity) / sum(sum(l_quantity)) OVER () * 100, 4) AS inverted FROM lineitem GROUP BY ALL")
def constraint_ranking(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    p = F.col("q") / F.col("t") * 100
    return g.crossJoin(F.broadcast(g.agg(F.sum("q").alias("t")))).select("l_returnflag", "l_linestatus", F.round(p, 4).alias("pct"), F.round(100 - p, 4).alias("inverted"))


# Flags, masks, updates


@query("""SELECT watch_no, CASE WHEN list_contains(k, 'moratorium') THEN 'moratorium' WHEN list_has_any(k, ['opposition', 'appeal', 'petition']) THEN 'opposition' ELSE 'announced_project' END AS marker
    FROM (SELECT watch_no, list_transform(coalesce(facts, []), lambda f: f.kind) AS k FROM watchlist)""")
def priority_kind(spark: SparkSession, d: str) -> DataFrame:
    k = F.coalesce(F.transform("facts", lambda f: f["kind"]), F.array().cast("array<string>"))
    has = lambda *v: F.coalesce(F.exists(k, lambda x: x.isin(*v)), F.lit(False))
    return table(spark, d, "watchlist").select("watch_no", rules.ladder([(has("moratorium"), "moratorium"), (has("opposition", "appeal", "petition"), "opposition")], "announced_project").alias("marker"))


@query("""SELECT watch_no, array_to_string(list_filter([CASE WHEN name IS NULL OR trim(name) = '' THEN 'no_name' END, CASE WHEN source.url IS NULL THEN 'no_source' END, CASE WHEN municipality IS NULL THEN 'no_place' END, CASE WHEN operator IS NULL THEN 'no_operator' END], lambda x: x IS NOT NULL), ',') AS flags,
    CASE WHEN name IS NULL OR trim(name) = '' OR source.url IS NULL THEN 'human' ELSE 'auto' END AS route FROM watchlist""")
def flags_and_route(spark: SparkSession, d: str) -> DataFrame:
    f = rules.flags([(F.col("name").isNull() | (F.trim("name") == ""), "no_name"), (F.col("source.url").isNull(), "no_source"), (F.col("municipality").isNull(), "no_place"), (F.col("operator").isNull(), "no_operator")])
    hard = F.array(F.lit("no_name"), F.lit("no_source"))
    return table(spark, d, "watchlist").select("watch_no", F.array_join(f, ",").alias("flags"), F.when(F.arrays_overlap(f, hard), "human").otherwise("auto").alias("route"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]+ (MW|megawatt|mégawatt)') THEN 'figure' WHEN regexp_matches(lower(text), 'server|serveur|servidor') THEN 'servers' ELSE 'none' END AS tier, regexp_extract(text, '([0-9]+) (MW|megawatt|mégawatt)', 1) AS figure FROM documents")
def regex_tier(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", rules.ladder([(t.rlike("[0-9]+ (MW|megawatt|mégawatt)"), "figure"), (F.lower(t).rlike("server|serveur|servidor"), "servers")], "none").alias("tier"), F.regexp_extract(t, "([0-9]+) (MW|megawatt|mégawatt)", 1).alias("figure"))


@query("SELECT DISTINCT id, CASE WHEN project_status = 'announced' THEN 'pending' ELSE grades.site.grade END AS grade, CASE WHEN project_status <> 'announced' THEN grades.site.score END AS score FROM scores")
def mask_columns(spark: SparkSession, d: str) -> DataFrame:
    hidden = F.col("project_status") == "announced"
    return table(spark, d, "scores").select("id", F.when(hidden, "pending").otherwise(F.col("grades.site.grade")).alias("grade"), F.when(~hidden, F.col("grades.site.score")).alias("score")).distinct()


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def conditional_update(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


# Filters and parsing


@query("SELECT count(*) AS n FROM (SELECT DISTINCT id FROM scores) WHERE NOT suffix(id, '0') AND NOT suffix(id, 'f')")
def filter_suffix_exclude(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scores").select("id").distinct()
    return s.where(~F.col("id").endswith("0") & ~F.col("id").endswith("f")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id FROM scores WHERE NOT starts_with(id, 'xa-')")
def filter_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scores").where(~F.col("id").startswith("xa-")).select("id").distinct()


@query("SELECT watch_no, f.kind AS kind, f.source.url AS url FROM (SELECT watch_no, unnest(facts) AS f FROM watchlist WHERE project_status = 'permitting') WHERE f IS NOT NULL")
def filter_explode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "watchlist").where("project_status = 'permitting'").select("watch_no", F.explode("facts").alias("f")).where("f is not null").select("watch_no", F.col("f.kind").alias("kind"), F.col("f.source.url").alias("url"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'server')")
def contains_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.lower("text").contains("server")).select("doc_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-30' GROUP BY event_type")
def partition_bounded_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("ts >= timestamp'2024-01-22' and ts < timestamp'2024-01-30'").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT row_no, try_cast(value_str AS DOUBLE) AS value FROM (SELECT DISTINCT row_no, value_str FROM indicators) WHERE try_cast(value_str AS DOUBLE) IS NOT NULL")
def try_cast_skip_bad(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indicators").select("row_no", "value_str").distinct().select("row_no", F.col("value_str").try_cast("double").alias("value")).where("value is not null")


@query("SELECT o_orderkey, o_totalprice AS value FROM orders WHERE o_totalprice <> 0")
def locale_number_parse(spark: SparkSession, d: str) -> DataFrame:
    typed = F.concat(F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" %"))
    return table(spark, d, "orders").select("o_orderkey", text.locale_number(typed).alias("value")).where("value is not null")


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: length(x) > 0), '|') AS parts FROM part")
def split_trim_array(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(text.split_list(F.replace("p_type", F.lit(" "), F.lit(" ; "))), "|").alias("parts"))


@query("SELECT name, min(code) AS code FROM (SELECT n_nationkey AS code, unnest([lower(n_name), 'n' || n_nationkey]) AS name FROM nation) GROUP BY name")
def explode_two_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.explode(F.array(F.lower("n_name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))).alias("name")).groupBy("name").agg(F.min("code").alias("code"))


@query("SELECT item_id, list_sum(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: x::BIGINT))::BIGINT AS total, len(regexp_extract_all(text, '[0-9]+'))::INT AS n FROM eval_items")
def regexp_extract_all_nums(spark: SparkSession, d: str) -> DataFrame:
    n = text.numbers(F.col("text"))
    return table(spark, d, "eval_items").select("item_id", F.reduce(n, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"), F.size(n).alias("n"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_field_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).where("k is not null")


_KEYS = "('id', 'kind', 'grade', 'grades', 'score', 'confidence', 'letter', 'note', 'documentation', 'url', 'archived_url')"


@query(f"""WITH r AS (SELECT CAST(record_no AS VARCHAR) AS entity, payload FROM raw_records WHERE CASE WHEN json_valid(payload) THEN true ELSE false END)
    SELECT entity, key, count(*) AS n FROM (SELECT r.entity, t.key FROM r, json_tree(r.payload) t WHERE t.key IN {_KEYS}) GROUP BY ALL""")
def recursive_key_scan(spark: SparkSession, d: str) -> DataFrame:
    """How often each key of a list stands in each record, at any depth."""
    found = gates.keys_of(table(spark, d, "raw_records"), "record_no", "payload", [k.strip(" '") for k in _KEYS.strip("()").split(",")])
    return found.groupBy("entity", "key").agg(F.count("*").alias("n"))


_MEASURED = "SELECT DISTINCT row_no, site_id, indicator_id, status, value_str, source.title AS title, source.url AS url FROM indicators"


@query(f"""SELECT DISTINCT 'power' AS gate, site_id AS entity, 'a measured figure rests on no register' AS message FROM ({_MEASURED})
    WHERE status = 'measured' AND regexp_extract(coalesce(title, ''), '(?i)puissance\\s+[\\d.]+\\s*MW\\s*\\(([^)]+)\\)', 1) <> '' AND NOT regexp_matches(regexp_extract(coalesce(title, ''), '(?i)puissance\\s+[\\d.]+\\s*MW\\s*\\(([^)]+)\\)', 1), '(?i)EED|RVO|registre r[ée]glementaire|regulatory register')""")
def gate_power_provenance(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "indicators")
    return gates.power_provenance(own.withColumn("indicator_id", F.lit("L2"))).distinct()


@query(f"""WITH i AS ({_MEASURED}), open AS (SELECT DISTINCT site_id FROM i WHERE indicator_id = 'T2' AND status = 'measured' AND value_str IN ('full_dossier_online', 'partial'))
    SELECT DISTINCT 'trace' AS gate, site_id AS entity, 'missing without a source although a dossier is open' AS message FROM i SEMI JOIN open USING (site_id) WHERE status = 'missing' AND url IS NULL AND title IS NULL
    UNION ALL SELECT DISTINCT 'trace', site_id, 'not collected in a published record' FROM i JOIN (SELECT DISTINCT id FROM scores WHERE project_status = 'operational') s ON s.id = i.site_id WHERE status = 'not_collected'""")
def gate_read_traces(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "indicators").select("site_id", "indicator_id", "status", "value_str", F.when(F.col("source.url").isNotNull() | F.col("source.title").isNotNull(), F.col("source")).alias("source"))
    ids = [r[0] for r in own.select("indicator_id").distinct().where("indicator_id is not null").collect()]  # the indicators of the methodology
    sites = table(spark, d, "scores").select("id", F.struct(F.when(F.col("project_status") == "operational", "published").alias("status")).alias("publication")).distinct()
    return gates.read_traces(sites, own, ids, ids).distinct()


@query("SELECT 'twice' AS gate, id AS entity, 'the id comes twice' AS message FROM watchlist GROUP BY id HAVING count(*) > 1")
def gate_ids_twice(spark: SparkSession, d: str) -> DataFrame:
    return gates.twice(table(spark, d, "watchlist"), "id")


@query("""SELECT 'version' AS gate, dc_id AS entity, 'a journal entry is of another version' AS message FROM (SELECT dc_id, methodology_version FROM audit WHERE methodology_version IS DISTINCT FROM '1.0' AND dc_id IS NOT NULL)
    UNION ALL SELECT DISTINCT 'version', dc_id, 'a real record is scored by a draft' FROM audit WHERE NOT starts_with(dc_id, 'zz-')""")
def gate_versions(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "audit").where("dc_id is not null").groupBy(F.col("dc_id").alias("id")).agg(F.collect_list(F.struct("methodology_version")).alias("score_history"))
    return gates.against_draft(h, "1.0", published=False)


_FOLD = "trim(regexp_replace(lower(translate({x}, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"SELECT watch_no, {_FOLD.format(x='municipality')} AS folded FROM watchlist")
def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "watchlist").select("watch_no", text.accent_fold(F.col("municipality")).alias("folded"))


@query(f"SELECT watch_no, trim(regexp_replace({_FOLD.format(x='name')}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM watchlist")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "watchlist").select("watch_no", text.slugify(F.col("name")).alias("slug"))


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS valid FROM customer")
def email_validate(spark: SparkSession, d: str) -> DataFrame:
    mail = F.concat(F.lit(" C"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 != 0, "@mail.Example ").otherwise("@mail"))
    return table(spark, d, "customer").select("c_custkey", text.valid_email(mail).alias("valid"))


@query("SELECT doc_id, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))::INT AS n FROM documents")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(text.html_escape(F.col("text"))).alias("n"))


@query(f"WITH t AS (SELECT item_id, list_filter(string_split(regexp_replace({_FOLD.format(x='text')}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3 AND NOT list_contains(['the', 'des', 'della', 'laboratory'], w)) AS w FROM eval_items) SELECT item_id, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] AS longest FROM t")
def longest_token(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", text.longest_token(F.col("text"), ["the", "des", "della", "laboratory"]).alias("longest"))


@query("SELECT watch_no, trim(regexp_replace(regexp_replace(regexp_extract(source.url, '([^/?#]*)/?(?:[?#].*)?$', 1), '\\.[a-z]+$', ''), '[-_0-9]+', ' ', 'g')) AS title, lower(regexp_extract(source.url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host FROM watchlist")
def url_slug_title(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("source.url")
    return table(spark, d, "watchlist").select("watch_no", text.url_title(u).alias("title"), text.url_host(u).alias("host"))


@query("""WITH f AS (SELECT watch_no, f.source.url AS u FROM (SELECT watch_no, unnest(facts) AS f FROM watchlist) WHERE f.source.url IS NOT NULL), s AS (SELECT watch_no, u, CASE WHEN contains(u, 'gazette') THEN 3 WHEN contains(u, 'mairie') THEN 2 ELSE 1 END AS s FROM f)
    SELECT watch_no, arg_min(u, (-s, u)) AS best FROM s GROUP BY watch_no""")
def url_rank(spark: SparkSession, d: str) -> DataFrame:
    u = F.array_compact(F.transform("facts", lambda f: f["source"]["url"]))
    score = lambda x: F.when(x.contains("gazette"), 3).when(x.contains("mairie"), 2).otherwise(1)
    best = F.array_sort(F.transform(u, lambda x: F.struct((-score(x)).alias("s"), x.alias("u"))))
    return table(spark, d, "watchlist").where("facts is not null").select("watch_no", F.get(best, F.lit(0))["u"].alias("best")).where("best is not null")


@query("SELECT watch_no, CASE WHEN instr(name, ' - ') > 0 THEN substr(trim(substr(name, instr(name, ' - ') + 3)), 1, 160) END AS tail FROM watchlist")
def split_right(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "watchlist").select("watch_no", text.right_of(F.col("name"), " - ").alias("tail"))


@query("SELECT watch_no, concat_ws(' · ', CASE WHEN operator IS NOT NULL THEN 'by ' || operator END, CASE WHEN municipality IS NOT NULL THEN 'in ' || municipality END, project_status) AS label FROM watchlist")
def template_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "watchlist").select("watch_no", F.concat_ws(" · ", F.concat(F.lit("by "), "operator"), F.concat(F.lit("in "), "municipality"), "project_status").alias("label"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 2 THEN 'east' END AS area FROM nation")
def region_map(spark: SparkSession, d: str) -> DataFrame:
    area = F.create_map(*[F.lit(x) for kv in {0: "south", 1: "west", 2: "east"}.items() for x in kv])
    return table(spark, d, "nation").select("n_nationkey", F.get(F.array(area[F.col("n_regionkey")]), F.lit(0)).alias("area"))


# Gates


@query("""SELECT 'duplicate_id' AS gate, id AS entity, 'several different rows under one id' AS message FROM scores GROUP BY id HAVING count(DISTINCT (name, operator, municipality)) > 1
    UNION ALL SELECT 'status_needs_source', row_no::VARCHAR, 'a value without a source' FROM (SELECT DISTINCT row_no, status, source.url AS u FROM indicators) WHERE status IN ('measured', 'announced', 'estimated') AND u IS NULL
    UNION ALL SELECT 'empty_status_forbids_value', row_no::VARCHAR, 'a value where none was found' FROM (SELECT DISTINCT row_no, status, value_num, value_str FROM indicators) WHERE status IN ('missing', 'not_collected') AND (value_num IS NOT NULL OR value_str IS NOT NULL)
    UNION ALL SELECT 'unknown_site', row_no::VARCHAR, 'an indicator of no site' FROM (SELECT DISTINCT row_no, site_id FROM indicators) i WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.id = i.site_id)
    UNION ALL SELECT 'rationale_needed', audit_no::VARCHAR, 'a later entry without a rationale' FROM (SELECT DISTINCT audit_no, rationale, rank() OVER (PARTITION BY dc_id ORDER BY recorded_at, audit_no) AS r FROM audit) WHERE r > 1 AND rationale IS NULL
    UNION ALL SELECT 'weights', pillar, 'weights do not sum to 1' FROM (SELECT p_brand AS pillar, sum(p_size / 50.0) AS w FROM part GROUP BY p_brand) WHERE abs(w - 1) > 1e-9""")
def gate_violations(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    i, s, a = table(spark, d, "indicators"), table(spark, d, "scores"), table(spark, d, "audit")
    dup = s.select("id", "name", "operator", "municipality").distinct().groupBy(F.col("id").alias("entity")).agg(F.count("*").alias("n")).where("n > 1")
    nosrc = i.where(F.col("status").isin(*rules.VALUED) & F.col("source.url").isNull()).select(F.col("row_no").alias("entity")).distinct()
    empty = i.where(F.col("status").isin("missing", "not_collected") & (F.col("value_num").isNotNull() | F.col("value_str").isNotNull())).select(F.col("row_no").alias("entity")).distinct()
    unknown = i.join(s.select(F.col("id").alias("site_id")), "site_id", "left_anti").select(F.col("row_no").alias("entity")).distinct()
    later = a.withColumn("r", F.rank().over(W.partitionBy("dc_id").orderBy("recorded_at", "audit_no"))).where("r > 1 and rationale is null").select(F.col("audit_no").alias("entity")).distinct()
    weights = table(spark, d, "part").groupBy(F.col("p_brand").alias("entity")).agg(F.sum(F.col("p_size") / 50.0).alias("w")).where("abs(w - 1) > 1e-9")
    return stats.violations([
        ("duplicate_id", dup, "several different rows under one id"), ("status_needs_source", nosrc, "a value without a source"), ("empty_status_forbids_value", empty, "a value where none was found"),
        ("unknown_site", unknown, "an indicator of no site"), ("rationale_needed", later, "a later entry without a rationale"), ("weights", weights, "weights do not sum to 1"),
    ])
