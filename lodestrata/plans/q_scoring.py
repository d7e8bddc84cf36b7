"""Queries on scoring rules (normalisation, means, grades) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import rules
from lodestrata.operators import scoring
from lodestrata.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# A synthetic grid; status, block and pillar follow from keys.
STEPS = [(10.0, 100.0), (25.0, 60.0), (40.0, 30.0)]
PRIORITY = {"1-URGENT": 20.0, "2-HIGH": 40.0, "3-MEDIUM": 60.0, "4-NOT SPECIFIED": 80.0, "5-LOW": 100.0}
_STATUS_SQL = "CASE WHEN {k} % 10 < 4 THEN 'measured' WHEN {k} % 10 < 6 THEN 'announced' WHEN {k} % 10 = 6 THEN 'estimated' WHEN {k} % 10 < 9 THEN 'missing' ELSE 'not_collected' END"
_BLOCK_SQL = "CASE WHEN {k} % 3 = 0 THEN 'base' WHEN {k} % 3 = 1 THEN 'project' ELSE 'process' END"
_LETTER_SQL = "CASE WHEN {s} >= 80 THEN 'A' WHEN {s} >= 65 THEN 'B' WHEN {s} >= 50 THEN 'C' WHEN {s} >= 35 THEN 'D' WHEN {s} >= 0 THEN 'E' END"
_STEPS_SQL = "CASE WHEN l_quantity <= 10 THEN 100.0::DOUBLE WHEN l_quantity <= 25 THEN 60.0::DOUBLE WHEN l_quantity <= 40 THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END"


def status_of(key: Column) -> Column:
    d = F.pmod(key, F.lit(10))
    return rules.ladder([(d < 4, "measured"), (d < 6, "announced"), (d == 6, "estimated"), (d < 9, "missing")], "not_collected")


def block_of(key: Column) -> Column:
    d = F.pmod(key, F.lit(3))
    return rules.ladder([(d == 0, "base"), (d == 1, "project")], "process")


@query(f"SELECT l_orderkey, l_linenumber, {_STEPS_SQL} AS score FROM lineitem")
def norm_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.by_steps(F.col("l_quantity"), STEPS, 0.0).alias("score"))


@query("SELECT c_custkey, round(100 - greatest(0.0, least(1.0, (c_acctbal - 0) / 5000.0)) * 100, 6) AS score FROM customer")
def norm_bounded_linear(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.round(rules.between_bounds(F.col("c_acctbal"), 0.0, 5000.0, lower_is_better=True), 6).alias("score"))


@query("SELECT o_orderkey, (CASE o_orderpriority WHEN '1-URGENT' THEN 20 WHEN '2-HIGH' THEN 40 WHEN '3-MEDIUM' THEN 60 WHEN '4-NOT SPECIFIED' THEN 80 WHEN '5-LOW' THEN 100 END)::DOUBLE AS score FROM orders")
def norm_categorical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", rules.by_category(F.col("o_orderpriority"), PRIORITY).alias("score"))


@query("""
    SELECT row_no, (CASE WHEN proxies.public_inquiry_held THEN 25 WHEN NOT proxies.public_inquiry_held THEN 0 ELSE 0 END
        + CASE proxies.environmental_authority_opinion WHEN 'favorable' THEN 20 WHEN 'favorable_with_reservations' THEN 15 ELSE 0 END
        + CASE WHEN NOT proxies.cndp_referral THEN 5 WHEN proxies.cndp_referral THEN 20 ELSE 0 END
        + CASE WHEN proxies.legal_appeals_count = 0 THEN 20 WHEN proxies.legal_appeals_count = 1 THEN 10 ELSE 0 END
        + CASE proxies.council_deliberations WHEN 'favorable' THEN 15 WHEN 'mixed' THEN 8 ELSE 0 END)::DOUBLE AS score
    FROM (SELECT DISTINCT row_no, proxies FROM indicators WHERE proxies IS NOT NULL)
""")
def norm_proxy_rubric(spark: SparkSession, d: str) -> DataFrame:
    rubric = {
        "public_inquiry_held": {"true": 25.0, "false": 0.0}, "environmental_authority_opinion": {"favorable": 20.0, "favorable_with_reservations": 15.0},
        "cndp_referral": {"false": 5.0, "true": 20.0}, "legal_appeals_count": {"0": 20.0, "1": 10.0, "2_or_more": 0.0}, "council_deliberations": {"favorable": 15.0, "mixed": 8.0},
    }
    p = {k: F.col(f"proxies.{k}") for k in rubric}
    p = {k: rules.count_class(c) if k == "legal_appeals_count" else c.cast("string") for k, c in p.items()}
    return table(spark, d, "indicators").where("proxies is not null").select("row_no", "proxies").distinct().select("row_no", rules.by_rubric(p, rubric).alias("score"))


@query(f"""
    SELECT l_orderkey, l_linenumber, CASE l_orderkey % 3 WHEN 0 THEN 'steps' WHEN 1 THEN 'linear' ELSE 'category' END AS kind,
        CASE l_orderkey % 3 WHEN 0 THEN {_STEPS_SQL} WHEN 1 THEN round(greatest(0.0, least(1.0, l_extendedprice / 100000.0)) * 100, 6)
             ELSE (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 100 WHEN 'R' THEN 50 END)::DOUBLE END AS score
    FROM lineitem
""")
def norm_dispatch(spark: SparkSession, d: str) -> DataFrame:
    kind = rules.ladder([(F.pmod("l_orderkey", F.lit(3)) == 0, "steps"), (F.pmod("l_orderkey", F.lit(3)) == 1, "linear")], "category")
    cases = {"steps": rules.by_steps(F.col("l_quantity"), STEPS, 0.0), "linear": F.round(rules.between_bounds(F.col("l_extendedprice"), 0.0, 100000.0), 6), "category": rules.by_category(F.col("l_returnflag"), {"A": 0.0, "N": 100.0, "R": 50.0})}
    return table(spark, d, "lineitem").withColumn("kind", kind).select("l_orderkey", "l_linenumber", "kind", rules.dispatch(F.col("kind"), cases).alias("score"))


@query(f"SELECT s_suppkey, {_STATUS_SQL.format(k='s_suppkey')} AS status, CASE {_STATUS_SQL.format(k='s_suppkey')} WHEN 'measured' THEN s_acctbal / 100 WHEN 'announced' THEN least(s_acctbal / 100, 60.0) WHEN 'estimated' THEN least(s_acctbal / 100, 60.0) END AS score FROM supplier")
def prudent_cap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").withColumn("status", status_of(F.col("s_suppkey"))).select("s_suppkey", "status", rules.capped(F.col("s_acctbal") / 100, F.col("status")).alias("score"))


@query(f"SELECT c_custkey, block, status, CASE WHEN status = 'missing' AND block <> 'base' THEN 0.0 WHEN status IN ('missing', 'not_collected') THEN NULL ELSE c_acctbal END AS sub FROM (SELECT *, {_STATUS_SQL.format(k='c_custkey')} AS status, {_BLOCK_SQL.format(k='c_custkey')} AS block FROM customer)")
def zero_fill_by_block(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("status", status_of(F.col("c_custkey"))).withColumn("block", block_of(F.col("c_custkey")))
    norm = F.when(F.col("status").isin(*rules.VALUED), F.col("c_acctbal"))
    return c.select("c_custkey", "block", "status", rules.substantive(norm, F.col("status"), F.col("block")).alias("sub"))


@query(f"SELECT c_custkey, {_LETTER_SQL.format(s='round(c_acctbal / 100, 1)')} AS grade FROM customer")
def grade_letter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", rules.letter(F.col("c_acctbal") / 100).alias("grade"))


@query(f"SELECT s_suppkey, CASE WHEN g = 'A' AND s_suppkey % 4 <> 0 THEN 'B' ELSE g END AS grade, coalesce(g = 'A' AND s_suppkey % 4 <> 0, false) AS was_reserved FROM (SELECT s_suppkey, {_LETTER_SQL.format(s='round(s_acctbal / 100, 1)')} AS g FROM supplier)")
def reserve_top_grade(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("g", rules.letter(F.col("s_acctbal") / 100))
    out = rules.reserved(F.col("g"), F.pmod("s_suppkey", F.lit(4)) == 0)
    return s.select("s_suppkey", out.alias("grade"), (~out.eqNullSafe(F.col("g"))).alias("was_reserved"))


@query("SELECT DISTINCT id, (CASE WHEN confidence.score >= 0.8 THEN 4 WHEN confidence.score >= 0.6 THEN 3 WHEN confidence.score >= 0.4 THEN 2 WHEN confidence.score IS NOT NULL THEN 1 END)::INT AS dots FROM scores")
def doc_dots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scores").select("id", rules.dots(F.col("confidence.score")).alias("dots")).distinct()


_FACTS_SQL = f"""
    f AS (SELECT l_suppkey AS site, p_brand AS pillar, 1.0 + (l_partkey % 3) AS weight, 0.1 + (ascii(substr(p_brand, 8, 1)) % 5) * 0.05 AS pillar_weight,
              CASE l_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.3 END AS tier_weight,
              {_STATUS_SQL.format(k='l_partkey')} AS status, {_BLOCK_SQL.format(k='l_partkey')} AS block, least(100.0, l_quantity * 2) AS value
          FROM lineitem JOIN part ON p_partkey = l_partkey),
    s AS (SELECT *, CASE WHEN status = 'measured' THEN value WHEN status IN ('announced', 'estimated') THEN least(value, 60.0) END AS norm FROM f),
    t AS (SELECT *, CASE WHEN status = 'missing' AND block <> 'base' THEN 0.0 ELSE norm END AS sub FROM s)
"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    """A fact table made of lineitem and part: site = supplier, pillar = brand."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("pillar"))
    f = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(p, "l_partkey")
    k = F.col("l_partkey")
    f = f.select(
        F.col("l_suppkey").alias("site"), "pillar", (1.0 + F.pmod(k, F.lit(3))).alias("weight"), (0.1 + F.pmod(F.ascii(F.substring("pillar", 8, 1)), F.lit(5)) * 0.05).alias("pillar_weight"),
        rules.ladder([(F.pmod(k, F.lit(3)) == 0, 1.0), (F.pmod(k, F.lit(3)) == 1, 0.6)], 0.3).alias("tier_weight"), status_of(k).alias("status"), block_of(k).alias("block"), F.least(F.lit(100.0), F.col("l_quantity") * 2).alias("value"),
    )
    return scoring.scored(f, F.col("value"))


_P_SQL = "p AS (SELECT site, pillar, pillar_weight, sum(weight * sub) FILTER (sub IS NOT NULL) / nullif(sum(weight) FILTER (sub IS NOT NULL), 0) AS p, sum(CASE WHEN norm IS NOT NULL THEN weight * pillar_weight ELSE 0 END) AS have, sum(weight * pillar_weight) AS total FROM t GROUP BY ALL)"


@query(f"WITH {_FACTS_SQL}, {_P_SQL}, m AS (SELECT site, sum(pillar_weight * p) FILTER (p IS NOT NULL) / nullif(sum(pillar_weight) FILTER (p IS NOT NULL), 0) AS score, sum(have) / nullif(sum(total), 0) AS coverage FROM p GROUP BY site) SELECT site, round(score, 4) AS score, round(coverage, 6) AS coverage, CASE WHEN coverage IS NULL OR coverage < 0.4 THEN 'insufficient_data' ELSE {_LETTER_SQL.format(s='round(score, 1)')} END AS grade FROM m")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.scorecard(facts(spark, d), ["site"])
    return s.select("site", F.round("score", 4).alias("score"), F.round("coverage", 6).alias("coverage"), "grade")


@query(f"WITH {_FACTS_SQL}, {_P_SQL} SELECT site, round(sum(pillar_weight * p) FILTER (p IS NOT NULL) / nullif(sum(pillar_weight) FILTER (p IS NOT NULL), 0), 4) AS score FROM p GROUP BY site")
def two_level_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return scoring.two_level_mean(facts(spark, d), ["site"]).select("site", F.round("score", 4).alias("score"))


@query(f"WITH {_FACTS_SQL} SELECT site, pillar, round(sum(CASE WHEN norm IS NOT NULL THEN weight ELSE 0 END) / nullif(sum(weight), 0), 6) AS coverage FROM t GROUP BY ALL")
def weighted_coverage(spark: SparkSession, d: str) -> DataFrame:
    return scoring.coverage(facts(spark, d), ["site", "pillar"], pillar_weighted=False).select("site", "pillar", F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_FACTS_SQL}, c AS (SELECT site, pillar, round(sum(CASE WHEN norm IS NOT NULL THEN weight ELSE 0 END) / nullif(sum(weight), 0), 9) AS coverage FROM t GROUP BY ALL) SELECT site, pillar, CASE WHEN coverage IS NULL OR coverage < 0.4 THEN 'insufficient_data' ELSE 'graded' END AS outcome FROM c")
def insufficient_gate(spark: SparkSession, d: str) -> DataFrame:
    c = scoring.coverage(facts(spark, d), ["site", "pillar"], pillar_weighted=False)
    return c.select("site", "pillar", F.coalesce(scoring.gated(F.round("coverage", 9)), F.lit("graded")).alias("outcome"))


@query(f"""WITH {_FACTS_SQL}, c AS (SELECT site, sum(w) AS w, sum(CASE WHEN status IN ('missing', 'not_collected') THEN w ELSE 0 END) / sum(w) AS gap, sum(CASE WHEN status = 'announced' THEN w ELSE 0 END) / sum(w) AS declared, sum(CASE WHEN status = 'estimated' THEN w ELSE 0 END) / sum(w) AS estimated
    FROM (SELECT *, weight * pillar_weight * tier_weight AS w FROM t) GROUP BY site)
    SELECT site, round(gap, 3) AS gap, round(declared, 3) AS declared, round(estimated, 3) AS estimated, CASE WHEN raw >= 0.75 THEN 'high' WHEN raw >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM (SELECT *, greatest(0.0, 1 - gap - 0.5 * (declared + estimated)) AS raw FROM c)""")
def confidence_shares(spark: SparkSession, d: str) -> DataFrame:
    return scoring.confidence(facts(spark, d), ["site"]).select("site", *[F.round(c, 3).alias(c) for c in ("gap", "declared", "estimated")], "level")


@query(f"WITH {_FACTS_SQL} SELECT coalesce(pillar, 'all') AS pillar, coalesce(block, 'all') AS block, round(sum(weight * sub) FILTER (sub IS NOT NULL) / nullif(sum(weight) FILTER (sub IS NOT NULL), 0), 4) AS score, count(*) AS n FROM t GROUP BY GROUPING SETS ((pillar, block), (pillar), (block), ())")
def scoped_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = facts(spark, d).groupBy("pillar", "block").agg(F.sum(F.when(F.col("sub").isNotNull(), F.col("weight") * F.col("sub"))).alias("a"), F.sum(F.when(F.col("sub").isNotNull(), F.col("weight"))).alias("b"), F.count("*").alias("n"))
    s = p.groupingSets([["pillar", "block"], ["pillar"], ["block"], []], "pillar", "block").agg(F.round(F.try_divide(F.sum("a"), F.nullif(F.sum("b"), F.lit(0.0))), 4).alias("score"), F.sum("n").alias("n"))
    return s.select(F.coalesce("pillar", F.lit("all")).alias("pillar"), F.coalesce("block", F.lit("all")).alias("block"), "score", "n")


@query(f"""WITH {_FACTS_SQL}, {_P_SQL}, g AS (SELECT site, pillar, round(p, 4) AS p, {_LETTER_SQL.format(s='round(round(p, 4), 1)')} AS g FROM p WHERE p IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY g DESC, p, pillar) AS k FROM g)
    SELECT site, 'weakest in ' || pillar || ' with ' || g AS quote, p AS worst_score FROM r WHERE k = 1""")
def worst_pillar_quote(spark: SparkSession, d: str) -> DataFrame:
    p = facts(spark, d).groupBy("site", "pillar", "pillar_weight").agg(F.round(scoring.weighted_mean(F.col("sub"), F.col("weight")), 4).alias("p"))
    w = scoring.worst_pillar(p, ["site"], "pillar", "p")
    return w.select("site", F.concat(F.lit("weakest in "), "worst_pillar", F.lit(" with "), "worst_grade").alias("quote"), "worst_score")


# Bands and classes


@query("SELECT DISTINCT id, (CASE WHEN power_mw IS NULL THEN 0 WHEN power_mw >= 50 THEN 3 WHEN power_mw >= 10 THEN 2 ELSE 1 END)::INT AS tier FROM scores")
def size_tier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scores").select("id", F.coalesce(rules.at_least(F.col("power_mw"), [(50.0, 3), (10.0, 2)], 1), F.lit(0)).alias("tier")).distinct()


@query("SELECT p_partkey, CASE WHEN p_size * 3 >= 100 THEN 'ample' WHEN p_size * 3 >= 20 THEN 'adequate' WHEN p_size * 3 >= 5 THEN 'constrained' ELSE 'saturated' END AS band FROM part")
def band_capacity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rules.at_least(F.col("p_size") * 3, [(100, "ample"), (20, "adequate"), (5, "constrained")], "saturated").alias("band"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 < 30 THEN 'low' WHEN l_quantity * 2 < 70 THEN 'moderate' WHEN l_quantity * 2 < 100 THEN 'high' ELSE 'critical' END AS band FROM lineitem")
def band_fill_rate(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity") * 2
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.ladder([(q < 30, "low"), (q < 70, "moderate"), (q < 100, "high")], "critical").alias("band"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 21000 THEN 'low' WHEN o_totalprice <= 25000 THEN 'middle' ELSE 'high' END AS band FROM orders")
def band_income(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", rules.ladder([(v < 21000, "low"), (v <= 25000, "middle")], "high").alias("band"))


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'exact' WHEN p_brand LIKE 'Brand#1%' THEN 'one' WHEN p_brand LIKE 'Brand#%' THEN 'other' END AS class FROM part")
def prefix_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rules.prefix_class(F.col("p_brand"), {"Brand#11": "exact"}, [("Brand#1", "one"), ("Brand#", "other")]).alias("class"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel|copper') THEN 'metal' WHEN regexp_matches(lower(p_type), 'econom|promo') THEN 'cheap' END AS class FROM part")
def keyword_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rules.keyword_class(F.col("p_type"), [("steel|copper", "metal"), ("econom|promo", "cheap")]).alias("class"))


@query("SELECT o_orderkey, round(try_cast(o_totalprice AS DOUBLE) / nullif(o_orderkey % 5, 0), 4) AS ratio FROM orders")
def ratio_guarded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.round(rules.guarded_ratio(F.col("o_totalprice"), F.pmod("o_orderkey", F.lit(5))), 4).alias("ratio"))


@query("SELECT o_orderkey, round(round(o_totalprice / pow(10.0, floor(log10(abs(o_totalprice))) - 1)) * pow(10.0, floor(log10(abs(o_totalprice))) - 1), 3) AS rounded FROM orders WHERE o_totalprice <> 0")
def round_sigfig(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_totalprice <> 0").select("o_orderkey", F.round(rules.significant(F.col("o_totalprice")), 3).alias("rounded"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_tax END, CASE WHEN l_linenumber % 3 = 0 THEN l_discount END, l_quantity) AS latest FROM lineitem")
def coalesce_latest_column(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").withColumn("v_2023", F.col("l_quantity")).withColumn("v_2024", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_discount"))).withColumn("v_2025", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")))
    return l.select("l_orderkey", "l_linenumber", rules.latest_of(["v_2023", "v_2024", "v_2025"]).alias("latest"))


@query("SELECT DISTINCT id, coalesce(nullif(trim(operator), ''), municipality) AS value, (operator = municipality) AS agrees FROM scores")
def coalesce_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scores").select("id", F.coalesce(F.nullif(F.trim("operator"), F.lit("")), "municipality").alias("value"), (F.col("operator") == F.col("municipality")).alias("agrees")).distinct()


@query("SELECT n.n_nationkey AS n_nationkey, e.event_type AS event_type, coalesce(c.n, 0) AS n FROM nation n CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS event_type) e LEFT JOIN (SELECT user_id % 25 AS k, event_type, count(*) AS n FROM events GROUP BY ALL) c ON c.k = n.n_nationkey AND c.event_type = e.event_type")
def pad_missing_grid(spark: SparkSession, d: str) -> DataFrame:
    from lodestrata.operators.tables import padded

    # no event is a refund, so its cells are all padded
    c = table(spark, d, "events").groupBy(F.pmod("user_id", F.lit(25)).cast("int").alias("n_nationkey"), "event_type").agg(F.count("*").alias("n"))
    return padded(table(spark, d, "nation").select("n_nationkey"), ["click", "error", "purchase", "refund", "signup", "view"], "event_type", c, ["n_nationkey", "event_type"], {"n": 0}).select("n_nationkey", "event_type", "n")
