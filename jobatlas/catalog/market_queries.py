"""Market aggregates, rankings and lookups over the derived postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobatlas.catalog.base import career_titles, postings, query, table, with_ctes
from jobatlas.operators import market, reports

STATS_SQL = with_ctes(
    """SELECT cs.*, title, trend_pct IS NULL AS low_confidence,
    (SELECT string_agg(skill, ',' ORDER BY rank) FROM cskill k WHERE k.career_id = cs.career_id AND k.region = cs.region AND rank <= 10) AS top_skills,
    (SELECT string_agg(region, ',' ORDER BY rank) FROM creg k WHERE k.career_id = cs.career_id) AS top_regions,
    (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT career_id, slice, source, count(*) AS n FROM wr GROUP BY ALL) s
      WHERE s.career_id = cs.career_id AND s.slice = cs.region) AS source_counts
    FROM cs JOIN career USING (career_id)""", "cs", "cskill", "creg", "career")


def _stats(spark, sf):
    return market.career_stats(postings(spark, sf), career_titles(spark, sf))


@query(STATS_SQL)
def career_market_stats(spark, sf):
    counts = F.array_join(F.transform(F.map_entries("source_counts"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return _stats(spark, sf).withColumns({
        "top_skills": F.array_join("top_skills", ","), "top_regions": F.array_join("top_regions", ","), "source_counts": counts,
    })


SKILL_SQL = with_ctes(
    """SELECT skill, region, round(least(1.0, demand_count / CAST(max(demand_count) OVER (PARTITION BY region) AS DOUBLE)), 4) AS gap_score,
    demand_count, trend_pct, trend_pct IS NULL AS low_confidence, coalesce(related_careers, '') AS related_careers FROM sk""",
    "win", "po_skill",
    ws="SELECT win.*, skill, region AS slice FROM win JOIN po_skill USING (id) UNION ALL SELECT win.*, skill, 'all' FROM win JOIN po_skill USING (id)",
    rel="""SELECT skill, slice, string_agg(career_id, ',' ORDER BY career_id) AS related_careers FROM (SELECT skill, slice, career_id,
        row_number() OVER (PARTITION BY skill, slice ORDER BY career_id) AS rn FROM (SELECT DISTINCT skill, slice, career_id FROM ws WHERE career_id <> 'unmapped'))
        WHERE rn <= 5 GROUP BY ALL""",
    sk="""SELECT ws.skill, ws.slice AS region, count(*) AS demand_count, any_value(related_careers) AS related_careers,
        CASE WHEN count(*) >= 10 AND count(*) FILTER (WHERE is_late) > 0 AND count(*) FILTER (WHERE NOT is_late) > 0
        THEN round((count(*) FILTER (WHERE is_late) - count(*) FILTER (WHERE NOT is_late)) / CAST(greatest(count(*) FILTER (WHERE NOT is_late), 5) AS DOUBLE) * 100, 2) END AS trend_pct
        FROM ws LEFT JOIN rel ON rel.skill = ws.skill AND rel.slice = ws.slice GROUP BY ws.skill, ws.slice""")


@query(SKILL_SQL)
def skill_demand_stats(spark, sf):
    return market.skill_stats(postings(spark, sf)).withColumn("related_careers", F.array_join("related_careers", ","))


@query(SKILL_SQL.replace("related_careers FROM sk", "related_careers FROM sk WHERE region = 'all' ORDER BY gap_score DESC, skill LIMIT 20"))
def skill_gap_top20(spark, sf):
    return market.top_skill_gaps(market.skill_stats(postings(spark, sf)), "all").withColumn(
        "related_careers", F.array_join("related_careers", ",")
    )


@query(with_ctes("""SELECT 'all' AS scope, round(quantile_cont(o_totalprice, 0.25), 2) AS p25, round(quantile_cont(o_totalprice, 0.5), 2) AS p50,
    round(quantile_cont(o_totalprice, 0.75), 2) AS p75, o_orderstatus AS status FROM orders GROUP BY o_orderstatus"""))
def exact_percentiles_by_group(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), "o_totalprice")
    out = market.exact_percentiles(rows, ["status"], "o_totalprice", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return out.withColumn("scope", F.lit("all"))


@query(with_ctes("SELECT career_id, region, skill, n, rank FROM cskill WHERE rank <= 10", "cskill"))
def career_top_skills(spark, sf):
    p = postings(spark, sf)
    return market.career_top_skills(market.mapped_rows(p, market.latest_day(p))).select("career_id", "region", "skill", "n", F.col("rank").cast("long").alias("rank"))


@query(with_ctes("SELECT career_id, region, n, rank FROM creg", "creg"))
def career_top_regions(spark, sf):
    p = postings(spark, sf)
    return market.career_top_regions(market.mapped_rows(p, market.latest_day(p))).withColumn("rank", F.col("rank").cast("long"))


@query(with_ctes("SELECT career_id, slice AS region, id AS posting_id FROM wr", "wr"))
def career_lineage(spark, sf):
    return market.career_lineage(postings(spark, sf)).select("career_id", "region", "posting_id")


@query(with_ctes("""SELECT skill, region, id AS posting_id FROM win JOIN po_skill USING (id)
    UNION ALL SELECT skill, 'all', id FROM win JOIN po_skill USING (id)""", "win", "po_skill"))
def skill_lineage(spark, sf):
    return market.skill_lineage(postings(spark, sf)).select("skill", "region", "posting_id")


META_SQL = with_ctes("""SELECT 'postings_count' AS key, CAST(count(*) AS VARCHAR) AS value FROM win
    UNION ALL SELECT 'mapped_postings_count', CAST(count(*) AS VARCHAR) FROM win WHERE career_id <> 'unmapped'
    UNION ALL SELECT 'unmapped_postings_count', CAST(count(*) AS VARCHAR) FROM win WHERE career_id = 'unmapped'
    UNION ALL SELECT 'source_counts.' || source, CAST(count(*) AS VARCHAR) FROM win GROUP BY source
    UNION ALL SELECT 'region_counts.' || region, CAST(count(*) AS VARCHAR) FROM win GROUP BY region
    UNION ALL SELECT 'window_days', '90' UNION ALL SELECT 'window_end', CAST(max(posted_date) AS VARCHAR) FROM po
    UNION ALL SELECT 'salary_min_samples', '5' UNION ALL SELECT 'trend_formula', '(late45-early45)/max(early45,5)*100'""", "win")


@query(META_SQL)
def market_metadata(spark, sf):
    return market.market_meta(postings(spark, sf))


@query(with_ctes("SELECT max(value) FILTER (WHERE key = 'postings_count') AS postings, max(value) FILTER (WHERE key = 'window_end') AS window_end FROM meta",
                 "win", meta=META_SQL))
def market_meta_map(spark, sf):
    one = market.meta_struct(market.market_meta(postings(spark, sf)))
    return one.select(F.col("meta")["postings_count"].alias("postings"), F.col("meta")["window_end"].alias("window_end"))


def _ranking_sql(name, metric, ties, limit):
    return f"""SELECT region, '{name}' AS ranking, rank, career_id, title, CAST({metric} AS DOUBLE) AS metric, demand_count_90d AS demand_count,
        trend_pct IS NULL AS low_confidence FROM (SELECT cs.*, title, row_number() OVER (PARTITION BY region ORDER BY {metric} DESC{ties}, career_id) AS rank
        FROM cs JOIN career USING (career_id) WHERE {metric} IS NOT NULL) WHERE rank <= {limit}"""


OVERVIEW_SQL = with_ctes(" UNION ALL ".join([
    _ranking_sql("rising", "trend_pct", ", demand_count_90d DESC", 8), _ranking_sql("demand", "demand_count_90d", "", 8),
    _ranking_sql("paying", "salary_p50_trieu", "", 5)]), "cs", "career")


@query(OVERVIEW_SQL)
def market_overview(spark, sf):
    return market.market_overview(_stats(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT * FROM ({OVERVIEW_SQL}) WHERE region = 'all'")
def market_overview_national(spark, sf):
    return market.market_overview(_stats(spark, sf), "all").withColumn("rank", F.col("rank").cast("long"))


LOOKUP_SQL = with_ctes("""SELECT q.career_id, q.region, coalesce(r.demand_count_90d, a.demand_count_90d, 0) AS demand_count_90d,
    CASE WHEN r.career_id IS NOT NULL THEN r.salary_p50_trieu ELSE a.salary_p50_trieu END AS salary_p50_trieu,
    CASE WHEN r.career_id IS NOT NULL THEN r.trend_pct IS NULL WHEN a.career_id IS NOT NULL THEN a.trend_pct IS NULL ELSE true END AS low_confidence,
    CASE WHEN r.career_id IS NOT NULL THEN 'region' WHEN a.career_id IS NOT NULL THEN 'national' ELSE 'absent' END AS market_scope,
    'Từ ' || replace(format('{:,}', coalesce(r.demand_count_90d, a.demand_count_90d, 0)), ',', '.') || ' tin tuyển dụng quan sát, s1' ||
    CASE WHEN r.career_id IS NULL AND a.career_id IS NOT NULL THEN ' (toàn quốc — chưa đủ dữ liệu riêng theo khu vực)' ELSE '' END AS source_note
    FROM q LEFT JOIN cs r ON r.career_id = q.career_id AND r.region = q.region LEFT JOIN cs a ON a.career_id = q.career_id AND a.region = 'all'""",
    "cs", q="SELECT DISTINCT coalesce(p_brand, 'x') AS career_id, n_name AS region FROM part, nation UNION SELECT DISTINCT p_type, r_name FROM part, region UNION SELECT DISTINCT p_brand, r_name FROM part, region")


@query(LOOKUP_SQL)
def career_market_lookup(spark, sf):
    part = table(spark, sf, "part")
    brands, types = part.select(F.col("p_brand").alias("career_id")).distinct(), part.select(F.col("p_type").alias("career_id")).distinct()
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("region"))
    regions = table(spark, sf, "region").select(F.col("r_name").alias("region"))
    asked = brands.crossJoin(nations).union(types.crossJoin(regions)).union(brands.crossJoin(regions)).distinct()
    return market.career_market(asked, _stats(spark, sf), "s1").select(
        "career_id", "region", "demand_count_90d", "salary_p50_trieu", "low_confidence", "market_scope", "source_note"
    )


def _seed(spark, sf):
    """Seed columns per career from the supplier-independent part table."""
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("career_id")).agg(
        F.count(F.lit(1)).alias("demand_count_90d"), F.round(F.avg("p_size"), 2).alias("trend_pct"),
        F.round(F.max("p_retailprice"), 2).alias("salary_p50_trieu"), F.array_sort(F.collect_set("p_type")).alias("top_skills"),
    ).withColumn("entry_level_count_90d", F.lit(None).cast("long")).withColumn(
        "salary_sample_count", F.lit(None).cast("long")).withColumn("top_regions", F.array(F.lit("all")))


SEED = """SELECT p_brand AS career_id, count(*) AS demand_count_90d, round(avg(p_size), 2) AS trend_pct, round(max(p_retailprice), 2) AS salary_p50_trieu
    FROM part GROUP BY p_brand"""


@query(with_ctes("""SELECT p_type || '/' || p_brand AS request, coalesce(demand_count_90d, 0) AS demand_count_90d,
    CAST(floor(coalesce(demand_count_90d, 0) * 0.2) AS BIGINT) AS entry_level_count_90d, salary_p50_trieu, trend_pct, CAST(30 AS BIGINT) AS salary_sample_count, 'seed' AS provenance
    FROM (SELECT DISTINCT p_type, p_brand FROM part) LEFT JOIN seed ON career_id = p_brand""", seed=SEED))
def seed_fallback(spark, sf):
    asked = table(spark, sf, "part").select(
        F.concat_ws("/", "p_type", "p_brand").alias("request"), F.col("p_brand").alias("career_id")).distinct()
    return market.market_or_seed(asked, None, _seed(spark, sf)).drop("career_id", "top_skills", "top_regions")


@query(with_ctes("""SELECT skill, round(score, 2) AS gap_score, demand_count_90d AS demand_count, trend_pct, career_id AS related_career FROM (
    SELECT *, row_number() OVER (PARTITION BY skill ORDER BY score DESC, career_id) AS rn FROM (
    SELECT career_id, demand_count_90d, trend_pct, skill, least(1.0, demand_count_90d / 2000.0 * 0.6 + greatest(trend_pct, 0) / 100 * 0.4) AS score
    FROM seed JOIN (SELECT p_brand, p_type AS skill, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS k FROM (SELECT DISTINCT p_brand, p_type FROM part)) ON p_brand = career_id
    WHERE k <= 3)) WHERE rn = 1 ORDER BY gap_score DESC, skill LIMIT 20""", seed=SEED))
def seed_skill_gap(spark, sf):
    return market.seed_skill_gaps(_seed(spark, sf))


@query(with_ctes("""SELECT career_id, CAST(day AS VARCHAR) AS day, n, CAST(sum(n) OVER (w RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS demand_90d,
    CAST(sum(n) OVER (w RANGE BETWEEN INTERVAL 44 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS late_45d,
    CAST(coalesce(sum(n) OVER (w RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND INTERVAL 45 DAY PRECEDING), 0) AS BIGINT) AS early_45d
    FROM (SELECT career_id, posted_date AS day, count(*) AS n FROM po GROUP BY ALL) WINDOW w AS (PARTITION BY career_id ORDER BY day)""", "po"))
def moving_90_day_demand(spark, sf):
    return market.moving_demand(market.daily_demand(postings(spark, sf))).withColumn("day", F.col("day").cast("string"))


@query(with_ctes("SELECT p.id, p.career_id, title FROM (SELECT id, career_id FROM win WHERE career_id <> 'unmapped') p JOIN career USING (career_id)", "win", "career"))
def posting_career_title(spark, sf):
    p = postings(spark, sf)
    rows = market.in_window(p, market.latest_day(p)).where(F.col("career_id") != "unmapped").select("id", "career_id")
    return rows.join(career_titles(spark, sf), "career_id")


@query(with_ctes("""SELECT career_id, region, CASE WHEN demand_count_90d < 5 THEN 'hidden' WHEN reasons = '' THEN 'high' WHEN reasons NOT LIKE '%,%' THEN 'medium' ELSE 'low' END AS tier, reasons
    FROM (SELECT cs.*, concat_ws(',', CASE WHEN demand_count_90d < 10 THEN 'small_sample' END, CASE WHEN s.n < 2 THEN 'single_source' END,
    CASE WHEN salary_sample_count / CAST(greatest(demand_count_90d, 1) AS DOUBLE) < 0.3 THEN 'low_salary_coverage' END) AS reasons
    FROM cs JOIN (SELECT career_id, slice, count(DISTINCT source) AS n FROM wr GROUP BY ALL) s ON s.career_id = cs.career_id AND s.slice = cs.region)""", "cs"))
def market_confidence_tiers(spark, sf):
    p = postings(spark, sf)
    end = market.latest_day(p)
    sources = market.career_source_counts(market.mapped_rows(p, end))
    return reports.confidence_tiers(market.career_stats(p, career_titles(spark, sf), end), sources, F.lit(0))
