"""Job-market objects derived from the given tables, once for Spark and once as SQL text.

The given tables stand in for the domain: an order is a posting, the brand of its first
line a career, its part types are skills, event users are profiles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobatlas.functions.scoring import DIMENSIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL twin when SQL can express it."""
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PART_TYPES = ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")


#: Lines that one task gathers into orders.
LINES_A_TASK = 1_000_000


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """First brand and title plus the distinct part types of every order: one shuffle on the order key.

    Lines are dealt by order before they are gathered, into more parts as there are more lines: a task holds a bounded
    number of them, and nothing is sorted before the shuffle.
    """
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_brand", "p_name"))
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    n_parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_A_TASK))
    return joined.repartition(n_parts, "l_orderkey").groupBy("l_orderkey").agg(first.alias("f"), F.array_sort(F.collect_set("p_type")).alias("skills")).select(
        "l_orderkey", F.col("f.p_brand").alias("career_id"), F.col("f.p_name").alias("title"), "skills"
    )


def postings(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("posted_date"), "o_orderpriority", "o_orderstatus"
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, sf, "region").select("r_regionkey", "r_name")
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    level = (
        F.when(F.col("o_orderpriority") == "5-LOW", "entry").when(F.col("o_orderpriority") == "3-MEDIUM", "mid")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unknown").otherwise("senior")
    )
    where = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )
    lines = order_lines(spark, sf)
    return (
        orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
        .join(where, orders["o_custkey"] == where["c_custkey"])
        .select(
            F.col("o_orderkey").cast("string").alias("id"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("company"),
            F.col("r_name").alias("region"), "posted_date", F.col("o_orderpriority").alias("priority"), level.alias("seniority"),
            F.when(status != "P", price / 10000).alias("salary_min_trieu"),
            F.when(status == "F", price / 8000).alias("salary_max_trieu"),
            F.coalesce("career_id", F.lit("unmapped")).alias("career_id"),
            F.coalesce("title", F.lit("")).alias("title"),
            F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
        )
    )


def career_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_brand").alias("career_id")).distinct().withColumn(
        "title", F.concat(F.lit("Career "), F.col("career_id"))
    )


def career_dimensions(posts: DataFrame) -> DataFrame:
    """Share of each order priority per career, as the five dimensions."""
    counts = posts.where(F.col("career_id") != "unmapped").groupBy("career_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("priority") == p).alias(d) for p, d in zip(PRIORITIES, DIMENSIONS)]
    )
    return counts.select("career_id", dimension_map("n").alias("dimensions"))


def dimension_map(total: str) -> Column:
    return F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), F.col(d) / F.col(total))])


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One profile per event user; everything collected is a set over a fixed list of labels."""
    e = table(spark, sf, "events").select("user_id", "event_type", "value")
    kind = F.get(F.array(*[F.lit(t) for t in PART_TYPES]), F.least(F.floor(F.col("value") / 60), F.lit(5)).cast("int"))
    e = e.withColumn("label", kind)

    def labels(event: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("event_type") == event, F.col("label"))))

    agg = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("event_type") == t).alias(d) for t, d in zip(EVENT_TYPES, DIMENSIONS)],
        labels("purchase").alias("bought"), labels("view").alias("seen"), labels("click").alias("clicked"), labels("signup").alias("joined"),
    )

    def skill(name: Column, quote: str) -> Column:
        return F.struct(name.alias("name"), F.lit("").alias("level"), F.lit(quote).alias("source_quote"))

    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("_rk"), F.col("r_name").alias("_rn"))
    top = F.greatest(*[F.col(d) for d in DIMENSIONS])
    chain = F.when(F.lit(False), 0)
    for i, d in enumerate(DIMENSIONS):
        chain = chain.when(F.col(d) == top, i)
    experience = F.struct(
        F.lit("signup").alias("title"), F.lit("project").alias("kind"), F.lit("").alias("description"),
        F.col("joined").alias("skills"), F.lit("signup").alias("source_quote"),
    )
    none = F.array().cast("array<struct<turn:int,quote:string,mapped_to:string>>")
    return agg.join(regions, chain == F.col("_rk")).select(
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("quan_ly") > F.col("ky_thuat"), "launch").otherwise("explore").alias("journey_mode"),
        F.lit(None).cast("string").alias("education_stage"), F.lit(None).cast("string").alias("job_goal"),
        dimension_map("n").alias("dimensions"),
        F.concat(F.transform("bought", lambda s: skill(s, "purchase")), F.transform("seen", lambda s: skill(s, ""))).alias("skills"),
        F.col("clicked").alias("interests"),
        F.struct(F.col("_rn").alias("region_pref"), F.lit(None).cast("string").alias("study_budget"),
                 F.lit(None).cast("string").alias("study_duration_pref"), F.lit("").alias("notes")).alias("constraints"),
        none.alias("evidence_quotes"), F.array(experience).alias("experiences"), F.lit(0.0).alias("completeness"),
    )


# ------------------------------------------------------------------ the same in SQL

CTES = {
    "fl": """SELECT l_orderkey, p_brand, p_name, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, p_brand, p_name) AS rn
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "po": """SELECT CAST(o_orderkey AS VARCHAR) AS id, c_mktsegment AS source, c_name AS company, r_name AS region,
        CAST(o_orderdate AS DATE) AS posted_date, o_orderpriority AS priority,
        CASE o_orderpriority WHEN '5-LOW' THEN 'entry' WHEN '3-MEDIUM' THEN 'mid'
             WHEN '4-NOT SPECIFIED' THEN 'unknown' ELSE 'senior' END AS seniority,
        CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 10000 END AS salary_min_trieu,
        CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 8000 END AS salary_max_trieu,
        coalesce(p_brand, 'unmapped') AS career_id, coalesce(p_name, '') AS title
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey LEFT JOIN fl ON l_orderkey = o_orderkey AND rn = 1""",
    "po_skill": """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, p_type AS skill
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "win": """SELECT *, CASE WHEN salary_min_trieu IS NULL AND salary_max_trieu IS NULL THEN NULL
        ELSE (coalesce(salary_min_trieu, salary_max_trieu) + coalesce(salary_max_trieu, salary_min_trieu)) / 2 END AS salary,
        posted_date >= (SELECT max(posted_date) FROM po) - 44 AS is_late
        FROM po WHERE posted_date BETWEEN (SELECT max(posted_date) FROM po) - 89 AND (SELECT max(posted_date) FROM po)""",
    "wr": """SELECT win.*, region AS slice FROM win WHERE career_id <> 'unmapped'
        UNION ALL SELECT win.*, 'all' FROM win WHERE career_id <> 'unmapped'""",
    "cs": """SELECT career_id, slice AS region, count(*) AS demand_count_90d,
        count(*) FILTER (WHERE seniority = 'entry') AS entry_level_count_90d,
        CASE WHEN count(salary) >= 5 THEN round(quantile_cont(salary, 0.25), 2) END AS salary_p25_trieu,
        CASE WHEN count(salary) >= 5 THEN round(quantile_cont(salary, 0.5), 2) END AS salary_p50_trieu,
        CASE WHEN count(salary) >= 5 THEN round(quantile_cont(salary, 0.75), 2) END AS salary_p75_trieu,
        count(salary) AS salary_sample_count,
        CASE WHEN count(*) >= 10 AND count(*) FILTER (WHERE is_late) > 0 AND count(*) FILTER (WHERE NOT is_late) > 0
             THEN round((count(*) FILTER (WHERE is_late) - count(*) FILTER (WHERE NOT is_late))
                  / CAST(greatest(count(*) FILTER (WHERE NOT is_late), 5) AS DOUBLE) * 100, 2) END AS trend_pct
        FROM wr GROUP BY ALL""",
    "cskill": """SELECT career_id, slice AS region, skill, count(*) AS n, row_number() OVER (PARTITION BY career_id, slice
        ORDER BY count(*) DESC, skill) AS rank FROM wr JOIN po_skill USING (id) GROUP BY career_id, slice, skill""",
    "creg": """SELECT career_id, region, count(*) AS n, row_number() OVER (PARTITION BY career_id
        ORDER BY count(*) DESC, region) AS rank FROM win WHERE career_id <> 'unmapped' GROUP BY career_id, region""",
    "career": """SELECT DISTINCT p_brand AS career_id, 'Career ' || p_brand AS title FROM part""",
    "cdim": """SELECT career_id, count(*) FILTER (WHERE priority = '1-URGENT') / CAST(count(*) AS DOUBLE) AS d1,
        count(*) FILTER (WHERE priority = '2-HIGH') / CAST(count(*) AS DOUBLE) AS d2,
        count(*) FILTER (WHERE priority = '3-MEDIUM') / CAST(count(*) AS DOUBLE) AS d3,
        count(*) FILTER (WHERE priority = '4-NOT SPECIFIED') / CAST(count(*) AS DOUBLE) AS d4,
        count(*) FILTER (WHERE priority = '5-LOW') / CAST(count(*) AS DOUBLE) AS d5
        FROM po WHERE career_id <> 'unmapped' GROUP BY career_id""",
    "ev": """SELECT user_id, event_type, value, CASE least(floor(value / 60), 5) WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL'
        WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'STANDARD' ELSE 'LARGE' END AS label FROM events""",
    "pr0": """SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS c1,
        count(*) FILTER (WHERE event_type = 'error') AS c2, count(*) FILTER (WHERE event_type = 'purchase') AS c3,
        count(*) FILTER (WHERE event_type = 'signup') AS c4, count(*) FILTER (WHERE event_type = 'view') AS c5
        FROM events GROUP BY user_id""",
    "pr": """SELECT session_id, c1 / CAST(n AS DOUBLE) AS e1, c2 / CAST(n AS DOUBLE) AS e2, c3 / CAST(n AS DOUBLE) AS e3,
        c4 / CAST(n AS DOUBLE) AS e4, c5 / CAST(n AS DOUBLE) AS e5,
        CASE greatest(c1, c2, c3, c4, c5) WHEN c1 THEN 0 WHEN c2 THEN 1 WHEN c3 THEN 2 WHEN c4 THEN 3 ELSE 4 END AS dom,
        CASE WHEN c5 > c1 THEN 'launch' ELSE 'explore' END AS journey_mode, r_name AS region_pref
        FROM pr0 JOIN region ON r_regionkey = CASE greatest(c1, c2, c3, c4, c5) WHEN c1 THEN 0 WHEN c2 THEN 1 WHEN c3 THEN 2
        WHEN c4 THEN 3 ELSE 4 END""",
    "pl": """SELECT session_id, label, max(weight) AS weight FROM (
        SELECT CAST(user_id AS VARCHAR) AS session_id, lower(label) AS label,
        CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'view' THEN 0.6 WHEN 'click' THEN 0.5 WHEN 'signup' THEN 0.9 END AS weight
        FROM ev WHERE event_type <> 'error'
        UNION ALL SELECT session_id, 'signup', 0.4 FROM pr0) GROUP BY session_id, label""",
    "cfeat": """SELECT d.career_id, d1, d2, d3, d4, d5,
        CASE greatest(d1, d2, d3, d4, d5) WHEN d1 THEN 0 WHEN d2 THEN 1 WHEN d3 THEN 2 WHEN d4 THEN 3 ELSE 4 END AS cdom,
        coalesce(demand_count_90d, 0) AS demand, coalesce(trend_pct, 0.0) AS trend
        FROM cdim d LEFT JOIN cs ON cs.career_id = d.career_id AND cs.region = 'all'""",
    "tops": "SELECT career_id, skill, lower(skill) AS label, rank FROM cskill WHERE region = 'all' AND rank <= 10",
    "hit": """SELECT p.session_id, t.career_id, t.label, max(p.weight) AS w FROM pl p JOIN tops t
        ON p.label = t.label OR (length(p.label) >= 3 AND length(t.label) >= 3
           AND (contains(p.label, t.label) OR contains(t.label, p.label))) GROUP BY ALL""",
    "ovl": """SELECT p.session_id, c.career_id, coalesce(h.m, 0) AS m, coalesce(h.w, 0) AS w, coalesce(tn.n, 0) AS ncar,
        pn.n + coalesce(tn.n, 0) - coalesce(h.eq, 0) AS nuni
        FROM pr p CROSS JOIN cfeat c
        LEFT JOIN (SELECT hit.session_id, hit.career_id, count(*) AS m, sum(hit.w) AS w, count(pl.label) AS eq FROM hit
                   LEFT JOIN pl ON pl.session_id = hit.session_id AND pl.label = hit.label GROUP BY ALL) h
             ON h.session_id = p.session_id AND h.career_id = c.career_id
        LEFT JOIN (SELECT session_id, count(*) AS n FROM pl GROUP BY 1) pn ON pn.session_id = p.session_id
        LEFT JOIN (SELECT career_id, count(*) AS n FROM tops GROUP BY 1) tn ON tn.career_id = c.career_id""",
    "parts": """SELECT p.session_id, c.career_id, p.dom, c.cdom, p.region_pref, p.journey_mode,
        CASE WHEN e1*e1+e2*e2+e3*e3+e4*e4+e5*e5 = 0 OR d1*d1+d2*d2+d3*d3+d4*d4+d5*d5 = 0 THEN 0 ELSE
        least(1, (e1*d1+e2*d2+e3*d3+e4*d4+e5*d5) / (sqrt(e1*e1+e2*e2+e3*e3+e4*e4+e5*e5) * sqrt(d1*d1+d2*d2+d3*d3+d4*d4+d5*d5))) END AS cosine,
        CASE WHEN ncar = 0 THEN 0 ELSE 0.5 * m / greatest(1, nuni) + 0.5 * least(1.0, w / CAST(greatest(1, ncar) AS DOUBLE)) END AS skill,
        least(1.0, least(1.0, greatest(0.0, least(1.0, ln(1 + demand) / ln(2001)) * (1 + greatest(-50, least(100, trend)) / 200) / 1.5))
          * CASE WHEN EXISTS (SELECT 1 FROM creg WHERE creg.career_id = c.career_id AND creg.region = p.region_pref) THEN 1.05 ELSE 1.0 END) AS market
        FROM pr p CROSS JOIN cfeat c JOIN ovl o ON o.session_id = p.session_id AND o.career_id = c.career_id""",
    "scored": """SELECT *, least(0.35, 0.2 * market) AS market_component,
        least(1.0, 0.5 * cosine + 0.3 * skill + least(0.35, 0.2 * market)) AS total FROM parts""",
    "rnk": """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY total DESC, career_id) AS rank FROM scored""",
}
DEPS = {
    "po": ["fl"], "win": ["po"], "wr": ["win"], "cs": ["wr"], "cskill": ["wr", "po_skill"], "creg": ["win"], "cdim": ["po"],
    "pr": ["pr0"], "pl": ["ev", "pr0"], "cfeat": ["cdim", "cs"], "tops": ["cskill"], "hit": ["pl", "tops"],
    "ovl": ["pr", "cfeat", "hit", "pl", "tops"], "parts": ["pr", "cfeat", "ovl", "creg"], "scored": ["parts"], "rnk": ["scored"],
}


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """SQL with the named definitions and everything they need in front; ``extra`` adds local ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in DEPS.get(name, []):
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    definitions = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(definitions)} {body}" if definitions else body
