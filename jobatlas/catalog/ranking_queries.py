"""Profile to career ranking, stretch, counterfactual, what-if, gaps and readiness."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from jobatlas.catalog.base import CTES, career_dimensions, career_titles, postings, profiles, query, table, with_ctes
from jobatlas.functions import scoring
from jobatlas.functions.scoring import RankWeights
from jobatlas.operators import guidance, market, quality, ranking
from jobatlas.plans.recommend import career_features, recommend
from jobatlas.session import cut_lineage


def careers(spark, sf):
    """Careers with dimensions and national market numbers; small, and read by several rankings."""
    p = postings(spark, sf)
    dims = career_dimensions(p).join(career_titles(spark, sf), "career_id")
    stats = market.career_stats(p, career_titles(spark, sf))
    return cut_lineage(career_features(dims, stats)), stats


def ranked(spark, sf, **kw):
    features, _ = careers(spark, sf)
    return ranking.rank_careers(profiles(spark, sf), features, **kw)


R = "round({}, 6) AS {}"
TOP20 = with_ctes(
    f"SELECT session_id, rank, career_id, {', '.join(R.format(c, c) for c in ('total', 'cosine', 'skill', 'market', 'market_component'))} FROM rnk WHERE rank <= 20", "rnk")


@query(TOP20)
def top_careers_per_profile(spark, sf):
    rows = ranking.explode_ranked(ranked(spark, sf))
    return rows.select("session_id", F.col("rank").cast("long").alias("rank"), "career_id",
                       *[F.round(c, 6).alias(c) for c in ("total", "cosine", "skill", "market", "market_component")])


@query(with_ctes("""SELECT session_id, career_id, round(total, 6) AS total, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY total DESC, career_id) AS rank FROM (
    SELECT session_id, career_id, least(1.0, (0.5 * cosine + 0.3 * skill) / 0.8) AS total FROM parts)) WHERE rank <= 5""", "parts"))
def top_careers_without_market(spark, sf):
    rows = ranking.explode_ranked(ranked(spark, sf, k=5, use_market=False))
    return rows.select("session_id", "career_id", F.round("total", 6).alias("total"), F.col("rank").cast("long").alias("rank"))


def shown_sql(rnk: str) -> str:
    """Five shown careers plus the stretch, from a rank table."""
    return f"""SELECT session_id, rank, career_id, round(total, 4) AS match_score, false AS is_stretch FROM {rnk} WHERE rank <= 5
    UNION ALL SELECT session_id, 6, career_id, round(total, 4), true FROM (SELECT *, row_number() OVER (PARTITION BY session_id
      ORDER BY CASE WHEN cdom <> dom THEN 0 ELSE 1 END, rank) AS pick FROM {rnk} WHERE rank BETWEEN 6 AND 20) WHERE pick = 1"""


@query(with_ctes(shown_sql("rnk"), "rnk"))
def shown_careers_with_stretch(spark, sf):
    rows = ranking.recommendation_rows(ranking.with_stretch(ranked(spark, sf)))
    return rows.select("session_id", F.col("rank").cast("long").alias("rank"), "career_id", "match_score", "is_stretch")


DOMS = "CASE dom WHEN {i} THEN greatest(0.0, e{n} - 0.15) WHEN dom THEN CASE tgt WHEN {i} THEN least(1.0, e{n} + 0.3) ELSE e{n} END END"
ALT = {
    "pra": """SELECT session_id, dom, region_pref, journey_mode, tgt, """ + ", ".join(
        f"CASE WHEN tgt = {i} THEN least(1.0, e{i + 1} + 0.3) WHEN dom = {i} THEN greatest(0.0, e{i + 1} - 0.15) ELSE e{i + 1} END AS e{i + 1}" for i in range(5)
    ) + """ FROM (SELECT *, CASE WHEN dom <> 0 AND e1 = m THEN 0 WHEN dom <> 1 AND e2 = m THEN 1 WHEN dom <> 2 AND e3 = m THEN 2 WHEN dom <> 3 AND e4 = m THEN 3 ELSE 4 END AS tgt
        FROM (SELECT *, greatest(""" + ", ".join(f"CASE WHEN dom = {i} THEN -1 ELSE e{i + 1} END" for i in range(5)) + ") AS m FROM pr))",
    "partsa": CTES["parts"].replace("FROM pr p", "FROM pra p"),
    "scoreda": CTES["scored"].replace("FROM parts", "FROM partsa"),
    "rnka": CTES["rnk"].replace("FROM scored", "FROM scoreda"),
}


@query(with_ctes("""SELECT b.session_id, b.career_id AS current_career, CASE WHEN a1.career_id = b.career_id THEN a2.career_id ELSE a1.career_id END AS new_career
    FROM rnk b JOIN rnka a1 ON a1.session_id = b.session_id AND a1.rank = 1 JOIN rnka a2 ON a2.session_id = b.session_id AND a2.rank = 2 WHERE b.rank <= 5""", "rnk", **ALT))
def counterfactual_top_career(spark, sf):
    features, _ = careers(spark, sf)
    both = ranking.rank_counterfactual(ranking.rank_careers(profiles(spark, sf), features), features)
    shown = both.select("session_id", "ranked_alt", F.explode(F.slice("ranked", 1, 5)).alias("c"))
    return shown.select("session_id", F.col("c.career_id").alias("current_career"),
                        ranking.counterfactual_career(F.col("ranked_alt"), F.col("c.career_id")).alias("new_career"))


def _second(name: str) -> str:
    """The definition of a ranking step rewritten to read the changed profile labels."""
    sql = CTES[name]
    for n in ("pl", "hit", "ovl", "parts", "scored"):
        sql = re.sub(rf"\b{n}\b(?!\.)", f"{n}2", sql) if n != "pl" else re.sub(r"\bpl\b", "pl2", sql)
    return sql.replace("hit.", "hit2.")


WHATIF = {
    "pl2": "SELECT session_id, label, max(weight) AS weight FROM (SELECT * FROM pl UNION ALL SELECT session_id, 'large promo kit', 1.0 FROM pr) GROUP BY session_id, label",
    "hit2": _second("hit"), "ovl2": _second("ovl"), "parts2": _second("parts"), "scored2": _second("scored"), "rnk2": _second("rnk"),
    "before": shown_sql("rnk"), "after": shown_sql("rnk2"),
}


@query(with_ctes("""SELECT coalesce(b.session_id, a.session_id) AS session_id, coalesce(b.career_id, a.career_id) AS career_id, b.rank AS before_rank, b.match_score AS before_score,
    a.rank AS after_rank, a.match_score AS after_score FROM before b FULL OUTER JOIN after a ON a.session_id = b.session_id AND a.career_id = b.career_id
    WHERE NOT (a.rank IS NOT DISTINCT FROM b.rank AND a.match_score IS NOT DISTINCT FROM b.match_score)""", "rnk", **WHATIF))
def what_if_added_skill(spark, sf):
    features, _ = careers(spark, sf)
    delta = ranking.what_if(profiles(spark, sf), features, F.lit("  Large  Promo Kit "))
    return delta.select("session_id", "career_id", F.col("before_rank").cast("long").alias("before_rank"), "before_score",
                        F.col("after_rank").cast("long").alias("after_rank"), "after_score")


EVIDENCED = """SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, lower(label) AS label FROM ev WHERE event_type IN ('purchase', 'signup')"""
GAP = {
    "evd": EVIDENCED,
    "gap": """SELECT s.session_id, s.career_id, s.rank, t.skill, t.rank AS pos, EXISTS (SELECT 1 FROM evd WHERE evd.session_id = s.session_id AND (evd.label = t.label OR contains(evd.label, t.label) OR contains(t.label, evd.label))) AS has
        FROM (SELECT * FROM rnk WHERE rank <= 5) s JOIN tops t ON t.career_id = s.career_id""",
    "gaps": """SELECT session_id, career_id, count(*) FILTER (WHERE has) AS n_matched, coalesce(string_agg(skill, ',' ORDER BY pos) FILTER (WHERE NOT has), '') AS missing,
        round(count(*) FILTER (WHERE has) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM gap GROUP BY ALL""",
}
BAND = "CASE WHEN coverage >= 0.75 AND n_matched >= 2 THEN 'ready_now' WHEN coverage >= 0.45 THEN 'near_ready' ELSE 'build_foundation' END"


def _gaps(spark, sf):
    features, _ = careers(spark, sf)
    rows = ranking.explode_ranked(
        ranking.rank_careers(profiles(spark, sf), features, 5).select("session_id", "ranked"), column="ranked")
    people = profiles(spark, sf).select("session_id", "journey_mode", guidance.evidenced_skills(F.col("skills"), F.col("experiences")).alias("evidenced"))
    tops = features.select("career_id", "title", "top_skills")
    return rows.join(people, "session_id").join(tops, "career_id").withColumn("g", guidance.matched_missing(F.col("evidenced"), F.col("top_skills")))


@query(with_ctes(f"SELECT *, {BAND} AS band FROM gaps", "rnk", "tops", "ev", **GAP))
def skill_gap_and_readiness(spark, sf):
    g = F.col("g")
    return _gaps(spark, sf).where(F.size("top_skills") > 0).select(
        "session_id", "career_id", F.size(g.matched).cast("long").alias("n_matched"), F.array_join(g.missing, ",").alias("missing"),
        F.round(g.coverage, 6).alias("coverage"), guidance.readiness_band(g.coverage, g.strength).alias("band"))


@query(with_ctes("""SELECT session_id, career_id, 'Career ' || career_id || ' fresher|Career ' || career_id || ' entry level|Career ' || career_id || ' thực tập' ||
    CASE WHEN missing <> '' THEN '|Career ' || career_id || ' ' || split_part(missing, ',', 1) ELSE '' END AS queries FROM gaps""", "rnk", "tops", "ev", **GAP))
def readiness_search_queries(spark, sf):
    none = F.array().cast("array<string>")
    return _gaps(spark, sf).where(F.size("top_skills") > 0).select(
        "session_id", "career_id", F.array_join(guidance.search_queries(F.col("title"), none, F.col("g.missing")), "|").alias("queries"))


@query(with_ctes("""SELECT g.session_id, g.career_id, CAST(w.week AS BIGINT) AS week, coalesce(nullif(split_part(missing, ',', w.week), ''), m.skill, 'kỹ năng cốt lõi của vai trò') AS focus
    FROM gaps g CROSS JOIN (SELECT CAST(unnest([1, 2, 3, 4]) AS INT) AS week) w LEFT JOIN (SELECT session_id, career_id, skill, row_number() OVER (PARTITION BY session_id, career_id ORDER BY pos) AS k FROM gap WHERE has) m
    ON m.session_id = g.session_id AND m.career_id = g.career_id AND m.k = (w.week - 1) % greatest(g.n_matched, 1) + 1""", "rnk", "tops", "ev", **GAP))
def weekly_action_focus(spark, sf):
    rows = _gaps(spark, sf).where(F.size("top_skills") > 0)
    weeks = rows.select("session_id", "career_id", F.explode(guidance.weekly_actions(F.col("g.missing"), F.col("g.matched"))).alias("a"))
    focus = F.coalesce(F.nullif(F.regexp_extract("a.action", "«([^»]*)»", 1), F.lit("")), F.nullif(F.regexp_extract("a.action", r"\((.*)\)", 1), F.lit("")))
    return weeks.select("session_id", "career_id", F.col("a.week").cast("long").alias("week"), focus.alias("focus"))


@query(with_ctes("SELECT session_id, label, label || '' AS evidence_key FROM evd", "ev", evd=EVIDENCED))
def evidenced_skill_rows(spark, sf):
    rows = guidance.evidenced_skill_rows(profiles(spark, sf))
    return rows.select("session_id", F.lower("name").alias("label"), F.lower("name").alias("evidence_key"))


@query(with_ctes("""SELECT session_id, CASE greatest(e1, e2, e3, e4, e5) WHEN e1 THEN 'ky_thuat' WHEN e2 THEN 'phan_tich' WHEN e3 THEN 'sang_tao' WHEN e4 THEN 'xa_hoi' ELSE 'quan_ly' END AS dominant,
    round(least(1.0, (SELECT count(DISTINCT label) FROM ev WHERE event_type = 'purchase' AND CAST(user_id AS VARCHAR) = pr.session_id) / 2.0) * 0.4
      + least(1.0, (SELECT count(DISTINCT label) FROM ev WHERE event_type = 'click' AND CAST(user_id AS VARCHAR) = pr.session_id) / 2.0) * 0.3 + greatest(e1, e2, e3, e4, e5) * 0.3, 3) AS strength,
    true AS personal FROM pr""", "pr", "ev"))
def profile_signal(spark, sf):
    d = F.col("dimensions")
    return profiles(spark, sf).select(
        "session_id", scoring.dominant_dimension(d).alias("dominant"), scoring.signal_strength(F.col("skills"), F.col("interests"), d).alias("strength"),
        scoring.has_personal_signal(F.col("skills"), F.col("interests"), F.col("experiences"), F.col("job_goal"), d).alias("personal"))


@query(with_ctes("""SELECT session_id, array_to_string(list_filter([CASE WHEN e1 > 0.05 THEN 'ky_thuat:' || format('{:.2f}', e1) END, CASE WHEN e2 > 0.05 THEN 'phan_tich:' || format('{:.2f}', e2) END,
    CASE WHEN e3 > 0.05 THEN 'sang_tao:' || format('{:.2f}', e3) END, CASE WHEN e4 > 0.05 THEN 'xa_hoi:' || format('{:.2f}', e4) END, CASE WHEN e5 > 0.05 THEN 'quan_ly:' || format('{:.2f}', e5) END], lambda x: x IS NOT NULL)
    || coalesce((SELECT list(label ORDER BY k, label) FROM (SELECT DISTINCT CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 END AS k, label FROM ev WHERE CAST(user_id AS VARCHAR) = pr.session_id AND event_type IN ('purchase', 'view', 'click'))), [])
    || ['signup'] || coalesce((SELECT list(DISTINCT label ORDER BY label) FROM ev WHERE CAST(user_id AS VARCHAR) = pr.session_id AND event_type = 'signup'), []), ' | ') AS profile_text FROM pr""", "pr", "ev"))
def profile_retrieval_text(spark, sf):
    return profiles(spark, sf).select("session_id", scoring.profile_text(
        F.col("dimensions"), F.col("skills"), F.col("interests"), F.col("experiences"), F.col("job_goal"), F.col("evidence_quotes")).alias("profile_text"))


ROUTES = """SELECT career_id, list(t ORDER BY t) AS ts FROM (SELECT DISTINCT p_brand || '/' || p_size AS career_id, CASE p_type WHEN 'ECONOMY' THEN 'university' WHEN 'SMALL' THEN 'college' WHEN 'MEDIUM' THEN 'certificate' ELSE 'university' END AS t
    FROM part) GROUP BY 1"""


def _route_careers(spark, sf, by_size=False):
    """Routes of every brand, or of every brand and size, some of which have one route only."""
    career = F.concat_ws("/", "p_brand", "p_size") if by_size else F.col("p_brand")
    kind = F.when(F.col("p_type") == "SMALL", "college").when(F.col("p_type") == "MEDIUM", "certificate").otherwise("university")
    rows = table(spark, sf, "part").select(career.alias("career_id"), kind.alias("t")).distinct()
    route = F.struct(F.col("t").alias("type"), F.col("t").alias("label"), F.lit("").alias("detail"), F.array(F.lit("")).alias("first_steps"))
    return rows.groupBy("career_id").agg(F.array_sort(F.collect_list(route)).alias("routes"))


@query(with_ctes("""SELECT career_id, array_to_string(full_routes, ',') AS explore_routes, array_to_string(list_transform(list_sort(list_transform(full_routes, lambda x, i:
    CASE x WHEN 'certificate' THEN '0' WHEN 'vocational' THEN '1' WHEN 'college' THEN '2' WHEN 'university' THEN '3' ELSE '9' END || i || x)), lambda x: x[3:]), ',') AS launch_routes
    FROM (SELECT career_id, CASE WHEN len(list_filter(two, lambda x: x <> 'university')) > 0 THEN two ELSE two || ['vocational'] END AS full_routes FROM (
    SELECT career_id, CASE WHEN len(ts) < 2 THEN ts || ['certificate'] ELSE ts END AS two FROM rt))""", rt=ROUTES))
def completed_routes(spark, sf):
    def kinds(mode):
        return F.array_join(F.transform(guidance.ensure_routes(F.col("routes"), F.lit(mode)), lambda r: r.type), ",")

    return _route_careers(spark, sf, True).select("career_id", kinds("explore").alias("explore_routes"), kinds("launch").alias("launch_routes"))


@query(with_ctes("""SELECT 'fewer than two routes' AS rule, career_id AS item FROM rt WHERE len(ts) < 2
    UNION ALL SELECT 'no route outside university', career_id FROM rt WHERE len(list_filter(ts, lambda x: x <> 'university')) = 0""", rt=ROUTES))
def route_violations(spark, sf):
    return quality.route_violations(_route_careers(spark, sf, True))


@query(with_ctes("""SELECT career_id, coalesce(string_agg(skill || ':' || CASE rank WHEN 1 THEN 'nen-hoc-truoc' ELSE 'hoc-trong-truong' END, ',' ORDER BY rank), '') AS roadmap FROM cfeat LEFT JOIN (SELECT * FROM tops WHERE rank <= 4) USING (career_id) GROUP BY career_id""",
                 "cfeat", "tops"))
def roadmap_fallback(spark, sf):
    features, _ = careers(spark, sf)
    none = F.array().cast("array<struct<skill:string,status:string>>")
    steps = guidance.ensure_roadmap(none, F.col("top_skills"))
    return features.select("career_id", F.array_join(F.transform(steps, lambda s: F.concat(s.skill, F.lit(":"), s.status)), ",").alias("roadmap"))


@query(with_ctes("SELECT session_id, career_id FROM rnk WHERE rank <= 5 AND career_id IN (SELECT career_id FROM creg WHERE rank <= 2 AND region = 'ASIA')", "rnk", "creg"))
def allowed_research_requests(spark, sf):
    features, _ = careers(spark, sf)
    shown = ranking.explode_ranked(ranking.rank_careers(profiles(spark, sf), features, 5)).select("session_id", "career_id")
    allowed = features.where(F.array_contains(F.slice("top_regions", 1, 2), "ASIA")).select("career_id")
    return shown.join(allowed, "career_id", "left_semi")


@query(with_ctes("SELECT count(*) AS profiles, CAST(count(*) AS BIGINT) AS same_sets FROM pr", "pr"))
def region_never_filters(spark, sf):
    features, _ = careers(spark, sf)
    people = profiles(spark, sf)
    n = features.count()
    with_region = ranking.rank_careers(people, features, n)
    without = ranking.rank_careers(
        people.withColumn("constraints", F.col("constraints").withField("region_pref", F.lit(None).cast("string"))), features, n, RankWeights())
    audit = quality.invariance_audit(with_region, without, "session_id")
    return audit.agg(F.count(F.lit(1)).alias("profiles"), F.count_if("same_candidates").alias("same_sets"))


@query()
def paired_region_audit(spark, sf):
    features, _ = careers(spark, sf)
    people = profiles(spark, sf)
    other = people.withColumn("constraints", F.col("constraints").withField("region_pref", F.lit("ASIA")))
    return quality.invariance_audit(ranking.rank_careers(people, features), ranking.rank_careers(other, features), "session_id")


@query(with_ctes("SELECT count(DISTINCT session_id) AS personas, count(DISTINCT career_id) FILTER (WHERE rank = 1) AS distinct_top1, (SELECT count(DISTINCT t) FROM (SELECT string_agg(career_id, ',' ORDER BY rank) AS t FROM rnk WHERE rank <= 3 GROUP BY session_id)) AS distinct_top3 FROM rnk", "rnk"))
def persona_distinctness(spark, sf):
    return quality.persona_distinctness(ranked(spark, sf)).drop("passed")


@query(with_ctes("SELECT career_id FROM rnk WHERE rank <= 20 GROUP BY career_id HAVING count(DISTINCT session_id) < (SELECT count(*) FROM pr)", "rnk"))
def careers_outside_some_top20(spark, sf):
    rows = ranking.explode_ranked(ranked(spark, sf))
    total = profiles(spark, sf).agg(F.count(F.lit(1)).alias("total"))
    counts = rows.groupBy("career_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(total, F.col("n") < F.col("total"), "inner").select("career_id")


def _recommendations(spark, sf):
    p = postings(spark, sf)
    titles = career_titles(spark, sf)
    stats = cut_lineage(market.career_stats(p, titles))
    base = career_dimensions(p).join(titles, "career_id").join(_route_careers(spark, sf), "career_id", "left")
    none = F.array().cast("array<string>")
    kb = base.withColumn("routes", F.coalesce("routes", F.array().cast("array<struct<type:string,label:string,detail:string,first_steps:array<string>>>"))).withColumn(
        "skill_roadmap", F.array().cast("array<struct<skill:string,status:string>>")).withColumn("title_patterns", none).withColumn("entry_role_aliases", F.lit(None).cast("array<string>"))
    return recommend(profiles(spark, sf), cut_lineage(kb), stats, "s1")


REC_SQL = with_ctes("""SELECT s.session_id, s.rank, s.is_stretch, s.career_id, s.match_score, coalesce(r.demand_count_90d, a.demand_count_90d, 0) AS demand_count_90d,
    CASE WHEN r.career_id IS NOT NULL THEN 'region' WHEN a.career_id IS NOT NULL THEN 'national' ELSE 'absent' END AS market_scope FROM shown s JOIN pr USING (session_id)
    LEFT JOIN cs r ON r.career_id = s.career_id AND r.region = pr.region_pref LEFT JOIN cs a ON a.career_id = s.career_id AND a.region = 'all'""",
    "rnk", "cs", "pr", shown=shown_sql("rnk"))


@query(REC_SQL)
def recommendation_rows(spark, sf):
    rows = _recommendations(spark, sf)
    return rows.select("session_id", F.col("rank").cast("long").alias("rank"), "is_stretch", "career_id", "match_score", "demand_count_90d", "market_scope")


@query()
def recommendation_explanations(spark, sf):
    rows = _recommendations(spark, sf)
    why = F.col("why")
    return rows.select(
        "session_id", "career_id", "is_stretch", why.from_you[0].quote.alias("quote"), why.from_you[0].reason.alias("reason"),
        F.array_join(F.transform(why.from_market, lambda m: m.stat), " | ").alias("market"), why.counterfactual.alias("counterfactual"))


@query()
def grounding_audit(spark, sf):
    from jobatlas.operators.explain import grounding_violations

    rows = _recommendations(spark, sf)
    found = grounding_violations(rows, ["session_id", "career_id"])
    return rows.select("session_id", "career_id").distinct().join(found, ["session_id", "career_id"], "left").groupBy(
        F.coalesce("problem", F.lit("grounded")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query()
def readiness_audit(spark, sf):
    rows = _recommendations(spark, sf).withColumn("key", F.concat_ws("/", "session_id", "career_id"))
    found = quality.readiness_violations(rows, "key")
    launch = rows.where(F.col("job_readiness").isNotNull()).groupBy("job_readiness.band").agg(F.count(F.lit(1)).alias("n"))
    return launch.join(found.agg(F.count(F.lit(1)).alias("violations")), F.lit(True))


@query()
def rubric_summary(spark, sf):
    from jobatlas.operators.evaluation import rubric, rubric_summary
    from jobatlas.operators.explain import grounding_violations

    rows = _recommendations(spark, sf)
    bad = grounding_violations(rows, ["session_id", "career_id"]).select("session_id", "career_id").distinct().withColumn("_bad", F.lit(True))
    marked = rows.join(bad, ["session_id", "career_id"], "left").withColumn("grounded", F.col("_bad").isNull()).withColumn("mode", F.col("journey_mode"))
    return rubric_summary(rubric(marked))
