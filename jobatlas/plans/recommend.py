"""The recommendation job: all profiles against all careers in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.functions.scoring import RankWeights, has_personal_signal
from jobatlas.operators import explain, guidance, ranking
from jobatlas.operators.market import ALL, career_market

CARRY = ("journey_mode", "dimensions", "skills", "interests", "experiences", "evidence_quotes", "job_goal", "region_pref", "_vec")


def career_features(careers: DataFrame, stats: DataFrame) -> DataFrame:
    """Careers with their national market numbers; a career outside the snapshot counts zero."""
    national = stats.where(F.col("region") == ALL).select(
        "career_id", "demand_count_90d", "trend_pct", "top_skills", "top_regions"
    )
    empty = F.array().cast("array<string>")
    return careers.join(national, "career_id", "left").withColumns({
        "top_skills": F.coalesce("top_skills", empty), "top_regions": F.coalesce("top_regions", empty),
    })


def recommend(profiles: DataFrame, careers: DataFrame, stats: DataFrame, snapshot: str | None = None,
              weights: RankWeights = RankWeights()) -> DataFrame:
    """Five recommendations and one stretch per profile with market, routes, readiness and grounded reasons.

    Profiles without any personal signal are left out.
    """
    personal = profiles.where(has_personal_signal(
        F.col("skills"), F.col("interests"), F.col("experiences"), F.col("job_goal"), F.col("dimensions")
    ))
    features = career_features(careers, stats)
    ranked = ranking.rank_careers(personal, features, weights=weights)
    ranked = ranking.rank_counterfactual(ranked, features, weights)
    ready = ranking.with_stretch(ranked).withColumn("region_pref", F.coalesce("constraints.region_pref", F.lit(ALL)))
    rows = ranking.recommendation_rows(ready, (*CARRY, "ranked_alt", "cf_from", "cf_to"))
    rows = rows.withColumn("cf_career", ranking.counterfactual_career(F.col("ranked_alt"), F.col("career_id"))).drop("ranked_alt")
    titles = careers.select(F.col("career_id").alias("cf_career"), F.col("title").alias("cf_title"))
    details = careers.select(
        "career_id", "title", F.col("dimensions").alias("career_dimensions"), "routes", "skill_roadmap",
        F.coalesce("entry_role_aliases", "title_patterns").alias("role_aliases"),
    )
    requests = rows.join(details, "career_id").join(titles, "cf_career", "left").withColumn("region", F.col("region_pref"))
    full = career_market(requests, stats, snapshot)
    evidenced = guidance.evidenced_skills(F.col("skills"), F.col("experiences"))
    text = explain.counterfactual_text(F.col("cf_to"), F.col("cf_from"), F.coalesce("cf_title", "cf_career"))
    return full.select(
        "session_id", "rank", "is_stretch", "career_id", "title", "match_score", "region", "market_scope", "source_note",
        "demand_count_90d", "entry_level_count_90d", "salary_p25_trieu", "salary_p50_trieu", "salary_p75_trieu",
        "salary_sample_count", "trend_pct", "low_confidence", "top_skills", "skills", "interests", "experiences",
        "evidence_quotes", "dimensions", "job_goal", "journey_mode",
        guidance.ensure_routes(F.col("routes"), F.col("journey_mode")).alias("routes"),
        guidance.ensure_roadmap(F.col("skill_roadmap"), F.col("top_skills")).alias("skill_roadmap"),
        guidance.job_readiness(F.col("journey_mode"), evidenced, F.col("top_skills"), F.col("title"), F.col("role_aliases"), weights)
        .alias("job_readiness"),
        explain.template_why(text).alias("why"),
    )
