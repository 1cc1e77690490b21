"""Raw postings to normalized postings, and the offline chain up to the market tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobatlas.functions.hashing import content_hash, posting_input_hash
from jobatlas.functions.parsing import (
    determine_seniority, map_region, parse_experience, parse_posted_date, parse_salary, strip_space,
)
from jobatlas.operators import market, matching
from jobatlas.operators.dedupe import deduplicate_postings

REQUIRED = ("id", "source", "url", "title", "company", "region_raw", "salary_raw", "description", "crawled_at")
#: Required keys whose value may be null.
NULLABLE = ("region_raw", "salary_raw")
MIN_DESCRIPTION = 100
EXTRACTION_VERSION = "skill-extraction-v1"
MAPPING_VERSION = "career-mapping-v1"
POSTING_COLUMNS = (
    "id", "source", "url", "title", "company", "region", "region_raw", "salary_min_trieu", "salary_max_trieu", "salary_raw",
    "experience_min_years", "experience_raw", "seniority", "seniority_confidence", "seniority_reason", "posted_date",
    "posted_date_raw", "description", "skills", "crawled_at",
)


def tag_normalized(raw: DataFrame, as_of: Column) -> DataFrame:
    """Every raw posting with its normalized fields and a ``reject_reason`` (null when kept).

    A column ``missing_keys`` of the scan names keys that a record lacks; a null value of a NULLABLE key is no fault.
    """
    present = F.lit(True)
    for field in REQUIRED:
        if field not in NULLABLE:
            present = present & F.col(field).isNotNull()
    if "missing_keys" in raw.columns:
        present = present & ~F.arrays_overlap(F.coalesce("missing_keys", F.array().cast("array<string>")), F.array(*map(F.lit, REQUIRED)))
    reason = F.when(~present, "invalid").when(F.length("description") < MIN_DESCRIPTION, "short")
    step = raw.select(
        "*", reason.alias("reject_reason"), parse_salary(F.col("salary_raw")).alias("_pay"),
        parse_experience(F.col("experience_raw")).alias("experience_min_years"),
    ).withColumn("_level", determine_seniority(F.col("title"), F.col("experience_min_years")))
    return step.select(
        "id", "source", "url", strip_space(F.col("title")).alias("title"), strip_space(F.col("company")).alias("company"),
        map_region(F.col("region_raw")).alias("region"), "region_raw",
        F.col("_pay.salary_min").alias("salary_min_trieu"), F.col("_pay.salary_max").alias("salary_max_trieu"), "salary_raw",
        "experience_min_years", F.coalesce("experience_raw", F.lit("")).alias("experience_raw"),
        F.col("_level.seniority").alias("seniority"), F.col("_level.confidence").alias("seniority_confidence"),
        F.col("_level.reason").alias("seniority_reason"),
        parse_posted_date(F.col("posted_date_raw"), F.col("crawled_at"), as_of).alias("posted_date"), "posted_date_raw",
        "description", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"), "crawled_at", "reject_reason",
    )


def normalize(raw: DataFrame, as_of: Column, dedupe: bool = True) -> DataFrame:
    kept = tag_normalized(raw, as_of).where(F.col("reject_reason").isNull()).select(*POSTING_COLUMNS)
    return deduplicate_postings(kept) if dedupe else kept


def enrich(postings: DataFrame, aliases: DataFrame, taxonomy_version: str, taxonomy_hash: str) -> DataFrame:
    """Postings with dictionary skills and extraction provenance."""
    texts = postings.select("id", matching.posting_text(F.col("title"), F.col("description")).alias("text"))
    tagged = matching.tag_skills(texts, aliases).withColumnRenamed("skills", "_tagged")
    found = F.coalesce("_tagged", F.array().cast("array<string>"))
    source = content_hash(*[F.col(c) for c in sorted(postings.columns)])
    meta = F.struct(
        F.lit(EXTRACTION_VERSION).alias("version"), F.lit(taxonomy_version).alias("taxonomy_version"),
        F.lit(taxonomy_hash).alias("taxonomy_hash"), F.lit("dictionary-only").alias("model_id"),
        F.lit("title+description_before_benefits").alias("text_scope"), source.alias("posting_source_hash"),
        posting_input_hash(F.col("id"), F.col("title"), F.col("description")).alias("posting_input_hash"),
        found.alias("dictionary_skills"), (F.size(found) < 3).alias("low_signal"),
        F.when(F.size(found) < 3, "dictionary_fallback").otherwise("not_needed").alias("status"),
    )
    return postings.withColumn("_source", source).join(tagged, "id", "left").select(
        *[c for c in postings.columns if c != "skills"], found.alias("skills"),
        F.array().cast("array<string>").alias("new_skills"),
        meta.withField("posting_source_hash", F.col("_source")).alias("skill_extraction"),
    )


def map_careers(enriched: DataFrame, patterns: DataFrame, kb_hash: str) -> DataFrame:
    """Enriched postings with a career and mapping provenance."""
    decided = matching.map_postings(enriched, patterns)
    inputs = content_hash(*[F.col(c) for c in sorted(enriched.columns)])
    meta = F.struct(
        F.lit(MAPPING_VERSION).alias("version"), F.lit(kb_hash).alias("kb_hash"), inputs.alias("mapping_input_hash"),
        F.col("method"), F.col("reason"), F.col("matched_pattern"), F.lit("unvalidated").alias("confidence_tier"),
        F.lit(True).alias("provisional"),
    )
    return decided.select(*enriched.columns, "career_id", meta.alias("career_mapping"))


def market_tables(mapped: DataFrame, titles: DataFrame, window_end=None) -> dict[str, DataFrame]:
    end = window_end or market.latest_day(mapped)
    return {
        "career_stats": market.career_stats(mapped, titles, end),
        "skill_stats": market.skill_stats(mapped, end),
        "market_meta": market.market_meta(mapped, end),
        "career_lineage": market.career_lineage(mapped, end),
    }
