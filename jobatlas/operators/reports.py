"""Coverage, run, manifest, traceability and profiling reports as small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jobatlas.functions.numbers import round_exact
from jobatlas.functions.parsing import salary_value
from jobatlas.functions.text import norm_match
from jobatlas.operators.market import UNMAPPED, exact_percentiles, with_all_region


def _known(column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", "unknown").otherwise(F.col(column))


def coverage_by(mapped: DataFrame, field: str) -> DataFrame:
    """Mapped and unmapped postings per value of a field."""
    groups = mapped.groupBy(_known(field).alias(field)).agg(
        F.count_if(F.col("career_id") != UNMAPPED).alias("mapped"), F.count(F.lit(1)).alias("denominator")
    )
    return groups.select(
        field, "mapped", (F.col("denominator") - F.col("mapped")).alias("unmapped"), "denominator",
        round_exact(F.col("mapped") / F.col("denominator"), 4).alias("coverage"),
    )


def mapping_report(mapped: DataFrame) -> DataFrame:
    """One row: totals, coverage, ambiguity; needs ``career_id`` and ``reason``."""
    n, hit = F.count(F.lit(1)), F.count_if(F.col("career_id") != UNMAPPED)
    return mapped.agg(
        n.alias("postings_total"), hit.alias("mapped_postings"), (n - hit).alias("unmapped_postings"),
        F.count_if(F.col("reason") == "ambiguous_title_pattern").alias("ambiguous_postings"),
        round_exact(F.try_divide(hit, n), 4).alias("mapping_coverage"),
    )


def career_counts(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("career_id").agg(F.count(F.lit(1)).alias("n"))


def extraction_report(enriched: DataFrame, input_price: float | None = None, output_price: float | None = None) -> DataFrame:
    """One row over enriched postings; tokens are estimated as characters / 4.

    Needs ``skills, new_skills, low_signal, status, input_chars, output_chars``.
    """
    if any(p is not None and p < 0 for p in (input_price, output_price)):
        raise ValueError("token prices must be non-negative")
    tokens_in, tokens_out = F.ceil(F.sum("input_chars") / 4), F.ceil(F.sum("output_chars") / 4)
    priced = input_price is not None and output_price is not None
    cost = (
        round_exact(tokens_in * F.lit(input_price) / 1e6 + tokens_out * F.lit(output_price) / 1e6, 6)
        if priced else F.lit(None).cast("double")
    )
    n = F.count(F.lit(1))
    return enriched.agg(
        n.alias("postings_total"),
        F.count_if("low_signal").alias("low_signal_postings"),
        F.count_if(F.size("skills") == 0).alias("zero_skill_postings"),
        round_exact(F.coalesce(F.avg(F.size("skills")), F.lit(0.0)), 3).alias("average_skills_per_posting"),
        F.sum(F.size("new_skills")).cast("long").alias("new_skill_candidates"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in ("not_needed", "dictionary_fallback", "cache_hit", "success")],
        tokens_in.cast("long").alias("estimated_input_tokens"), tokens_out.cast("long").alias("estimated_output_tokens"),
        cost.alias("estimated_cost_usd"), round_exact(F.try_divide(cost * 1000, n), 6).alias("estimated_cost_per_1k_usd"),
    )


def candidate_terms(labels: DataFrame, column: str = "label", minimum: int = 1) -> DataFrame:
    """Frequency of new-term candidates; ``minimum`` 5 gives the promotion list."""
    counts = labels.groupBy(norm_match(F.col(column)).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= minimum) & (F.col("term") != ""))


def manifest_counts(postings: DataFrame) -> DataFrame:
    """Counts by source, by region, by both and in total in one pass of grouping sets."""
    has_pay = F.col("salary_min_trieu").isNotNull() | F.col("salary_max_trieu").isNotNull()
    base = postings.groupBy("source", "region").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(has_pay).alias("with_salary"),
        F.count("experience_min_years").alias("with_experience"),
        *[F.count_if(F.col("seniority") == s).alias(s) for s in ("entry", "mid", "senior", "unknown")],
    )
    s, r = F.col("source"), F.col("region")
    sums = base.groupingSets([[s], [r], [s, r], []], s, r).agg(
        F.grouping_id().alias("level"),
        *[F.sum(c).alias(c) for c in ("n", "with_salary", "with_experience", "entry", "mid", "senior", "unknown")],
    )
    level = F.element_at(F.array(*[F.lit(x) for x in ("source_region", "source", "region", "total")]), F.col("level").cast("int") + 1)
    return sums.select(
        level.alias("level"), "source", "region", "n", "with_salary", "with_experience", "entry", "mid", "senior", "unknown",
        round_exact(F.col("with_salary") / F.col("n") * 100, 2).alias("salary_pct"),
        round_exact(F.col("with_experience") / F.col("n") * 100, 2).alias("experience_pct"),
    )


def drop_rate(raw: DataFrame, processed: DataFrame) -> DataFrame:
    a, b = raw.agg(F.count(F.lit(1)).alias("raw_total")), processed.agg(F.count(F.lit(1)).alias("normalized_total"))
    both = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")
    gone = F.col("raw_total") - F.col("normalized_total")
    return both.select(
        "raw_total", "normalized_total", gone.alias("dropped_or_deduped"),
        round_exact(F.coalesce(F.try_divide(gone, F.col("raw_total")), F.lit(0.0)) * 100, 2).alias("dedupe_rate_pct"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts with their share in percent; the share is taken over the few counted rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        F.lit(column).alias("field"), "value", "n", round_exact(F.col("n") / F.sum("n").over(W.partitionBy()) * 100, 1).alias("pct")
    )


def normalization_report(rows: DataFrame) -> DataFrame:
    """One row over the tagged normalizer output ``reject_reason, salary bounds, experience``."""
    ok = F.col("reject_reason").isNull()
    pay = ok & (F.col("salary_min_trieu").isNotNull() | F.col("salary_max_trieu").isNotNull())
    n = F.count_if(ok)
    return rows.agg(
        F.count(F.lit(1)).alias("total_loaded"), F.count_if(F.col("reject_reason") == "invalid").alias("dropped_invalid"),
        F.count_if(F.col("reject_reason") == "short").alias("dropped_short"), n.alias("kept"),
        F.count_if(pay).alias("with_salary"), F.count_if(ok & F.col("experience_min_years").isNotNull()).alias("with_experience"),
        round_exact(F.coalesce(F.try_divide(F.count_if(pay) * 100, n), F.lit(0.0)), 1).alias("salary_pct"),
    )


def traceability(postings: DataFrame, audit: DataFrame) -> DataFrame:
    """Demand, samples and percentiles of audited (career_id, region) pairs; ``all`` is national.

    The audit list prunes the postings first; contributing ids come from ``traceability_ids``.
    """
    rows = traceability_ids(postings, audit)
    keys = ["career_id", "region"]
    core = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("demand_count"), F.count("salary").alias("salary_samples"))
    pay = exact_percentiles(rows, keys, "salary", {"salary_p25": 0.25, "salary_p50": 0.5, "salary_p75": 0.75})
    enough = F.coalesce("salary_samples", F.lit(0)) >= 5
    return audit.select(*keys).join(core, keys, "left").join(pay, keys, "left").select(
        *keys, F.coalesce("demand_count", F.lit(0)).alias("demand_count"),
        F.coalesce("salary_samples", F.lit(0)).alias("salary_samples"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("salary_p25", "salary_p50", "salary_p75")],
    )


def traceability_ids(postings: DataFrame, audit: DataFrame) -> DataFrame:
    """Long table of the postings behind each audited pair, without the negative-salary rule."""
    value = (F.coalesce("salary_min_trieu", "salary_max_trieu") + F.coalesce("salary_max_trieu", "salary_min_trieu")) / 2
    rows = with_all_region(postings.select("id", "career_id", "region", value.alias("salary")))
    return rows.join(audit.select("career_id", "region"), ["career_id", "region"], "left_semi")


def insights(postings: DataFrame, group_careers: list[str]) -> DataFrame:
    """Share of a career group, regional shares and pay by seniority as ``insight, item, numerator, denominator, value``."""
    value = salary_value(F.col("salary_min_trieu"), F.col("salary_max_trieu"))
    base = postings.groupBy("region", "seniority", F.col("career_id").isin(*group_careers).alias("in_group"),
                            (F.col("career_id") != UNMAPPED).alias("is_mapped")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("pay"), F.count(value).alias("paid")
    )
    total = base.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("is_mapped"), F.col("n"))).alias("mapped"))
    parts = base.select(F.explode(F.array_compact(F.array(
        F.when(F.col("in_group"), F.struct(F.lit("group_share").alias("insight"), F.lit("group").alias("item"),
                                          F.col("n").cast("double").alias("num"), F.lit(0.0).alias("den"))),
        F.struct(F.lit("region_share").alias("insight"), F.col("region").alias("item"), F.col("n").cast("double").alias("num"), F.lit(0.0).alias("den")),
        F.when(F.col("seniority").isin("entry", "senior"), F.struct(
            F.lit("mean_salary").alias("insight"), F.col("seniority").alias("item"), F.coalesce("pay", F.lit(0.0)).alias("num"), F.col("paid").cast("double").alias("den"))),
    ))).alias("p"))
    sums = parts.groupBy("p.insight", "p.item").agg(F.sum("p.num").alias("num"), F.sum("p.den").alias("den"))
    joined = sums.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k")
    den = F.when(F.col("insight") == "group_share", F.col("mapped")).when(F.col("insight") == "region_share", F.col("total")).otherwise(F.col("den"))
    return joined.select(
        "insight", "item", round_exact(F.col("num"), 1).alias("numerator"), den.cast("long").alias("denominator"),
        round_exact(F.try_divide(F.col("num"), den) * F.when(F.col("insight") == "mean_salary", 1).otherwise(100), 1).alias("value"),
    )


# City words a posting in the rest bucket should not contain.
CITY_WORDS = r"hà nội|hồ chí minh|hcm|đà nẵng"


def qa_errors(sample: DataFrame) -> DataFrame:
    """Heuristic parse error counts and rates over a sample."""
    low_exp = F.lower(F.coalesce("experience_raw", F.lit("")))
    flags = {
        "salary_parse_error": F.coalesce("salary_raw", F.lit("")).rlike(r"\d") & F.col("salary_min_trieu").isNull() & F.col("salary_max_trieu").isNull(),
        "region_map_error": (F.col("region") == "other") & F.lower(F.coalesce("region_raw", F.lit(""))).rlike(CITY_WORDS),
        "date_parse_error": F.col("posted_date").isNull(),
        "exp_parse_error": low_exp.contains("kinh nghiệm") & F.col("experience_min_years").isNull() & ~low_exp.rlike("không yêu cầu|chưa có"),
    }
    counts = sample.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("errors")) for k in flags],
                    F.struct(F.lit("seniority_error").alias("check"), F.lit(0).cast("long").alias("errors")))
    return counts.select("n", F.explode(pairs).alias("p")).select(
        "p.check", "p.errors", "n", round_exact(F.coalesce(F.try_divide(F.col("p.errors"), F.col("n")), F.lit(0.0)) * 100, 1).alias("error_pct")
    )


def ingest_metrics(attempts: DataFrame, limit: int | None = None) -> DataFrame:
    """Per source counters of an attempt log ``source, url, status, outcome, resumed``."""
    sums = attempts.groupBy("source").agg(
        F.count(F.lit(1)).alias("discovered_urls"), F.count_if(F.col("resumed")).alias("resumed_records"),
        F.count_if(~F.col("resumed")).alias("attempted_urls"), F.count_if(F.col("outcome") == "inactive").alias("skipped_inactive"),
        F.count_if(F.col("outcome") == "parse_error").alias("parse_errors"),
        F.count_if((F.col("status") != 200) & ~F.col("resumed")).alias("http_errors"),
        F.count_if((F.col("outcome") == "ok") | F.col("resumed")).alias("unique_records"),
        F.max(F.coalesce(F.col("status").isin(401, 403, 429), F.lit(False))).alias("blocked"),
    )
    reached = F.lit(False) if limit is None else F.col("unique_records") >= limit
    stop = F.when(F.col("blocked"), "blocked").when(reached, "requested_limit_reached").otherwise("public_inventory_exhausted")
    return sums.withColumn("stop_reason", stop)


def http_error_counts(attempts: DataFrame) -> DataFrame:
    failed = attempts.where((F.col("status") != 200) & ~F.col("resumed"))
    status = F.when(F.col("status") == 0, "network").otherwise(F.col("status").cast("string"))
    return failed.groupBy("source", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def confidence_tiers(stats: DataFrame, source_counts: DataFrame, age_days: Column) -> DataFrame:
    """Signal tier with reason codes from sample size, source diversity, pay coverage and freshness."""
    diversity = source_counts.groupBy("career_id", "region").agg(F.count(F.lit(1)).alias("n_sources"))
    rows = stats.join(diversity, ["career_id", "region"], "left")
    pay = F.col("salary_sample_count") / F.greatest(F.col("demand_count_90d"), F.lit(1))
    reasons = F.array_compact(F.array(
        F.when(F.col("demand_count_90d") < 10, "small_sample"), F.when(F.coalesce("n_sources", F.lit(0)) < 2, "single_source"),
        F.when(pay < 0.3, "low_salary_coverage"), F.when(age_days > 30, "stale"),
    ))
    tier = (
        F.when(F.col("demand_count_90d") < 5, "hidden").when(F.size(reasons) == 0, "high")
        .when(F.size(reasons) == 1, "medium").otherwise("low")
    )
    return rows.select("career_id", "region", tier.alias("tier"), F.array_join(reasons, ",").alias("reasons"))


def unmapped_clusters(mapped: DataFrame, minimum: int = 50, column: str = "title") -> DataFrame:
    titles = mapped.where(F.col("career_id") == UNMAPPED).groupBy(norm_match(F.col(column)).alias("title_key"))
    return titles.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)


def profile_fields(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Filled share of each field per source and in total."""
    base = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count(f).alias(f) for f in fields])
    scoped = base.withColumn(by, F.explode(F.array(F.col(by), F.lit("all"))))
    sums = scoped.groupBy(by).agg(F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in fields])
    long = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])
    return sums.select(by, "n", F.explode(long).alias("f")).select(
        by, "f.field", "f.filled", "n", round_exact(F.col("f.filled") / F.col("n") * 100, 2).alias("filled_pct")
    )


def freshness_buckets(postings: DataFrame, end) -> DataFrame:
    age = F.datediff(F.lit(end), F.col("posted_date"))
    bucket = F.when(age <= 7, "0-7").when(age <= 30, "8-30").when(age <= 90, "31-90").otherwise("91+")
    return postings.groupBy("source", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
