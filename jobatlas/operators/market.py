"""Windowed market aggregates: career and skill demand, pay percentiles, trends, rankings."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jobatlas.functions.numbers import round_exact
from jobatlas.functions.grounding import source_note
from jobatlas.functions.parsing import salary_value
from jobatlas.operators.order_stats import running_counts, value_at
from jobatlas.session import cut_lineage

WINDOW_DAYS = 90
LATE_DAYS = 45
MIN_SALARY_SAMPLES = 5
MIN_TREND_POSTINGS = 10
UNMAPPED = "unmapped"
ALL = "all"



def latest_day(postings: DataFrame, column: str = "posted_date") -> dt.date | None:
    """Newest posting date: one scalar, answered from a single narrow column."""
    return postings.agg(F.max(F.col(column).cast("date")).alias("d")).first()["d"]


def in_window(postings: DataFrame, end: dt.date, days: int = WINDOW_DAYS, column: str = "posted_date") -> DataFrame:
    """Inclusive day window ending at ``end``; literal bounds reach the scan."""
    return postings.where(F.col(column).between(F.lit(end - dt.timedelta(days=days - 1)), F.lit(end)))


def trend_pct(early: Column, late: Column, total: Column) -> Column:
    """Change between the two half windows, null until there is enough evidence."""
    ready = (total >= MIN_TREND_POSTINGS) & (early > 0) & (late > 0)
    return F.when(ready, round_exact((late - early) / F.greatest(early, F.lit(5)) * 100, 2))


def _prepared(postings: DataFrame, end: dt.date) -> DataFrame:
    region = F.when(F.coalesce(F.col("region"), F.lit("")) == "", "other").otherwise(F.col("region"))
    source = F.when(F.coalesce(F.col("source"), F.lit("")) == "", "unknown").otherwise(F.col("source"))
    return in_window(postings, end).select(
        "id",
        source.alias("source"),
        F.coalesce("career_id", F.lit(UNMAPPED)).alias("career_id"),
        region.alias("region"),
        (F.col("posted_date") >= F.lit(end - dt.timedelta(days=LATE_DAYS - 1))).alias("is_late"),
        (F.coalesce(F.col("seniority"), F.lit("")) == "entry").alias("is_entry"),
        salary_value(F.col("salary_min_trieu"), F.col("salary_max_trieu")).alias("salary"),
        F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
    )


def with_all_region(df: DataFrame) -> DataFrame:
    """Each row once for its region and once for the national total."""
    return df.withColumn("region", F.explode(F.array(F.col("region"), F.lit(ALL))))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per group; no group is ordered in one task, whatever its size."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_value"))
    ranked = running_counts(rows, keys, "_value")

    def between(q: float) -> Column:
        low = F.floor((F.col("_n") - 1) * q)
        first, second = value_at(low + 1), value_at(F.least(low + 2, F.col("_n")))
        return round_exact(first + (second - first) * F.max((F.col("_n") - 1) * q - low), 2)

    return ranked.groupBy(*keys).agg(*[between(q).alias(name) for name, q in quantiles.items()])


def mapped_rows(postings: DataFrame, end: dt.date) -> DataFrame:
    """In-window postings that have a career, reduced to what the aggregates read."""
    return _prepared(postings, end).where(F.col("career_id") != UNMAPPED)


def career_core(mapped: DataFrame) -> DataFrame:
    """Additive measures per career and region plus the national row, in one pass.

    Rows are counted once per (career, region, source); everything else, the national
    row included, is rolled up from those few counts, so the postings are shuffled only
    as partial aggregates.  Regions and sources per career are short fixed lists.
    """
    base = mapped.groupBy("career_id", "region", "source").agg(
        F.count(F.lit(1)).alias("demand"),
        F.count_if("is_entry").alias("entry"),
        F.count_if(~F.col("is_late")).alias("early"),
        F.count_if("is_late").alias("late"),
        F.count("salary").alias("samples"),
    )
    measures = ["demand", "entry", "early", "late", "samples"]
    by_source = with_all_region(base).groupBy("career_id", "region", "source").agg(*[F.sum(m).alias(m) for m in measures])
    rows = by_source.groupBy("career_id", "region").agg(
        *[F.sum(m).alias(m) for m in measures],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "demand")))).alias("source_counts"),
    )
    own = F.when(F.col("region") != ALL, F.struct((-F.col("demand")).alias("o"), F.col("region").alias("r")))
    regions = F.array_sort(F.collect_list(own).over(W.partitionBy("career_id")))
    return rows.withColumn("top_regions", F.transform(regions, lambda s: s.r))


def career_top_skills(mapped: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent skills per career and region: count descending, then name."""
    counts = (
        mapped.select("career_id", "region", F.explode("skills").alias("skill"))
        .groupBy("career_id", "region", "skill").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = with_all_region(counts).groupBy("career_id", "region", "skill").agg(F.sum("n").alias("n"))
    order = W.partitionBy("career_id", "region").orderBy(F.desc("n"), "skill")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def career_top_regions(mapped: DataFrame) -> DataFrame:
    """Regions of each career by demand: one row per (career, region) with its rank."""
    counts = mapped.groupBy("career_id", "region").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("career_id").orderBy(F.desc("n"), "region")))


def career_source_counts(mapped: DataFrame) -> DataFrame:
    counts = mapped.groupBy("career_id", "region", "source").agg(F.count(F.lit(1)).alias("n"))
    return with_all_region(counts).groupBy("career_id", "region", "source").agg(F.sum("n").alias("n"))


def career_salary_percentiles(mapped: DataFrame) -> DataFrame:
    values = with_all_region(mapped.where(F.col("salary").isNotNull()).select("career_id", "region", "salary"))
    return exact_percentiles(
        values, ["career_id", "region"], "salary",
        {"salary_p25_trieu": 0.25, "salary_p50_trieu": 0.5, "salary_p75_trieu": 0.75},
    )


def _ordered(order: Column, item: str) -> Column:
    """Collect a ranked, already limited list in rank order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(item)))), lambda s: s[item])


def career_stats(postings: DataFrame, titles: DataFrame, window_end: dt.date | None = None, materialize: bool = True) -> DataFrame:
    """The career market table, one row per (career, region) plus ``all``.

    ``titles`` holds ``career_id, title``; a mapped posting whose career is missing
    there fails the job.  The reduced in-window rows feed four aggregates, so they are
    written once to the checkpoint folder; pass ``materialize=False`` when ``postings``
    is already a stored table.
    """
    end = window_end or latest_day(postings)
    keys = ["career_id", "region"]
    mapped = mapped_rows(postings, end)
    if materialize:
        mapped = cut_lineage(mapped)
    skills = career_top_skills(mapped).groupBy(*keys).agg(_ordered(F.col("rank"), "skill").alias("top_skills"))
    enough_pay = F.col("samples") >= MIN_SALARY_SAMPLES
    trend = trend_pct(F.col("early"), F.col("late"), F.col("demand"))
    title = F.coalesce(
        F.col("title"), F.raise_error(F.concat(F.lit("career absent from the base: "), F.col("career_id")))
    )
    return (
        career_core(mapped).join(titles.select("career_id", "title"), "career_id", "left")
        .join(skills, keys, "left").join(career_salary_percentiles(mapped), keys, "left")
        .select(
            "career_id", "region", title.cast("string").alias("title"),
            F.col("demand").alias("demand_count_90d"),
            F.col("entry").alias("entry_level_count_90d"),
            *[F.when(enough_pay, F.col(p)).alias(p) for p in ("salary_p25_trieu", "salary_p50_trieu", "salary_p75_trieu")],
            F.col("samples").alias("salary_sample_count"),
            trend.alias("trend_pct"),
            trend.isNull().alias("low_confidence"),
            F.coalesce("top_skills", F.array().cast("array<string>")).alias("top_skills"),
            "top_regions", "source_counts",
        )
    )


def skill_stats(postings: DataFrame, window_end: dt.date | None = None, related: int = 5) -> DataFrame:
    """Skill demand per (skill, region) plus ``all``, with gap score, trend and careers."""
    end = window_end or latest_day(postings)
    keys = ["skill", "region"]
    rows = _prepared(postings, end).select("career_id", "region", "is_late", F.explode("skills").alias("skill"))
    base = rows.groupBy("skill", "region", "career_id").agg(
        F.count(F.lit(1)).alias("demand"),
        F.count_if(~F.col("is_late")).alias("early"),
        F.count_if("is_late").alias("late"),
    )
    by_career = with_all_region(base).groupBy(*keys, "career_id").agg(
        *[F.sum(m).alias(m) for m in ("demand", "early", "late")]
    )
    order = W.partitionBy(*keys).orderBy(F.when(F.col("career_id") == UNMAPPED, 1).otherwise(0), "career_id")
    ranked = by_career.withColumn("rank", F.row_number().over(order))
    wanted = (F.col("rank") <= related) & (F.col("career_id") != UNMAPPED)
    totals = ranked.groupBy(*keys).agg(
        F.sum("demand").alias("demand_count"), F.sum("early").alias("early"), F.sum("late").alias("late"),
        F.array_sort(F.collect_list(F.when(wanted, F.col("career_id")))).alias("related_careers"),
    )
    busiest = F.max("demand_count").over(W.partitionBy("region"))
    trend = trend_pct(F.col("early"), F.col("late"), F.col("demand_count"))
    return totals.select(
        *keys,
        round_exact(F.least(F.lit(1.0), F.col("demand_count") / F.greatest(busiest, F.lit(1))), 4).alias("gap_score"),
        "demand_count", trend.alias("trend_pct"), trend.isNull().alias("low_confidence"), "related_careers",
    )


def career_lineage(postings: DataFrame, window_end: dt.date | None = None) -> DataFrame:
    """Contributing postings of every career row, as a long table instead of arrays."""
    end = window_end or latest_day(postings)
    mapped = _prepared(postings, end).where(F.col("career_id") != UNMAPPED)
    return with_all_region(mapped.select("career_id", "region", F.col("id").alias("posting_id")))


def skill_lineage(postings: DataFrame, window_end: dt.date | None = None) -> DataFrame:
    end = window_end or latest_day(postings)
    rows = _prepared(postings, end)
    return with_all_region(rows.select(F.explode("skills").alias("skill"), "region", F.col("id").alias("posting_id")))


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def market_meta(postings: DataFrame, window_end: dt.date | None = None) -> DataFrame:
    """Snapshot counts as key/value rows: totals, per source and per region."""
    end = window_end or latest_day(postings)
    base = _prepared(postings, end).groupBy("source", "region").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("career_id") != UNMAPPED).alias("mapped")
    )
    keyed = base.select(
        F.explode(F.array(
            _pair(F.lit("postings_count"), F.col("n")),
            _pair(F.lit("mapped_postings_count"), F.col("mapped")),
            _pair(F.lit("unmapped_postings_count"), F.col("n") - F.col("mapped")),
            _pair(F.concat(F.lit("source_counts."), F.col("source")), F.col("n")),
            _pair(F.concat(F.lit("region_counts."), F.col("region")), F.col("n")),
        )).alias("kv")
    )
    counts = keyed.groupBy("kv.key").agg(F.sum("kv.value").cast("string").alias("value"))
    fixed = {
        "window_days": str(WINDOW_DAYS), "window_end": end.isoformat(),
        "salary_min_samples": str(MIN_SALARY_SAMPLES), "trend_formula": "(late45-early45)/max(early45,5)*100",
    }
    spark = postings.sparkSession
    return counts.unionByName(spark.createDataFrame(list(fixed.items()), "key string, value string"))


def meta_struct(meta: DataFrame) -> DataFrame:
    """Key/value metadata as one row holding a map (the table has a few dozen keys)."""
    return meta.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta"))




def market_overview(stats: DataFrame, region: str | None = None) -> DataFrame:
    """Top rising, most wanted and best paid careers, for one region or for each."""
    rows = stats if region is None else stats.where(F.col("region") == region)

    def ranking(name: str, metric: str, limit: int, *ties) -> DataFrame:
        order = W.partitionBy("region").orderBy(F.desc(metric), *ties, F.asc("career_id"))
        return (
            rows.where(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= limit)
            .select("region", F.lit(name).alias("ranking"), "rank", "career_id", "title",
                    F.col(metric).cast("double").alias("metric"), F.col("demand_count_90d").alias("demand_count"),
                    "low_confidence")
        )

    parts = [
        ranking("rising", "trend_pct", 8, F.desc("demand_count_90d")),
        ranking("demand", "demand_count_90d", 8),
        ranking("paying", "salary_p50_trieu", 5),
    ]
    return reduce(DataFrame.unionByName, parts)


def top_skill_gaps(stats: DataFrame, region: str, limit: int = 20) -> DataFrame:
    return stats.where(F.col("region") == region).orderBy(F.desc("gap_score"), F.asc("skill")).limit(limit)


NATIONAL_SUFFIX = " (toàn quốc — chưa đủ dữ liệu riêng theo khu vực)"


def career_market(requests: DataFrame, stats: DataFrame, snapshot: str | None = None) -> DataFrame:
    """Market row for each requested (career_id, region).

    The regional row wins, then the labelled national row, then an honest zero row.
    The statistics table is keyed, so each request meets at most two rows.
    """
    fields = [c for c in stats.columns if c not in ("career_id", "region", "title")]

    def side(name: str, condition: Column) -> DataFrame:
        return stats.where(condition).select(
            "career_id", *([F.col("region")] if name == "r" else []),
            F.struct(*fields).alias(name),
        )

    joined = (
        requests.join(side("r", F.lit(True)), ["career_id", "region"], "left")
        .join(side("a", F.col("region") == ALL), "career_id", "left")
    )
    chosen = F.coalesce("r", "a")
    scope = F.when(F.col("r").isNotNull(), "region").when(F.col("a").isNotNull(), "national").otherwise("absent")
    zero = {
        "demand_count_90d": F.lit(0).cast("long"), "entry_level_count_90d": F.lit(0).cast("long"),
        "salary_sample_count": F.lit(0).cast("long"), "low_confidence": F.lit(True),
        "top_skills": F.array().cast("array<string>"), "top_regions": F.array().cast("array<string>"),
    }
    out = joined.withColumn("_m", chosen).withColumn("market_scope", scope)
    values = [
        F.coalesce(F.col(f"_m.{f}"), zero[f]).alias(f) if f in zero else F.col(f"_m.{f}").alias(f) for f in fields
    ]
    note = F.concat(
        source_note(F.coalesce(F.col("_m.demand_count_90d"), F.lit(0)), F.lit(snapshot)),
        F.when(F.col("market_scope") == "national", NATIONAL_SUFFIX).otherwise(""),
    )
    return out.select(*requests.columns, *values, "market_scope", note.alias("source_note"))


def market_or_seed(requests: DataFrame, stats: DataFrame | None, seed: DataFrame) -> DataFrame:
    """Real aggregates when a snapshot exists, otherwise the seed columns, with provenance."""
    if stats is not None:
        return career_market(requests, stats).withColumn("provenance", F.lit("snapshot"))
    demand = F.coalesce("demand_count_90d", F.lit(0)).cast("long")
    return requests.join(seed, "career_id", "left").select(
        *requests.columns, demand.alias("demand_count_90d"),
        F.coalesce("entry_level_count_90d", F.floor(demand * 0.2)).cast("long").alias("entry_level_count_90d"),
        "salary_p50_trieu", "trend_pct",
        F.coalesce("salary_sample_count", F.lit(30)).cast("long").alias("salary_sample_count"),
        F.coalesce("top_skills", F.array().cast("array<string>")).alias("top_skills"),
        F.coalesce("top_regions", F.array().cast("array<string>")).alias("top_regions"),
        F.lit("seed").alias("provenance"),
    )


def seed_skill_gaps(seed: DataFrame, region: str = ALL, limit: int = 20) -> DataFrame:
    """Blended 0.6 demand, 0.4 growth score of the first three skills of each career."""
    rows = seed if region == ALL else seed.where(F.array_contains("top_regions", region))
    score = F.least(
        F.lit(1.0),
        F.col("demand_count_90d") / 2000 * 0.6 + F.greatest(F.col("trend_pct"), F.lit(0.0)) / 100 * 0.4,
    )
    exploded = rows.select(
        F.explode(F.slice("top_skills", 1, 3)).alias("skill"), score.alias("score"),
        "career_id", "demand_count_90d", "trend_pct",
    )
    best = exploded.groupBy("skill").agg(
        F.min_by(
            F.struct("career_id", "demand_count_90d", "trend_pct", "score"),
            F.struct((-F.col("score")).alias("s"), "career_id"),
        ).alias("b")
    )
    return best.select(
        "skill", round_exact(F.col("b.score"), 2).alias("gap_score"), F.col("b.demand_count_90d").alias("demand_count"),
        F.col("b.trend_pct").alias("trend_pct"), F.col("b.career_id").alias("related_career"),
    ).orderBy(F.desc("gap_score"), F.asc("skill")).limit(limit)


def daily_demand(postings: DataFrame) -> DataFrame:
    return postings.groupBy("career_id", F.col("posted_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def moving_demand(daily: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Rolling demand and half windows from daily counts, which stay small per career."""
    ordinal = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    w = W.partitionBy("career_id").orderBy(ordinal)
    return daily.select(
        "career_id", "day", "n",
        F.sum("n").over(w.rangeBetween(-(days - 1), 0)).alias("demand_90d"),
        F.sum("n").over(w.rangeBetween(-(LATE_DAYS - 1), 0)).alias("late_45d"),
        F.coalesce(F.sum("n").over(w.rangeBetween(-(days - 1), -LATE_DAYS)), F.lit(0)).alias("early_45d"),
    )
