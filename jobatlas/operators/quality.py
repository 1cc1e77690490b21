"""Contracts and audits: every check is a query that returns the violating rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobatlas.functions.hashing import table_fingerprint
from jobatlas.functions.privacy import VAGUE_TRAITS
from jobatlas.functions.text import nfc, norm_label, norm_match
from jobatlas.operators.guidance import NON_UNIVERSITY, SENSITIVE_QUERY
from jobatlas.operators.market import UNMAPPED

# Fixed values.
SKILL_TYPES = ("technical", "tool", "domain", "soft")
GOLD_REGIONS = ("hanoi", "hcm", "danang", "other")
BANDS = ("ready_now", "near_ready", "build_foundation")


def _rules(df: DataFrame, item: Column | str, *checks: tuple[str, Column]) -> DataFrame:
    """``rule, item`` of every failed check; all checks of one table share a single pass."""
    key = F.col(item) if isinstance(item, str) else item
    failed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))
    return df.select(F.explode(failed).alias("rule"), key.cast("string").alias("item"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def blank(c: Column | str) -> Column:
    return F.trim(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))) == ""


def duplicates(df: DataFrame, rule: str, key: str) -> DataFrame:
    counts = df.groupBy(F.col(key).cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > 1).select(F.lit(rule).alias("rule"), "item")


def taxonomy_violations(taxonomy: DataFrame, minimum: int = 1) -> DataFrame:
    """Rules over ``name, aliases, type``: text form, types, uniqueness, collisions, vague terms, coverage."""
    name = F.col("name")
    aliases = taxonomy.select("name", F.explode("aliases").alias("alias"))
    norm_alias = aliases.select("name", "alias", norm_match(F.col("alias")).alias("a"))
    owned = taxonomy.select("name", norm_match(name).alias("a")).unionByName(norm_alias.select("name", "a")).distinct()
    collisions = owned.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    local = norm_alias.groupBy("name", "a").agg(F.count(F.lit(1)).alias("n"))
    totals = taxonomy.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("type") == t).alias(t) for t in SKILL_TYPES]
    )
    return _all(
        _rules(
            taxonomy, name,
            ("blank name", blank("name")),
            ("surrounding whitespace", name != F.trim(name)),
            ("not NFC", name != nfc(name)),
            ("unknown type", ~F.coalesce(F.col("type").isin(*SKILL_TYPES), F.lit(False))),
            ("no aliases", F.size(F.coalesce("aliases", F.array().cast("array<string>"))) == 0),
            ("vague skill", norm_match(name).isin(*VAGUE_TRAITS)),
        ),
        duplicates(taxonomy.select(norm_match(name).alias("n")), "duplicate skill", "n"),
        _rules(
            norm_alias, "alias",
            ("alias not lower case", F.col("alias") != F.lower("alias")),
            ("alias not NFC", F.col("alias") != nfc(F.col("alias"))),
            ("vague alias", F.col("a").isin(*VAGUE_TRAITS)),
        ),
        _rules(
            local, "a",
            ("duplicate alias", F.col("n") > 1),
        ),
        _rules(
            collisions, "a",
            ("alias collision", F.col("n") > 1),
        ),
        _rules(
            totals, "n",
            ("too few skills", F.col("n") < minimum),
        ),
        _rules(totals, F.lit("types"), *[(f"missing type {t}", F.col(t) == 0) for t in SKILL_TYPES]),
    )


def header_violations(header: DataFrame) -> DataFrame:
    """Rules over the one-row taxonomy header ``schema_version, version, built_at, taxonomy_hash, expected_hash``."""
    return _all(
        _rules(
            header, "schema_version",
            ("schema version", F.col("schema_version") != 1),
        ),
        _rules(
            header, "version",
            ("semantic version", ~F.col("version").rlike(r"^\d+\.\d+\.\d+$")),
        ),
        _rules(
            header, "built_at",
            ("build date", F.try_to_date("built_at", "yyyy-MM-dd").isNull()),
        ),
        _rules(
            header, "taxonomy_hash",
            ("taxonomy hash", ~F.col("taxonomy_hash").eqNullSafe(F.col("expected_hash"))),
        ),
    )


def career_violations(careers: DataFrame) -> DataFrame:
    patterns = careers.select("career_id", F.explode("title_patterns").alias("p"))
    shared = patterns.groupBy(norm_match(F.col("p")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return _all(
        _rules(
            careers, "career_id",
            ("blank career id", blank("career_id")),
            ("blank title", blank("title")),
            ("reserved career id", F.col("career_id") == UNMAPPED),
            ("no title patterns", F.size(F.coalesce("title_patterns", F.array().cast("array<string>"))) == 0),
        ),
        duplicates(careers, "duplicate career id", "career_id"),
        _rules(
            patterns, "career_id",
            ("blank pattern", blank("p")),
        ),
        _rules(
            shared, "item",
            ("shared pattern", F.col("n") > 1),
        ),
    )


def enriched_violations(postings: DataFrame) -> DataFrame:
    """Rules over enriched postings: id, title, unique non-blank skills, one extraction version."""
    meta = F.struct("skill_extraction.version", "skill_extraction.taxonomy_version", "skill_extraction.taxonomy_hash")
    versions = postings.select(meta.alias("v")).distinct()
    many = versions.agg(F.count(F.lit(1)).alias("n"))
    skills = F.col("skills")
    return _all(
        _rules(
            postings, "id",
            ("blank id", blank("id")),
            ("blank title", blank("title")),
            ("no skills list", skills.isNull()),
            ("blank skill", F.exists(skills, lambda s: F.trim(F.coalesce(s, F.lit(""))) == "")),
            ("duplicate skill", F.size(skills) != F.size(F.array_distinct(skills))),
        ),
        duplicates(postings, "duplicate id", "id"),
        _rules(
            many, "n",
            ("mixed versions", F.col("n") > 1),
        ),
    )


def market_input_violations(postings: DataFrame) -> DataFrame:
    return _all(
        _rules(
            postings, "id",
            ("blank id", blank("id")),
            ("no skills list", F.col("skills").isNull()),
            ("no career", F.col("career_id").isNull()),
            ("invalid date", F.col("posted_date").isNull()),
        ),
        duplicates(postings, "duplicate id", "id"),
    )


def gold_violations(gold: DataFrame, labels: DataFrame, size: int = 100, regions: int = 3, groups: int = 5,
                    allowed_regions=GOLD_REGIONS) -> DataFrame:
    """Rules over ``posting_id, region, career_group, skills``; ``labels`` holds the taxonomy ``skill`` names."""
    totals = gold.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("region").alias("r"), F.count_distinct("career_group").alias("g")
    )
    unknown = gold.select(F.explode("skills").alias("skill")).distinct().join(labels.select("skill"), "skill", "left_anti")
    region_ok = F.coalesce(F.col("region").isin(*allowed_regions), F.lit(False)) if allowed_regions else F.lit(True)
    return _all(
        _rules(
            totals, "n",
            ("wrong size", F.col("n") != size),
        ),
        _rules(
            totals, "r",
            ("too few regions", F.col("r") < regions),
        ),
        _rules(
            totals, "g",
            ("too few groups", F.col("g") < groups),
        ),
        _rules(
            gold, "posting_id",
            ("blank id", blank(F.col("posting_id").cast("string"))),
            ("unknown region", ~region_ok),
            ("blank group", blank("career_group")),
            ("duplicate label", F.size("skills") != F.size(F.array_distinct("skills"))),
        ),
        duplicates(gold, "duplicate id", "posting_id"),
        _rules(
            unknown, "skill",
            ("label outside taxonomy", F.lit(True)),
        ),
    )


def require_fingerprint(df: DataFrame, expected: str | None, allow_unpinned: bool = False, exclude=()) -> DataFrame:
    """Gate an input on its fingerprint; the comparison is one scalar."""
    if expected is None:
        if allow_unpinned:
            return df
        raise ValueError("a pinned fingerprint is required")
    found = table_fingerprint(df, exclude).first()["fingerprint"]
    if found != expected:
        raise ValueError(f"input fingerprint mismatch: expected {expected}, found {found}")
    return df


def release_gate(report: DataFrame) -> DataFrame:
    """Release status and blockers of a one-row report with ``mapping_accuracy`` and ``other_region_share``."""
    not_run = F.coalesce(F.col("mapping_accuracy"), F.lit("NOT_RUN")) == "NOT_RUN"
    blockers = F.array_compact(F.array(
        F.when(not_run, "Career mapping accuracy is NOT_RUN"),
        F.when(not_run & (F.col("other_region_share") > 0.5), "Region 'other' dominates the snapshot"),
    ))
    status = F.when(not_run, "CANDIDATE_NOT_RELEASED").otherwise("RELEASE_READY")
    return report.withColumn("release_status", status).withColumn("release_blockers", blockers)


def route_violations(careers: DataFrame, key: str = "career_id") -> DataFrame:
    outside = F.exists(F.col("routes"), lambda r: r.type.isin(*NON_UNIVERSITY))
    return _all(
        _rules(
            careers, key,
            ("fewer than two routes", F.coalesce(F.size("routes"), F.lit(0)) < 2),
            ("no route outside university", ~F.coalesce(outside, F.lit(False))),
        ),
    )


def readiness_violations(rows: DataFrame, key: str, readiness: str = "job_readiness", tops: str = "top_skills") -> DataFrame:
    r = F.col(readiness)
    matched = F.transform(r.matched_skills, lambda m: norm_label(m.skill))
    missing = F.transform(r.missing_skills, norm_label)
    known = F.transform(F.col(tops), norm_label)
    weeks = F.array_sort(F.transform(r.actions_30d, lambda a: a.week))
    present = rows.where(r.isNotNull())
    return _all(
        _rules(
            present, key,
            ("matched and missing overlap", F.arrays_overlap(matched, missing)),
            ("missing outside role skills", F.size(F.array_except(missing, known)) > 0),
            ("matched without evidence", F.exists(r.matched_skills, lambda m: F.trim(m.evidence) == "")),
            ("not four weeks", weeks != F.array(*[F.lit(i) for i in range(1, 5)])),
            ("action without deliverable", F.exists(r.actions_30d, lambda a: F.trim(a.deliverable) == "")),
            ("query count", ~F.size(r.search_queries).between(2, 4)),
            ("sensitive query", F.exists(r.search_queries, lambda q: q.rlike(SENSITIVE_QUERY))),
            ("unknown band", ~r.band.isin(*BANDS)),
        ),
    )


def invariance_audit(a: DataFrame, b: DataFrame, key: str = "pair_id", shown: int = 5) -> DataFrame:
    """Compare two rankings of paired profiles that differ only in a protected token or region.

    Each side holds ``key, ranked`` (array of careers by rank).
    """
    def ids(column: str, n: int | None) -> Column:
        every = F.transform(column, lambda c: c.career_id)
        return every if n is None else F.slice(every, 1, n)

    pairs = a.select(key, F.col("ranked").alias("ra")).join(b.select(key, F.col("ranked").alias("rb")), key)
    overlap = F.size(F.array_intersect(ids("ra", shown), ids("rb", shown)))
    same_top3 = F.array_sort(ids("ra", 3)) == F.array_sort(ids("rb", 3))
    same_set = F.array_sort(ids("ra", None)) == F.array_sort(ids("rb", None))
    return pairs.select(
        key, overlap.cast("long").alias("top_overlap"), same_top3.alias("same_top3"), same_set.alias("same_candidates"),
        ((overlap >= shown - 1) & (same_top3 | (overlap == shown)) & same_set).alias("passed"),
    )


def persona_distinctness(ranked: DataFrame, key: str = "session_id") -> DataFrame:
    """How many different first careers and top threes the personas get."""
    ids = F.transform("ranked", lambda c: c.career_id)
    tops = ranked.select(F.get(ids, F.lit(0)).alias("top1"), F.array_join(F.slice(ids, 1, 3), ",").alias("top3"))
    counts = tops.agg(
        F.count(F.lit(1)).alias("personas"), F.count_distinct("top1").alias("distinct_top1"),
        F.count_distinct("top3").alias("distinct_top3"),
    )
    return counts.withColumn(
        "passed", (F.col("distinct_top1") >= F.least(F.lit(4), F.col("personas"))) & (F.col("distinct_top3") == F.col("personas"))
    )


