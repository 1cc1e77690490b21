"""Ranking arithmetic on profile and career columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobatlas.functions.numbers import fixed_text, round_exact
from jobatlas.functions.let import let
from jobatlas.functions.privacy import scrub_scoring_text
from jobatlas.functions.text import norm_label

# Dimension keys in tie-break order, and the market cap.
DIMENSIONS = ("ky_thuat", "phan_tich", "sang_tao", "xa_hoi", "quan_ly")
MARKET_CAP = 0.35
SHORT_LABEL = 3


@dataclass(frozen=True)
class RankWeights:
    """Weights of the three score parts and the readiness thresholds."""

    cosine: float = 0.5
    skill: float = 0.3
    market: float = 0.2
    ready_coverage: float = 0.75
    near_coverage: float = 0.45
    min_evidence: int = 2


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def dim_vector(dims: Column, keys=DIMENSIONS) -> Column:
    """Map to a fixed-order array of doubles; a missing key counts as 0."""
    return F.array(*[F.coalesce(F.try_element_at(dims, F.lit(k)), F.lit(0.0)).cast("double") for k in keys])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine clamped to 0..1; a zero vector gives 0.  Norms that are known already need not be computed again."""
    return let(
        (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b),
        lambda norm: F.when(norm < 1e-24, F.lit(0.0)).otherwise(clamp(_dot(a, b) / norm)),
    )


def dominant_index(vector: Column) -> Column:
    """0-based position of the largest entry; the first wins a tie."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def dominant_dimension(dims: Column, keys=DIMENSIONS) -> Column:
    return F.get(F.array(*[F.lit(k) for k in keys]), dominant_index(dim_vector(dims, keys)))


def labels_match(a: Column, b: Column) -> Column:
    """Soft equality of two normalized labels; containment only when both are long enough."""
    long_enough = (F.length(a) >= SHORT_LABEL) & (F.length(b) >= SHORT_LABEL)
    return (a != "") & (b != "") & ((a == b) | (long_enough & (a.contains(b) | b.contains(a))))


def skill_match(a: Column, b: Column) -> Column:
    return labels_match(norm_label(a), norm_label(b))


def _weighted(label: Column, weight) -> Column:
    value = weight if isinstance(weight, Column) else F.lit(weight)
    return F.struct(norm_label(label).alias("label"), value.cast("double").alias("weight"))


def weighted_labels(skills: Column, interests: Column, experiences: Column) -> Column:
    """Profile labels with their evidence weight, one array element per mention."""
    parts = F.concat(
        F.transform(
            skills, lambda s: _weighted(s["name"], F.when(F.coalesce(s.source_quote, F.lit("")) != "", 1.0).otherwise(0.6))
        ),
        F.transform(interests, lambda i: _weighted(i, 0.5)),
        F.flatten(F.transform(experiences, lambda e: F.transform(e.skills, lambda s: _weighted(s, 0.9)))),
        F.transform(experiences, lambda e: _weighted(e.title, 0.4)),
    )
    return F.filter(parts, lambda p: p.label != "")


def overlap_weights(labels: Column, role_skills: Column) -> Column:
    """Best matching weight of each role skill, null without a match.  Labels are normalized."""
    return F.transform(
        role_skills,
        lambda r: F.aggregate(
            labels, F.lit(None).cast("double"),
            lambda best, p: F.when(labels_match(p.label, r), F.greatest(best, p.weight)).otherwise(best),
        ),
    )


def best_weights(labels: Column) -> Column:
    """Each distinct label once, with its greatest weight."""
    def best(label: Column) -> Column:
        return F.aggregate(labels, F.lit(0.0), lambda w, p: F.when(p.label == label, F.greatest(w, p.weight)).otherwise(w))

    return F.transform(F.array_distinct(F.transform(labels, lambda p: p.label)), lambda t: F.struct(t.alias("label"), best(t).alias("weight")))


def norm(vec: Column) -> Column:
    return F.sqrt(_dot(vec, vec))


def overlap_score(weights: Column, n_role: Column, n_union: Column) -> Column:
    """Half Jaccard, half weighted coverage."""
    covered = F.aggregate(weights, F.lit(0.0), lambda s, w: s + F.coalesce(w, F.lit(0.0)))
    jaccard = F.size(F.array_compact(weights)) / F.greatest(F.lit(1), n_union)
    coverage = covered / F.greatest(F.lit(1), n_role)
    blend = 0.5 * jaccard + 0.5 * F.least(F.lit(1.0), coverage)
    return F.when(n_role == 0, F.lit(0.0)).otherwise(clamp(blend))


def market_signal(demand: Column, trend: Column, top_regions: Column | None = None, region: Column | None = None) -> Column:
    """Log demand times trend, with a small boost for a preferred top region."""
    base = clamp(F.log1p(F.coalesce(demand.cast("double"), F.lit(0.0))) / math.log1p(2000.0))
    factor = 1.0 + clamp(F.coalesce(trend.cast("double"), F.lit(0.0)), -50.0, 100.0) / 200.0
    signal = clamp(base * factor / 1.5)
    if top_regions is not None and region is not None:
        preferred = F.exists(top_regions, lambda r: F.lower(r) == F.lower(region))
        signal = F.when(F.coalesce(preferred, F.lit(False)), F.least(F.lit(1.0), signal * 1.05)).otherwise(signal)
    return F.least(F.lit(MARKET_CAP * 3), signal)


def market_component(signal: Column, weights: RankWeights) -> Column:
    return F.least(F.lit(MARKET_CAP), weights.market * signal)


def total_score(cos: Column, skill: Column, market: Column, weights: RankWeights, use_market: bool = True) -> Column:
    fit = weights.cosine * cos + weights.skill * skill
    if use_market:
        return clamp(fit + market)
    return clamp(fit / (weights.cosine + weights.skill))


def signal_strength(skills: Column, interests: Column, dims: Column) -> Column:
    sourced = F.size(F.filter(skills, lambda s: F.trim(F.coalesce(s.source_quote, F.lit(""))) != ""))
    top = F.coalesce(F.array_max(F.map_values(dims)), F.lit(0.0))
    return round_exact(
        F.least(F.lit(1.0), sourced / 2.0) * 0.4
        + F.least(F.lit(1.0), F.size(interests) / 2.0) * 0.3
        + F.least(F.lit(1.0), top) * 0.3,
        3,
    )


def has_personal_signal(skills: Column, interests: Column, experiences: Column, goal: Column, dims: Column) -> Column:
    top = F.coalesce(F.array_max(F.map_values(dims)), F.lit(0.0))
    return (
        (F.size(skills) > 0) | (F.size(interests) > 0) | (F.size(experiences) > 0)
        | (F.coalesce(goal, F.lit("")) != "") | (top >= 0.3)
    )


def profile_text(dims: Column, skills: Column, interests: Column, experiences: Column, goal: Column, quotes: Column) -> Column:
    """Retrieval text of a profile: no region, no gender, no school prestige."""
    dim_parts = [
        F.when(F.try_element_at(dims, F.lit(k)) > 0.05, F.concat(F.lit(f"{k}:"), fixed_text(F.try_element_at(dims, F.lit(k)), 2)))
        for k in DIMENSIONS
    ]
    parts = F.concat(
        F.array_compact(F.array(*dim_parts)),
        F.filter(F.transform(skills, lambda s: s["name"]), lambda n: n != ""),
        interests,
        F.flatten(F.transform(experiences, lambda e: F.concat(F.array(e.title), e.skills))),
        F.array_compact(F.array(F.when(goal != "", goal))),
        F.transform(
            F.filter(F.slice(quotes, 1, 8), lambda q: q.quote != ""),
            lambda q: scrub_scoring_text(F.substring(q.quote, 1, 120)),
        ),
    )
    return scrub_scoring_text(F.array_join(parts, " | "))


def completeness(mode: Column, education: Column, goal: Column, notes: Column, n_experiences: Column, n_sourced: Column,
                 n_interests: Column, n_active: Column, has_constraint: Column) -> Column:
    """Profile completeness, mean of capped parts by mode."""
    def flag(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)

    def half(c: Column) -> Column:
        return F.least(F.lit(1.0), c / 2.0)

    none_yet = F.lower(F.coalesce(notes, F.lit(""))).contains("chưa")
    launch = (
        flag(education != "") + flag((F.coalesce(goal, F.lit("")) != "") | none_yet)
        + F.when(n_experiences > 0, 1.0).when(none_yet, 0.5).otherwise(0.0)
        + half(n_sourced) + flag(has_constraint)
    ) / 5.0
    explore = (half(n_interests) + half(n_active) + half(n_sourced) + flag(has_constraint)) / 4.0
    return round_exact(F.when(mode == "launch", launch).otherwise(explore), 2)


# Rejected what-if terms.
WHAT_IF_BANNED = ("giới tính", "gpa", "trường top")


def clean_hypothetical_skill(value: Column) -> Column:
    """Cleaned label of a what-if skill, null when it must be rejected."""
    cleaned = F.substring(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " ")), 1, 80)
    banned = F.lit(False)
    for term in WHAT_IF_BANNED:
        banned = banned | F.lower(cleaned).contains(term)
    return F.when((cleaned != "") & ~banned, cleaned)
