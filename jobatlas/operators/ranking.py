"""Profile to career ranking for all profiles in one job, stretch picks and what-if runs.

A profile row meets the careers as packed arrays, so scoring and top-k happen inside the
row: no profile is repeated per career and nothing is shuffled while the career base
fits one pack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobatlas.functions.numbers import round_exact
from jobatlas.functions.let import let
from jobatlas.functions.scoring import (
    DIMENSIONS, RankWeights, best_weights, clean_hypothetical_skill, cosine, dim_vector, dominant_index, market_component,
    market_signal, norm, overlap_score, overlap_weights, total_score, weighted_labels,
)
from jobatlas.functions.text import norm_label
from jobatlas.operators.packs import meet, pack

TOP_K = 20
TOP_SHOWN = 5


def prepare_profiles(profiles: DataFrame, keys=DIMENSIONS) -> DataFrame:
    """Add what ranking needs of a profile: ``_vec``, ``_labels`` (each once, best weight) and the labels alone, ``_own``."""
    labels = let(weighted_labels(F.col("skills"), F.col("interests"), F.col("experiences")), best_weights)
    labelled = profiles.withColumn("_vec", dim_vector(F.col("dimensions"), keys)).withColumn("_labels", labels)
    return labelled.withColumn("_own", F.transform("_labels", lambda p: p.label))


def career_item(keys=DIMENSIONS) -> Column:
    """What scoring needs of a career: vector, normalized market skills and market numbers."""
    vec = dim_vector(F.col("dimensions"), keys)
    skills = F.filter(F.array_distinct(F.transform("top_skills", norm_label)), lambda s: s != "")
    return F.struct(
        "career_id", vec.alias("vec"), norm(vec).alias("norm"), dominant_index(vec).alias("dom"), skills.alias("skills"),
        F.col("demand_count_90d").cast("double").alias("demand"), F.col("trend_pct").cast("double").alias("trend"),
        F.coalesce("top_regions", F.array().cast("array<string>")).alias("top_regions"),
    )


def _share_skills(packs: DataFrame) -> DataFrame:
    """Packs with ``known``, their distinct skills; ``items`` hold the places of their skills there as ``at``.

    Careers share most skills, so a profile is compared once with each skill of a pack instead of once per career.
    """
    known = packs.withColumn("known", F.array_distinct(F.flatten(F.transform("items", lambda c: c.skills))))

    def numbered(c: Column) -> Column:
        at = F.transform(c.skills, lambda s: (F.array_position(F.col("known"), s) - 1).cast("int"))
        return c.withField("at", at).dropFields("skills")

    return known.withColumn("items", F.transform("items", numbered))


def _score_items(vec: Column, labels: Column, region: Column, weights: RankWeights, use_market: bool) -> Column:
    """Score array of the packed careers; what depends on the profile alone is bound before the careers are walked."""
    own = F.struct(
        vec.alias("vec"), norm(vec).alias("norm"), overlap_weights(labels, F.col("known")).alias("best"),
        F.transform("known", lambda s: F.array_contains("_own", s).cast("int")).alias("owned"), F.size("_own").alias("n"),
    )
    return let(own, lambda o: _score_bound(o, region, weights, use_market))


def _score_bound(own: Column, region: Column, weights: RankWeights, use_market: bool) -> Column:
    """The scores, built in steps so that every part is computed once."""
    def parts(c: Column) -> Column:
        shared = F.aggregate(c.at, F.lit(0), lambda n, i: n + F.get(own.owned, i))
        return F.struct(
            c.career_id.alias("career_id"), c.dom.alias("dom"), cosine(own.vec, c.vec, own.norm, c.norm).alias("cosine"),
            F.transform(c.at, lambda i: F.get(own.best, i)).alias("hits"), F.size(c.at).alias("n_role"),
            (own.n + F.size(c.at) - shared).alias("n_union"),
            market_signal(c.demand, c.trend, c.top_regions, region).alias("market"),
        )

    def blended(p: Column) -> Column:
        return F.struct(
            p.career_id.alias("career_id"), p.dom.alias("dom"), p.cosine.alias("cosine"), p.market.alias("market"),
            overlap_score(p.hits, p.n_role, p.n_union).alias("skill"),
            (market_component(p.market, weights) if use_market else F.lit(0.0)).alias("part"),
        )

    def totalled(p: Column) -> Column:
        return F.struct(p.alias("p"), total_score(p.cosine, p.skill, p.part, weights, use_market).alias("total"))

    def laid_out(t: Column) -> Column:
        p = t["p"]
        return F.struct(
            (-t["total"]).alias("order"), p.career_id.alias("career_id"), t["total"].alias("total"), p.cosine.alias("cosine"),
            p.skill.alias("skill"), p.market.alias("market"), p.part.alias("market_component"), p.dom.alias("dom"),
        )

    steps = F.col("items")
    for step in (parts, blended, totalled, laid_out):
        steps = F.transform(steps, step)
    return steps


def rank_careers(
    profiles: DataFrame, careers: DataFrame, k: int = TOP_K, weights: RankWeights = RankWeights(),
    use_market: bool = True, key: str = "session_id", keys=DIMENSIONS, vec: Column | None = None, out: str = "ranked",
) -> DataFrame:
    """Profiles with ``ranked``: the best ``k`` careers by score, then career id.

    Every career is scored; the preferred region never filters.
    """
    ready = prepare_profiles(profiles, keys) if "_vec" not in profiles.columns else profiles
    packs, n_packs = pack(careers, career_item(keys))
    met = meet(ready, _share_skills(packs), n_packs)
    scored = _score_items(vec if vec is not None else F.col("_vec"), F.col("_labels"), F.col("constraints.region_pref"),
                          weights, use_market)
    best = met.withColumn(out, F.slice(F.array_sort(scored), 1, k)).drop("items", "known")
    if n_packs == 1:
        return best
    merged = best.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list(out))), 1, k).alias(out))
    return ready.join(merged, key)


def stretch_pick(ranked: Column, user_dom: Column) -> Column:
    """First career after the shown five with another dominant dimension, else the next one."""
    rest = F.slice(ranked, TOP_SHOWN + 1, TOP_K)
    different = F.get(F.filter(rest, lambda c: c.dom != user_dom), F.lit(0))
    return F.coalesce(different, F.get(ranked, F.lit(TOP_SHOWN)), F.try_element_at(ranked, F.lit(-1)))


def with_stretch(ranked: DataFrame) -> DataFrame:
    """Add ``shown`` (top five) and ``stretch`` to ranked profiles."""
    return ranked.withColumn("shown", F.slice("ranked", 1, TOP_SHOWN)).withColumn(
        "stretch", stretch_pick(F.col("ranked"), dominant_index(F.col("_vec")))
    )


def explode_ranked(ranked: DataFrame, key: str = "session_id", column: str = "ranked") -> DataFrame:
    """One row per profile and career with its rank and score parts."""
    return ranked.select(key, F.posexplode(column).alias("_p", "c")).select(
        key, (F.col("_p") + 1).alias("rank"), "c.career_id", "c.total", "c.cosine", "c.skill", "c.market",
        "c.market_component", "c.dom",
    )


def recommendation_rows(ranked: DataFrame, carry=(), key: str = "session_id") -> DataFrame:
    """Five shown careers plus the stretch (rank last), one row each."""
    both = F.concat(
        F.transform("shown", lambda c, i: F.struct((i + 1).alias("rank"), F.lit(False).alias("is_stretch"), c.alias("c"))),
        F.array(F.struct(
            (F.size("shown") + 1).alias("rank"), F.lit(True).alias("is_stretch"), F.col("stretch").alias("c")
        )),
    )
    return ranked.select(key, *carry, F.explode(both).alias("r")).select(
        key, *carry, "r.rank", "r.is_stretch", "r.c.career_id", round_exact(F.col("r.c.total"), 4).alias("match_score")
    )


def counterfactual_vector(vec: Column) -> Column:
    """Strongest other dimension plus 0.3, dominant minus 0.15."""
    dom = dominant_index(vec)
    others = F.transform(vec, lambda v, i: F.when(i == dom, F.lit(-1.0)).otherwise(v))
    target = dominant_index(others)
    return F.transform(
        vec,
        lambda v, i: F.when(i == target, F.least(F.lit(1.0), v + 0.3))
        .when(i == dom, F.greatest(F.lit(0.0), v - 0.15)).otherwise(v),
    )


def rank_counterfactual(ranked: DataFrame, careers: DataFrame, weights: RankWeights = RankWeights(),
                        key: str = "session_id", keys=DIMENSIONS) -> DataFrame:
    """Add ``ranked_alt``: the top five after the counterfactual shift, and the two dimensions."""
    names = F.array(*[F.lit(k) for k in keys])
    dom = dominant_index(F.col("_vec"))
    others = F.transform("_vec", lambda v, i: F.when(i == dom, F.lit(-1.0)).otherwise(v))
    shifted = rank_careers(ranked, careers, 5, weights, True, key, keys, counterfactual_vector(F.col("_vec")), "ranked_alt")
    return shifted.withColumn("cf_from", F.get(names, dom)).withColumn("cf_to", F.get(names, dominant_index(others)))


def counterfactual_career(ranked_alt: Column, current: Column) -> Column:
    """New top career of the shifted profile, or the runner-up when nothing changed."""
    top = F.get(ranked_alt, F.lit(0)).career_id
    return F.when(top == current, F.coalesce(F.get(ranked_alt, F.lit(1)).career_id, top)).otherwise(top)


# Labels of a hypothetical skill.
WHAT_IF_LEVEL = "giả định what-if"
WHAT_IF_QUOTE = "Giả định để mô phỏng; chưa phải bằng chứng trong hồ sơ"


def add_hypothetical_skill(profiles: DataFrame, skill: Column) -> DataFrame:
    """Copy of the profiles with one unverified skill; rejected skills drop the profile row."""
    cleaned = clean_hypothetical_skill(skill)
    known = F.exists("skills", lambda s: F.lower(s["name"]) == F.lower(cleaned))
    extra = F.array(F.struct(
        cleaned.alias("name"), F.lit(WHAT_IF_LEVEL).alias("level"), F.lit(WHAT_IF_QUOTE).alias("source_quote")
    ))
    return profiles.where(cleaned.isNotNull()).withColumn(
        "skills", F.when(known, F.col("skills")).otherwise(F.concat(F.col("skills"), extra))
    )


def rank_delta(before: DataFrame, after: DataFrame, key: str = "session_id") -> DataFrame:
    """Rank and score before and after, unchanged careers dropped."""
    def side(df: DataFrame, name: str) -> DataFrame:
        first = df.groupBy(key, "career_id").agg(F.max_by(F.struct("rank", "match_score"), "rank").alias("s"))
        return first.select(
            key, "career_id", F.col("s.rank").alias(f"{name}_rank"), F.col("s.match_score").alias(f"{name}_score")
        )

    joined = side(before, "before").join(side(after, "after"), [key, "career_id"], "full_outer")
    same = F.col("before_rank").eqNullSafe(F.col("after_rank")) & F.col("before_score").eqNullSafe(F.col("after_score"))
    return joined.where(~same)


def what_if(profiles: DataFrame, careers: DataFrame, skill: Column, weights: RankWeights = RankWeights(),
            key: str = "session_id", keys=DIMENSIONS) -> DataFrame:
    """Effect of one added skill on the shown careers of every profile."""
    def shown(df: DataFrame) -> DataFrame:
        return recommendation_rows(with_stretch(rank_careers(df, careers, TOP_K, weights, True, key, keys)), key=key)

    allowed = profiles.where(clean_hypothetical_skill(skill).isNotNull())
    return rank_delta(shown(allowed), shown(add_hypothetical_skill(allowed, skill)), key)
