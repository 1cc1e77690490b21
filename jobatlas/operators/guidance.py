"""Routes, roadmaps, evidenced skills, gaps, readiness and thirty-day actions per recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobatlas.functions.let import let
from jobatlas.functions.scoring import RankWeights, labels_match
from jobatlas.functions.text import norm_label, squeeze

# Fixed values.
NON_UNIVERSITY = ("vocational", "college", "certificate")
ROUTE_ORDER = ("certificate", "vocational", "college", "university")
SHORT_COURSE = (
    "certificate", "Chứng chỉ / khóa nghề ngắn hạn", "Bổ sung kỹ năng thực hành, ưu tiên portfolio",
    "Chọn một kỹ năng cốt lõi và làm 1 output nhỏ có thể khoe",
)
TRADE_SCHOOL = (
    "vocational", "Lộ trình nghề / trung cấp", "Đường không bắt buộc đại học 4 năm",
    "Tìm hiểu chương trình nghề gần nơi bạn sống",
)
SENSITIVE_QUERY = (
    r"(?iuU)(?:\bnam\b|\bnữ\b|giới\s*tính|\btuổi\b|\bGPA\b|đại\s*học\s+bách|NEU\b|FTU\b|con\s+gái|con\s+trai)"
)
BAND_REASON = {
    "ready_now": "Bạn đã có bằng chứng cho nhiều kỹ năng vai trò thường yêu cầu — đây là mức chuẩn bị, không phải xác suất được tuyển.",
    "near_ready": "Bạn đã có nền tảng; còn một số kỹ năng/role skills chưa có evidence trong hồ sơ.",
    "build_foundation": "Hướng này cần thêm project/evidence kỹ năng cốt lõi trước khi tập trung ứng tuyển.",
    "no_skills": "Chưa có top skills thị trường cho vai trò này trong snapshot — hãy bổ sung project minh chứng chung.",
}
GENERIC_FOCUS = "kỹ năng cốt lõi của vai trò"
GENERIC_TITLE = "việc entry-level"
TITLE_SUFFIXES = (" fresher", " entry level", " thực tập")
JUNIOR_SUFFIX = " junior"
# Action, deliverable and reason of a week; {week} and {focus} are filled in.
GAP_WEEK = (
    "Làm một mini-project/minh chứng tập trung vào «{focus}»",
    "1 link hoặc file tuần {week} (repo/notebook/PDF) thể hiện «{focus}»",
    "Bổ sung evidence còn thiếu so với kỹ năng vai trò thường nêu: {focus}",
)
OWN_WEEK = (
    "Chỉnh portfolio để làm nổi bật «{focus}» đã có evidence",
    "1 bản cập nhật README/portfolio tuần {week} nêu rõ «{focus}» + link chứng minh",
    "Tăng độ rõ của evidence đã có cho «{focus}» khi ứng tuyển entry-level",
)
GENERIC_WEEK = (
    "Chọn 1 kỹ năng role và tạo output nhỏ kiểm chứng được ({focus})",
    "1 artifact tuần {week} (file/link) + 3 bullet mô tả việc bạn đã làm",
    "Tạo bằng chứng đầu tiên thay vì chỉ liệt kê kỹ năng chung chung",
)


def _route(values: tuple[str, str, str, str]) -> Column:
    kind, label, detail, step = values
    return F.array(F.struct(
        F.lit(kind).alias("type"), F.lit(label).alias("label"), F.lit(detail).alias("detail"),
        F.array(F.lit(step)).alias("first_steps"),
    ))


def ensure_routes(routes: Column, mode: Column) -> Column:
    """At least two routes, one outside university; launch puts entry-friendly types first."""
    two = F.when(F.size(routes) < 2, F.concat(routes, _route(SHORT_COURSE))).otherwise(routes)
    other = F.exists(two, lambda r: r.type.isin(*NON_UNIVERSITY))
    full = F.when(other, two).otherwise(F.concat(two, _route(TRADE_SCHOOL)))

    def place(r: Column) -> Column:
        chain = F.when(F.lit(False), 0)
        for i, kind in enumerate(ROUTE_ORDER):
            chain = chain.when(r.type == kind, i)
        return chain.otherwise(9)

    tagged = F.transform(full, lambda r, i: F.struct(place(r).alias("o"), i.alias("i"), r.alias("r")))
    ordered = F.transform(F.array_sort(tagged), lambda t: t.r)
    return F.when(mode == "launch", ordered).otherwise(full)


def ensure_roadmap(roadmap: Column, top_skills: Column) -> Column:
    fallback = F.transform(
        F.slice(top_skills, 1, 4),
        lambda s, i: F.struct(
            s.alias("skill"), F.when(i == 0, "nen-hoc-truoc").otherwise("hoc-trong-truong").alias("status")
        ),
    )
    return F.when(F.size(roadmap) > 0, roadmap).otherwise(fallback)


def distinct_by_label(items: Column, label) -> Column:
    """First element per case-insensitive label, order kept."""
    return let(items, lambda xs: let(
        F.transform(xs, label),
        lambda labels: F.filter(xs, lambda _, i: F.array_position(labels, F.get(labels, i)) == i + 1),
    ))


def evidenced_skills(skills: Column, experiences: Column) -> Column:
    """Skills with evidence, quoted skills first: ``array<struct<name, evidence>>``."""
    def entry(name: Column, evidence: Column) -> Column:
        return F.struct(
            F.trim(F.coalesce(name, F.lit(""))).alias("name"),
            F.substring(F.trim(F.coalesce(evidence, F.lit(""))), 1, 240).alias("evidence"),
        )

    quoted = F.transform(skills, lambda s: entry(s["name"], s.source_quote))

    def from_experience(e: Column) -> Column:
        evidence = F.when(F.coalesce(e.source_quote, F.lit("")) != "", e.source_quote).otherwise(e.title)
        return F.transform(e.skills, lambda s: entry(s, evidence))

    every = F.concat(quoted, F.flatten(F.transform(experiences, from_experience)))
    kept = F.filter(every, lambda x: (x["name"] != "") & (x.evidence != ""))
    return distinct_by_label(kept, lambda x: norm_label(x["name"]))


def matched_missing(evidenced: Column, role_skills: Column) -> Column:
    """``struct<matched, missing, coverage, strength>`` of a role's skills."""
    tops = F.transform(
        F.filter(role_skills, lambda s: F.trim(F.coalesce(s, F.lit(""))) != ""),
        lambda s: F.struct(s.alias("skill"), norm_label(s).alias("label")),
    )
    own = F.transform(evidenced, lambda e: F.struct(norm_label(e["name"]).alias("label"), e.evidence.alias("evidence")))

    def pair(r: Column, mine: Column) -> Column:
        hit = F.get(F.filter(mine, lambda e: labels_match(e.label, r.label)), F.lit(0))
        return F.struct(r.skill.alias("skill"), hit.evidence.alias("evidence"), r.label.alias("label"))

    def summary(paired: Column) -> Column:
        found = distinct_by_label(F.filter(paired, lambda p: p.evidence.isNotNull()), lambda p: p.label)
        return F.struct(
            F.transform(found, lambda p: F.struct(p.skill.alias("skill"), p.evidence.alias("evidence"))).alias("matched"),
            F.transform(F.filter(paired, lambda p: p.evidence.isNull()), lambda p: p.skill).alias("missing"),
            F.size(paired).alias("n"),
        )

    paired = let(own, lambda mine: F.transform(tops, lambda r: pair(r, mine)))
    return let(let(paired, summary), lambda s: F.struct(
        s.matched.alias("matched"), s.missing.alias("missing"),
        (F.size(s.matched) / F.greatest(F.lit(1), s.n)).alias("coverage"), F.size(s.matched).alias("strength"),
    ))


def readiness_band(coverage: Column, strength: Column, weights: RankWeights = RankWeights()) -> Column:
    """Preparation band; market numbers never enter."""
    return (
        F.when((coverage >= weights.ready_coverage) & (strength >= weights.min_evidence), "ready_now")
        .when(coverage >= weights.near_coverage, "near_ready")
        .otherwise("build_foundation")
    )


def band_reason(band: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for name, reason in BAND_REASON.items():
        chain = chain.when(band == name, reason)
    return chain


def search_queries(title: Column, aliases: Column, missing: Column) -> Column:
    """Two to four distinct queries without sensitive terms."""
    name = F.when(F.trim(F.coalesce(title, F.lit(""))) == "", GENERIC_TITLE).otherwise(F.trim(title))
    alias, gap = F.get(aliases, F.lit(0)), F.get(missing, F.lit(0))
    built = F.array_compact(F.array(
        *[F.concat(name, F.lit(suffix)) for suffix in TITLE_SUFFIXES],
        F.when(alias.isNotNull(), F.concat(alias, F.lit(JUNIOR_SUFFIX))),
        F.when(gap.isNotNull(), F.concat(name, F.lit(" "), gap)),
    ))
    clean = F.filter(F.transform(built, squeeze), lambda q: (q != "") & ~q.rlike(SENSITIVE_QUERY))
    more = F.array(F.concat(name, F.lit(JUNIOR_SUFFIX)))
    return let(
        F.slice(distinct_by_label(clean, lambda q: F.lower(q)), 1, 4),
        lambda kept: F.when(F.size(kept) >= 2, kept).otherwise(F.concat(kept, more)),
    )


def weekly_actions(missing: Column, matched: Column) -> Column:
    """Four weekly actions, each with a deliverable: gaps first, then evidenced skills, then a generic one."""
    def week(w: Column) -> Column:
        gap = F.get(missing, w - 1)
        own = F.get(matched, F.pmod(w - 1, F.greatest(F.size(matched), F.lit(1)))).skill
        focus = F.coalesce(gap, own, F.lit(GENERIC_FOCUS))

        def filled(wording: str) -> Column:
            return F.replace(F.replace(F.lit(wording), F.lit("{week}"), w.cast("string")), F.lit("{focus}"), focus)

        def told(i: int) -> Column:
            return F.when(gap.isNotNull(), filled(GAP_WEEK[i])).when(own.isNotNull(), filled(OWN_WEEK[i])).otherwise(filled(GENERIC_WEEK[i]))

        return F.struct(w.alias("week"), told(0).alias("action"), told(1).alias("deliverable"), told(2).alias("why"))

    return F.transform(F.sequence(F.lit(1), F.lit(4)), week)


def job_readiness(mode: Column, evidenced: Column, role_skills: Column, title: Column, aliases: Column,
                  weights: RankWeights = RankWeights()) -> Column:
    """Readiness struct in launch mode, null in explore mode; missing skills are capped at eight for display."""
    known = F.size(F.coalesce(role_skills, F.array().cast("array<string>"))) > 0

    def assemble(gap: Column) -> Column:
        band = F.when(known, readiness_band(gap.coverage, gap.strength, weights)).otherwise("build_foundation")
        return F.struct(
            band.alias("band"),
            F.when(known, band_reason(band)).otherwise(BAND_REASON["no_skills"]).alias("band_reason"),
            gap.matched.alias("matched_skills"),
            F.slice(gap.missing, 1, 8).alias("missing_skills"),
            gap.coverage.alias("coverage"),
            search_queries(title, aliases, gap.missing).alias("search_queries"),
            weekly_actions(gap.missing, gap.matched).alias("actions_30d"),
        )

    return F.when(mode == "launch", let(matched_missing(evidenced, role_skills), assemble))


def evidenced_skill_rows(profiles: DataFrame, key: str = "session_id") -> DataFrame:
    """Evidenced skills as a long table with their position."""
    return profiles.select(
        key, F.posexplode(evidenced_skills(F.col("skills"), F.col("experiences"))).alias("position", "e")
    ).select(key, "position", "e.name", "e.evidence")
