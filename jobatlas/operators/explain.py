"""Grounded explanations of recommendations and their validation.

All functions take rows that hold one profile, one career and its market numbers:
``skills, interests, experiences, evidence_quotes, dimensions, job_goal`` of the profile,
``title, career_dimensions`` of the career and the market columns of ``career_market``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobatlas.functions.grounding import double_spellings, int_spelling, number_tokens, numbers_grounded, quote_belongs
from jobatlas.functions.let import let
from jobatlas.functions.privacy import looks_like_injection
from jobatlas.functions.scoring import DIMENSIONS, dim_vector, dominant_index, signal_strength
from jobatlas.operators.guidance import distinct_by_label

# Wording.
NO_QUOTE = "hồ sơ hiện tại của bạn"
DIMENSION_LABELS = {
    "ky_thuat": "thực hành–kỹ thuật",
    "phan_tich": "phân tích–logic",
    "sang_tao": "sáng tạo",
    "xa_hoi": "làm việc với con người",
    "quan_ly": "tổ chức–quản lý",
}
STAT_KEYS = ("demand_count", "salary", "trend", "entry_level", "source")
LOW_SIGNAL = 0.15


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _usable(quotes: Column) -> Column:
    trimmed = F.transform(quotes, lambda q: F.trim(_text(q)))
    return F.transform(
        F.filter(trimmed, lambda q: (q != "") & ~looks_like_injection(q)), lambda q: F.substring(q, 1, 240)
    )


def preferred_quotes() -> Column:
    return _usable(F.concat(
        F.transform("evidence_quotes", lambda q: q.quote),
        F.transform("skills", lambda s: s.source_quote),
        F.transform("experiences", lambda e: e.source_quote),
    ))


def allowed_quotes() -> Column:
    """Quotes an explanation may use, distinct without regard to case."""
    every = _usable(F.concat(
        F.transform("evidence_quotes", lambda q: q.quote),
        F.flatten(F.transform(
            "skills", lambda s: F.array(s.source_quote, F.when(_text(s.source_quote) != "", s["name"]))
        )),
        F.flatten(F.transform("experiences", lambda e: F.array(e.source_quote, e.title))),
        F.col("interests"),
        F.array(F.col("job_goal")),
    ))
    return distinct_by_label(every, lambda q: F.lower(q))


def selected_quote(top_skills: Column, title: Column) -> Column:
    """Best quote: 3 per market skill inside, 1 per title word, up to 3 for length; the first wins a tie."""
    candidates = let(preferred_quotes(), lambda p: F.when(F.size(p) > 0, p).otherwise(allowed_quotes()))
    skills = F.filter(F.transform(top_skills, lambda s: F.lower(s)), lambda s: s != "")
    words = F.regexp_extract_all(F.lower(_text(title)), F.lit(r"(?U)([\wÀ-ỹ]{3,})"), F.lit(1))

    def score(q: Column) -> Column:
        low = F.lower(q)
        return (
            3 * F.size(F.filter(skills, lambda s: low.contains(s)))
            + F.size(F.filter(words, lambda w: low.contains(w)))
            + F.least(F.lit(3), F.floor(F.length(q) / 20))
        ).cast("int")

    def best(found: Column) -> Column:
        return F.array_min(F.transform(found, lambda q, i: F.struct((-score(q)).alias("s"), i.alias("i"), q.alias("q")))).q

    return F.coalesce(F.substring(let(candidates, best), 1, 200), F.lit(NO_QUOTE))


def stat_numbers() -> Column:
    """Allowed spellings of every market number that may be claimed."""
    confident = ~F.coalesce("low_confidence", F.lit(True))
    return F.concat(
        int_spelling(F.col("demand_count_90d")), int_spelling(F.col("entry_level_count_90d")), int_spelling(F.lit(90)),
        *[double_spellings(F.col(c)) for c in ("salary_p25_trieu", "salary_p50_trieu", "salary_p75_trieu")],
        int_spelling(F.when(F.col("salary_sample_count") > 0, F.col("salary_sample_count"))),
        double_spellings(F.when(confident, F.col("trend_pct"))),
    )


def market_lines() -> Column:
    """Market evidence: demand always, pay from five samples, trend only when confident."""
    def line(text: Column, key: str, when: Column) -> Column:
        return F.when(when, F.struct(text.alias("stat"), F.lit(key).alias("stat_key")))

    p25, p50, p75 = (F.col(f"salary_p{q}_trieu") for q in (25, 50, 75))
    pay = F.when(
        p25.isNotNull() & p75.isNotNull(),
        F.concat(F.lit("Lương quan sát khoảng "), p25, F.lit("–"), p75, F.lit(" triệu, trung vị "), p50, F.lit(" triệu")),
    ).otherwise(F.concat(F.lit("Lương trung vị quan sát khoảng "), p50, F.lit(" triệu")))
    low = F.coalesce("low_confidence", F.lit(True))
    return F.array_compact(F.array(
        line(F.concat(F.col("demand_count_90d"), F.lit(" tin tuyển trong 90 ngày (snapshot)")), "demand_count",
             F.col("demand_count_90d").isNotNull()),
        line(pay, "salary", p50.isNotNull() & (F.col("salary_sample_count") >= 5)),
        line(F.concat(F.lit("Xu hướng tin tuyển thay đổi khoảng "), F.col("trend_pct"), F.lit("% giữa hai nửa cửa sổ")),
             "trend", F.col("trend_pct").isNotNull() & ~low),
        line(F.lit("Dữ liệu thị trường còn hạn chế — nên xem số demand như tham khảo"), "demand_count", low),
    ))


def _related(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(_text(a))), F.lower(F.trim(_text(b)))
    long_enough = F.least(F.length(x), F.length(y)) >= 4
    return (x != "") & (y != "") & ((x == y) | (long_enough & (x.contains(y) | y.contains(x))))


def template_why(counterfactual: Column) -> Column:
    """``struct<from_you, from_market, counterfactual>`` from facts only."""
    title, tops = F.col("title"), F.col("top_skills")
    skill = F.get(F.filter("skills", lambda s: (_text(s.source_quote) != "") & F.exists(tops, lambda t: _related(s["name"], t))), F.lit(0))
    interest = F.get(F.filter("interests", lambda i: _related(i, title) | F.exists(tops, lambda t: _related(i, t))), F.lit(0))
    vec = dim_vector(F.col("dimensions"))
    dim = F.get(F.array(*[F.lit(k) for k in DIMENSIONS]), dominant_index(vec))
    dim_label = F.get(F.array(*[F.lit(v) for v in DIMENSION_LABELS.values()]), dominant_index(vec))
    strong = (F.array_max(vec) >= 0.5) & (F.coalesce(F.try_element_at("career_dimensions", dim), F.lit(0.0)) >= 0.5)
    weak = signal_strength(F.col("skills"), F.col("interests"), F.col("dimensions")) < LOW_SIGNAL
    mapped = F.get(F.filter("evidence_quotes", lambda q: q.mapped_to == dim), F.lit(0)).quote
    base = selected_quote(tops, title)
    quote = (
        F.when(skill.isNotNull(), F.substring(skill.source_quote, 1, 200))
        .when(interest.isNull() & strong & mapped.isNotNull(), F.substring(mapped, 1, 200))
        .otherwise(base)
    )
    reason = (
        F.when(skill.isNotNull(), F.concat(
            F.lit("bạn đã có bằng chứng «"), skill["name"], F.lit("» và kỹ năng này xuất hiện trong tín hiệu của hướng "), title))
        .when(interest.isNotNull(), F.concat(
            F.lit("sở thích «"), interest, F.lit("» có liên hệ trực tiếp với hoạt động hoặc kỹ năng của hướng "), title))
        .when(strong, F.concat(
            F.lit("điều bạn kể tạo tín hiệu "), dim_label, F.lit(", một phần quan trọng trong công việc "), title))
        .when(weak, F.concat(
            F.lit("hồ sơ hiện chưa có nhiều tín hiệu cụ thể — gợi ý "), title,
            F.lit(" chủ yếu dựa trên dữ liệu thị trường; trò chuyện thêm để gợi ý cá nhân hoá hơn")))
        .otherwise(F.concat(
            F.lit("hướng "), title,
            F.lit(" được giữ lại từ tổng hợp nhiều tín hiệu yếu trong hồ sơ; "
                  "chưa có một kỹ năng trực tiếp đủ mạnh nên bạn cần kiểm chứng thêm")))
    )
    grounded = let(stat_numbers(), lambda ns: F.filter(market_lines(), lambda m: numbers_grounded(m.stat, ns)))
    return F.struct(
        F.array(F.struct(quote.alias("quote"), reason.alias("reason"))).alias("from_you"),
        grounded.alias("from_market"),
        counterfactual.alias("counterfactual"),
    )


def counterfactual_text(to_dim: Column, from_dim: Column, title: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in DIMENSION_LABELS.items() for x in kv])
    to_label = F.coalesce(F.try_element_at(labels, to_dim), to_dim)
    from_label = F.coalesce(F.try_element_at(labels, from_dim), from_dim)
    return F.concat(
        F.lit("Nếu bạn thiên về "), to_label, F.lit(" hơn "), from_label,
        F.lit(", gợi ý đầu bảng có thể là "), title, F.lit("."),
    )


def validated_why(why: Column, quotes: Column, numbers: Column, fact: Column) -> Column:
    """Drop foreign quotes and ungrounded numbers; null when no market line survives."""
    def you_ok(item: Column) -> Column:
        near = F.concat(numbers, number_tokens(item.quote))
        known = quote_belongs(item.quote, quotes) | (item.quote == NO_QUOTE)
        return ~looks_like_injection(item.quote) & ~looks_like_injection(item.reason) & known & numbers_grounded(item.reason, near)

    you = F.filter(why.from_you, you_ok)
    first = F.get(quotes, F.lit(0))
    fallback = F.array(F.struct(
        F.coalesce(F.substring(first, 1, 200), F.lit(NO_QUOTE)).alias("quote"),
        F.when(first.isNotNull(), "dựa trên điều bạn đã chia sẻ trong hồ sơ")
        .otherwise("gợi ý mang tính tham khảo theo hồ sơ hiện có").alias("reason"),
    ))
    market = F.filter(
        why.from_market,
        lambda m: ~looks_like_injection(m.stat) & numbers_grounded(m.stat, numbers) & m.stat_key.isin(*STAT_KEYS),
    )
    stated = F.trim(_text(why.counterfactual))
    text = F.when(stated == "", fact).when(
        numbers_grounded(stated, F.concat(numbers, number_tokens(fact))), stated
    ).otherwise(fact)
    return F.when(
        F.size(market) > 0,
        F.struct(
            F.when(F.size(you) > 0, you).otherwise(fallback).alias("from_you"),
            market.alias("from_market"),
            F.when(_text(text) != "", text)
            .otherwise("Nếu hồ sơ đổi, gợi ý có thể thay đổi — chỉ mang tính tham khảo.").alias("counterfactual"),
        ),
    )


def grounding_violations(rows: DataFrame, key: list[str], why: str = "why") -> DataFrame:
    """Explanation lines that break grounding; an empty result is the pass."""
    numbers, quotes = F.col("_numbers"), F.col("_quotes")

    def check_you(item: Column) -> Column:
        near = F.concat(numbers, number_tokens(item.quote))
        return F.when(~quote_belongs(item.quote, quotes), F.concat(F.lit("foreign quote: "), item.quote)).when(
            ~numbers_grounded(item.reason, near), F.concat(F.lit("ungrounded reason: "), item.reason)
        )

    w = F.col(why)
    facts = rows.select(*key, why, stat_numbers().alias("_numbers"), F.concat(allowed_quotes(), F.array(F.lit(NO_QUOTE))).alias("_quotes"))
    problems = F.array_compact(F.concat(
        F.transform(w.from_you, check_you),
        F.transform(w.from_market, lambda m: F.when(
            ~numbers_grounded(m.stat, numbers), F.concat(F.lit("ungrounded stat: "), m.stat))),
        F.array(F.when(~numbers_grounded(w.counterfactual, numbers), F.lit("ungrounded counterfactual"))),
    ))
    return facts.select(*key, F.explode(problems).alias("problem"))
