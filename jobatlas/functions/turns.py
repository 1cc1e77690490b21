"""Stateless signals of one conversation turn, as columns.

Everything that can be read from the text alone is computed here for all turns in
parallel; the ordered session fold then only merges these small values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobatlas.functions.privacy import has_meaningful_text, looks_like_injection, redact
from jobatlas.functions.text import (
    FOLD_STOP, any_phrase_regex, contains_any, contains_folded_phrases, contains_keywords, fold, has_vietnamese_marks,
    phrase_regex, py_fold, quote_regex, squeeze, word_tokens,
)

# Word lists of the profile rules.
DIM_KEYWORDS = {
    "ky_thuat": (
        "sửa", "sửa đồ", "sửa quạt", "sửa xe", "sửa máy", "sửa chữa", "đồ điện", "điện lạnh", "mạch điện", "dây điện",
        "máy móc", "vận hành máy", "lắp ráp", "lắp đặt", "code", "lập trình", "react", "python", "cơ khí", "hàn dây", "mỏ hàn",
    ),
    "phan_tich": ("dữ liệu", "excel", "phân tích", "dashboard", "số liệu", "logic", "bài toán", "toán học", "sql"),
    "sang_tao": (
        "vẽ", "vẽ tranh", "vẽ tay", "vẽ logo", "vẽ minh họa", "thiết kế", "nhạc", "sáng tạo", "viết", "viết bài",
        "viết truyện", "viết content", "viết lách", "photoshop", "figma", "màu sắc", "quay video", "dựng phim",
    ),
    "xa_hoi": (
        "dạy", "dạy học", "dạy bạn", "dạy trẻ", "dạy tiếng", "giảng dạy", "hướng dẫn", "giúp", "tình nguyện", "chăm sóc",
        "tư vấn", "giao tiếp",
    ),
    "quan_ly": ("tổ chức", "xếp lịch", "lên lịch", "làm lịch", "nhóm", "quản lý", "điều phối", "kinh doanh"),
}
NO_SKILL_CUES = (
    "không biết", "chưa biết", "không dùng", "chưa dùng", "không giỏi", "chưa giỏi", "không có kinh nghiệm",
)
NEGATION_CUES = (
    "không thích", "không muốn", "hết thích", "không còn thích", "không còn", "ghét", "chán", "không giỏi", "không hợp",
    "chưa biết", "không biết", "bỏ", "xóa",
)
UNCERTAIN_CUES = ("không biết", "chưa biết", "không rõ", "chưa rõ", "không có gì", "tùy", "bình thường")
INTEREST_STOPWORDS = (
    "em", "mình", "bạn", "thích", "rất", "khá", "cũng", "và", "là", "có", "được", "hay", "nhiều", "một", "chút", "hơi",
    "thấy", "vui", "làm", "nữa", "không", "à", "gì", "cái", "này", "đó", "the", "a",
)
DECLINES = (
    "không rõ", "khong ro", "chưa biết", "chua biet", "không có", "khong co", "tùy", "không quan trọng", "không ràng buộc",
)
WANTS_RESULTS = ("xem goi y", "xem huong", "xem ket qua", "xem nghe", "goi y nghe", "cho em xem", "cho minh xem")
WANTS_DONE = (
    "ok", "được", "duoc", "sẵn sàng", "san sang", "xem hướng", "xem goi y", "đúng rồi", "dung roi", "ổn", "xon",
)
ACTIVITIES = (
    "sửa", "vẽ", "code", "lập trình", "dashboard", "excel", "nấu", "dạy", "thiết kế", "chăm", "phân tích", "máy móc",
    "đồ điện", "hàn", "game", "viết", "quay video", "edit", "đọc sách", "thể thao", "bóng đá", "làm vườn", "bán hàng",
    "tổ chức", "giúp", "tình nguyện",
)
INTEREST_CUES = ("thích", "mê", "đam mê", "yêu thích", "hứng thú", "muốn thử", "hay làm", "quên cả thời gian")
NOT_INTEREST = (
    "em o ", "minh o ", "gia dinh", "ngan sach", "khong co nhieu tien", "hoc phi", "cho em xem", "cho minh xem",
    "xem goi y", "xem huong", "xem ket qua", "san sang", "dung roi",
)
EDUCATION_ONLY = (
    r"^(?:em|minh|toi)?\s*(?:dang)?\s*(?:hoc|la)?\s*"
    r"(?:lop\s*\d+|cap\s*\d|hoc sinh|sinh vien(?:\s*nam\s*\w+)?)\s*$"
)
GOAL_INTENT = ("muốn làm", "tìm việc", "ứng tuyển", "entry", "fresher")
GOAL_MARKERS = (
    "muốn làm", "tìm việc", "muốn tìm", "entry-level", "entry level", "fresher", "thực tập", "data", "dữ liệu", "lập trình",
    "marketing", "kế toán", "thiết kế",
)
GOALS = (
    (("data", "dữ liệu", "excel", "dashboard"), "việc dữ liệu / phân tích entry-level"),
    (("lập trình", "react", "python", "web", "code"), "việc lập trình / web entry-level"),
    (("marketing",), "việc digital marketing entry-level"),
)
NO_EXPERIENCE_YET = (
    "chưa có thực tập", "chưa có project", "chưa có kinh nghiệm", "không có project", "không có thực tập",
    "chưa từng thực tập",
)
EXPERIENCE_WORDS = ("project", "dashboard", "ứng dụng", "app", "thực tập", "internship")
EXPERIENCE_TOOLS = (
    ("excel", "Excel"), ("react", "React"), ("python", "Python"), ("sql", "SQL"), ("figma", "Figma"),
    ("powerpoint", "Powerpoint"), ("word", "Word"),
)
TOOLS = (
    ("excel", "Excel"), ("react", "React"), ("python", "Python"), ("figma", "Figma"), ("photoshop", "Photoshop"),
    ("javascript", "JavaScript"), ("sql", "SQL"),
)
KNOWN_SKILLS = ("Excel", "React", "Python", "SQL", "Figma", "Powerpoint", "Word", "Photoshop", "JavaScript")
ABILITY_WORDS = ("excel", "python", "react", "khen", "giỏi", "làm tốt")
REGION_WORDS = (
    (("ha noi", "hanoi"), "hanoi"), (("hcm", "sai gon"), "hcm"), (("da nang", "danang"), "danang"),
)
LOW_BUDGET = ("hạn chế", "eo hẹp", "không có nhiều tiền", "ngân sách thấp")
CLAUSE_BREAK = r"(?U)[,.!?;]|\b(?:nhung|tuy nhien|con|song)\b"
LOOK_BACK = 64


def _contains_folded(folded: Column, cues) -> Column:
    return contains_any(folded, sorted({py_fold(c) for c in cues}))


def mention_starts(text: Column, pattern: Column, width: Column) -> Column:
    """0-based starts of every match of a fixed-width pattern."""
    pieces = F.split(text, pattern, -1)
    lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.length)
    ends = F.aggregate(
        lengths, F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n + width)),
    )
    return F.transform(ends, lambda e: e - width)


def all_mentions_negated(folded: Column, pattern: Column, width: Column, cues) -> Column:
    """Every mention has a negation cue before it inside its own clause."""
    starts = mention_starts(folded, pattern, width)
    cue = "|".join(quote_regex(c) for c in sorted({py_fold(c) for c in cues}))

    def negated(s: Column) -> Column:
        before = F.substring(folded, F.greatest(s - LOOK_BACK + 1, F.lit(1)), F.least(s, F.lit(LOOK_BACK)))
        return F.element_at(F.split(before, CLAUSE_BREAK, -1), -1).rlike(cue)

    return (F.size(starts) > 0) & F.forall(starts, negated)


def _keyword_array(keywords) -> Column:
    rows = []
    for k in keywords:
        f = py_fold(k)
        rows.append(F.struct(
            F.lit("(?U)" + phrase_regex(k.lower())).alias("raw"), F.lit("(?U)" + phrase_regex(f)).alias("folded"),
            F.lit(rf"(?U)(?<!\w){quote_regex(f)}(?!\w)").alias("exact"), F.lit(len(f)).alias("width"),
            F.lit(f in FOLD_STOP).alias("stop"),
        ))
    return F.array(*rows)


def affirmed(text: Column, folded: Column, keywords, cues) -> Column:
    """Some keyword is mentioned and not every mention of it is negated.

    One scan decides texts without the keywords or without any cue; only the rest is
    looked at keyword by keyword.
    """
    lowered = F.lower(text)
    marked = has_vietnamese_marks(lowered)

    def positive(k: Column) -> Column:
        present = F.regexp_like(lowered, k.raw) | (~marked & ~k.stop & F.regexp_like(folded, k.folded))
        return present & ~all_mentions_negated(folded, k.exact, k.width, cues)

    return contains_keywords(text, keywords) & (
        ~_contains_folded(folded, cues) | F.exists(_keyword_array(keywords), positive)
    )


def _collect(pairs) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in pairs]))


def content_words(text: Column) -> Column:
    """Folded words of an interest label without filler."""
    stop = sorted({py_fold(w) for w in INTEREST_STOPWORDS})
    words = F.regexp_extract_all(fold(text), F.lit(r"([a-z]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*stop) & (F.length(w) >= 2))


def interest_matches_removed(candidate: Column, removed: Column) -> Column:
    gone = content_words(removed)
    same = F.trim(fold(candidate)) == F.trim(fold(removed))
    return F.when(F.size(gone) == 0, same).otherwise(F.size(F.array_except(gone, content_words(candidate))) == 0)


def compact_interest(text: Column) -> Column:
    """Short interest label: the first clause with an activity, else the first with a liking cue."""
    raw = squeeze(F.coalesce(text, F.lit("")))
    clauses = F.filter(F.transform(F.split(raw, r"[.!?,;]"), lambda c: F.trim(c)), lambda c: c != "")

    def describe(c: Column) -> Column:
        f = fold(c)
        skip = f.rlike("(?U)" + EDUCATION_ONLY) | contains_any(f, NOT_INTEREST)
        return F.struct(
            c.alias("c"), (~skip & contains_keywords(c, ACTIVITIES)).alias("activity"),
            (~skip & contains_keywords(c, INTEREST_CUES)).alias("cue"),
        )

    described = F.transform(clauses, describe)
    active = F.get(F.filter(described, lambda d: d.activity), F.lit(0))["c"]
    liked = F.get(F.filter(described, lambda d: d.cue), F.lit(0))["c"]
    unsure = _contains_folded(fold(raw), UNCERTAIN_CUES)
    best = F.coalesce(active, F.when(~unsure, liked))
    label = F.when(F.length(best) <= 40, best).otherwise(F.concat(F.substring(best, 1, 37), F.lit("…")))
    return F.when((F.length(raw) >= 8) & ~looks_like_injection(raw), label)


def job_goal(text: Column) -> Column:
    folded = fold(text)
    cleaned = squeeze(text)
    chain = F.when(~contains_folded_phrases(folded, GOAL_MARKERS), F.lit(None).cast("string"))
    for words, goal in GOALS:
        chain = chain.when(contains_folded_phrases(folded, words), goal)
    short = F.when(F.length(cleaned) <= 80, cleaned).otherwise(F.concat(F.substring(cleaned, 1, 77), F.lit("…")))
    return chain.otherwise(short)


def declines_constraint(text: Column) -> Column:
    return contains_any(F.lower(text), DECLINES)


def wants_results(text: Column) -> Column:
    return contains_any(fold(text), WANTS_RESULTS)


def wants_done(text: Column) -> Column:
    return contains_any(F.lower(text), WANTS_DONE)


def region_slot(text: Column) -> Column:
    folded = fold(text)
    chain = F.when(F.lit(False), F.lit(""))
    for words, region in REGION_WORDS:
        chain = chain.when(contains_folded_phrases(folded, words), region)
    return chain


def budget_slot(text: Column) -> Column:
    return F.when(contains_folded_phrases(fold(text), LOW_BUDGET), "hạn chế")


def education_slot(text: Column, mode: Column) -> Column:
    folded = fold(text)
    launch = F.when(contains_folded_phrases(folded, ("mới tốt nghiệp", "tốt nghiệp")), "recent_graduate").when(
        contains_folded_phrases(folded, ("năm cuối", "final year")), "final_year"
    )
    explore = F.when(contains_folded_phrases(folded, ("lớp 12", "lớp 11", "cấp 3", "học sinh")), "high_school")
    return F.when(mode == "launch", launch).otherwise(explore)


def no_experience_slot(text: Column) -> Column:
    return contains_folded_phrases(fold(text), NO_EXPERIENCE_YET)


def affirmed_dimensions(text: Column) -> Column:
    folded = fold(text)
    return _collect((d, affirmed(text, folded, kws, NEGATION_CUES + NO_SKILL_CUES)) for d, kws in DIM_KEYWORDS.items())


def mentioned_dimensions(text: Column) -> Column:
    return _collect((d, contains_keywords(text, kws)) for d, kws in DIM_KEYWORDS.items())


def tool_skills(text: Column, tools=TOOLS) -> Column:
    folded = fold(text)
    return _collect((name, affirmed(text, folded, (word,), NO_SKILL_CUES)) for word, name in tools)


SIGNAL_COLUMNS = (
    "text", "opening", "meaningful", "injection", "declines", "wants_results", "wants_done", "negation", "dims_hit",
    "dims_mentioned", "tools", "exp_tools", "skills_mentioned", "words", "label", "ability", "education", "goal",
    "goal_intent", "no_experience", "exp_title", "exp_kind", "region", "budget",
)


def turn_signals(turns: DataFrame, text: str = "text", mode: str = "journey_mode") -> DataFrame:
    """Turns with their redacted text and every stateless signal."""
    base = turns.withColumn("opening", F.trim(F.coalesce(F.col(text), F.lit(""))) == "").withColumn("text", redact(F.col(text)))
    t, folded = F.col("text"), F.col("_folded")
    base = base.withColumn("_folded", fold(t))
    negation = _contains_folded(folded, NEGATION_CUES)
    exp_title = F.when(contains_folded_phrases(folded, ("dashboard",)), "Dashboard").when(
        contains_folded_phrases(folded, ("todo", "react")), "App todo"
    ).otherwise("Project từ hội thoại")
    return base.withColumns({
        "meaningful": has_meaningful_text(t), "injection": looks_like_injection(t), "declines": declines_constraint(t),
        "wants_results": contains_any(folded, WANTS_RESULTS), "wants_done": wants_done(t), "negation": negation,
        "dims_hit": _collect(
            (d, affirmed(t, folded, kws, NEGATION_CUES + NO_SKILL_CUES)) for d, kws in DIM_KEYWORDS.items()),
        "dims_mentioned": mentioned_dimensions(t),
        "tools": _collect((name, affirmed(t, folded, (w,), NO_SKILL_CUES)) for w, name in TOOLS),
        "exp_tools": _collect((name, affirmed(folded, folded, (w,), NO_SKILL_CUES)) for w, name in EXPERIENCE_TOOLS),
        "skills_mentioned": _collect((n, contains_folded_phrases(folded, (n,))) for n in KNOWN_SKILLS),
        "words": F.when(negation, F.array_distinct(word_tokens(folded))).otherwise(F.array().cast("array<string>")),
        "label": compact_interest(t), "ability": contains_keywords(t, ABILITY_WORDS),
        "education": education_slot(t, F.col(mode)), "goal": job_goal(t),
        "goal_intent": contains_folded_phrases(folded, GOAL_INTENT), "no_experience": no_experience_slot(t),
        "exp_title": F.when(contains_folded_phrases(folded, EXPERIENCE_WORDS), exp_title),
        "exp_kind": F.when(contains_folded_phrases(folded, ("thực tập", "internship")), "internship").otherwise("project"),
        "region": region_slot(t), "budget": budget_slot(t),
    }).drop("_folded")
