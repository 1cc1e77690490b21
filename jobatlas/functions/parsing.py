"""Posting field parsers: salary, region, experience, seniority, dates, URLs, HTML, sections."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobatlas.functions.let import let
from jobatlas.functions.numbers import round_exact
from jobatlas.functions.text import ascii_tokens, contains_any, norm_match, norm_region, squeeze, strip_space

# Fixed values.
VND_PER_USD = 25500.0
SALARY_UP_TO = ("đến", "tới", "upto", "up to", "dưới", "max")
SALARY_FROM = ("từ", "trên", "min", "tối thiểu")
REGION_KEYS = (
    ("hà nội", "hanoi"),
    ("ha noi", "hanoi"),
    ("hanoi", "hanoi"),
    ("hồ chí minh", "hcm"),
    ("tp hcm", "hcm"),
    ("tp. hcm", "hcm"),
    ("hcm", "hcm"),
    ("thủ đức", "hcm"),
    ("saigon", "hcm"),
    ("sài gòn", "hcm"),
    ("đà nẵng", "danang"),
    ("da nang", "danang"),
)
NO_EXPERIENCE = ("chưa có", "không yêu cầu", "không có", "fresher", "intern", "thực tập", "bất kỳ")
ENTRY_WORDS = ("intern", "thực tập", "fresher", "mới tốt nghiệp", "học việc")
SENIOR_WORDS = (
    "senior", "sr", "trưởng nhóm", "lead", "architect", "cto", "manager", "trưởng phòng", "giám đốc",
)
MID_WORDS = ("junior", "jr", "mid", "middle")
SENIORITY_REASON = {
    "entry_title": "Title contains entry keywords",
    "senior_title": "Title contains senior keywords",
    "mid_title": "Title contains mid/junior keywords",
    "no_years": "Experience required is 0 years",
    "many_years": "Experience required is >= 3 years",
    "some_years": "Experience required is 1-2 years",
    "none": "Could not determine seniority",
}
DEADLINE_WORDS = ("hạn", "han ", "deadline", "apply by", "hết hạn")
RECENT_WORDS = ("giờ trước", "phút trước", "mới", "gần đây", "hôm nay")
BENEFIT_HEADINGS = (
    "quyền lợi", "phúc lợi", "chế độ đãi ngộ", "why you'll love working here", "benefits", "what we offer",
)
COMPANY_NOISE = (
    "co", "company", "corp", "corporation", "jsc", "joint", "stock", "ltd", "limited", "inc", "llc",
    "tnhh", "cp", "cong", "ty", "vietnam", "viet", "nam",
)
TITLE_NOISE = (
    "senior", "junior", "fresher", "intern", "lead", "manager", "nhan", "vien", "tuyen", "gap",
    "urgent", "remote", "hcm", "hanoi", "da", "nang",
)
JOB_FAMILIES = {
    "IT": (
        "lập trình", "developer", "web dev", "frontend", "backend", "fullstack", "data analyst",
        "phân tích dữ liệu", "sysadmin", "quản trị mạng", "tester", "kiểm thử",
    ),
    "Marketing_Sales": (
        "marketing", "content", "copywriter", "sales", "bán hàng", "chăm sóc khách hàng", "telesale",
        "tuyển sinh", "tư vấn khóa học",
    ),
    "Admin_Finance": (
        "kế toán", "accountant", "hành chính", "văn phòng", "văn thư", "nhân sự", "hr",
    ),
    "Vocational_Technical": (
        "điện lạnh", "điều hòa", "hvac", "cnc", "cơ khí", "sửa chữa ô tô", "ô tô", "điện dân dụng",
        "thợ điện", "bếp", "đầu bếp", "quay phim", "chụp ảnh", "photographer",
    ),
    "Services_Others": (
        "điều dưỡng", "y tá", "nurse", "logistics", "xuất nhập khẩu", "kho vận", "hướng dẫn viên",
        "lễ tân", "phục vụ",
    ),
}


def parse_salary(raw: Column) -> Column:
    """Salary text to ``struct<salary_min, salary_max>`` in millions of VND."""
    return let(strip_space(F.lower(F.coalesce(raw, F.lit("")))), _salary_of)


def _salary_of(text: Column) -> Column:
    usd = text.contains("$") | text.contains("usd")
    plain = F.regexp_replace(text, r"(?U)(\d+),(\d+)(?=\s*(?:triệu|tr|trieu|usd|\$))", "$1.$2")
    plain = F.replace(plain, F.lit(","), F.lit(""))
    plain = F.regexp_replace(plain, r"(?<=\d)\.(?=\d{3}(?:\.(?:\d|vnd)|\s*(?:vnd|\s|$)))", "")
    plain = F.regexp_replace(plain, r"(\d+)\.(\d+)\.(\d+)", "$1$2$3")
    amounts = F.transform(
        F.regexp_extract_all(plain, F.lit(r"(\d+\.\d+|\d+)"), F.lit(1)),
        lambda t: _to_million(t.cast("double"), usd),
    )
    kind = F.when(contains_any(text, SALARY_UP_TO), "up").when(contains_any(text, SALARY_FROM), "from").otherwise("range")

    def bounds(v: Column) -> Column:
        first, second = F.get(v.amounts, F.lit(0)), F.get(v.amounts, F.lit(1))
        return F.struct(
            F.when(v.kind != "up", first).alias("salary_min"),
            F.when(v.kind == "up", first).when(v.kind == "range", F.coalesce(second, first)).alias("salary_max"),
        )

    empty = F.array().cast("array<double>")
    found = F.when(plain.rlike(r"\d"), amounts).otherwise(empty)
    return let(F.struct(found.alias("amounts"), kind.alias("kind")), bounds)


def _to_million(amount: Column, usd: Column) -> Column:
    scaled = F.when(amount >= 100000, amount / 1000000.0).otherwise(amount)
    return F.when(usd, round_exact(scaled * VND_PER_USD / 1000000.0, 1)).otherwise(scaled)


def map_region(raw: Column) -> Column:
    def first_key(text: Column) -> Column:
        chain = F.when(text == "", "other")
        for key, region in REGION_KEYS:
            chain = chain.when(text.contains(key), region)
        return chain.otherwise("other")

    return let(norm_region(F.coalesce(raw, F.lit(""))), first_key)


def parse_experience(raw: Column) -> Column:
    text = F.lower(F.coalesce(raw, F.lit("")))
    years = F.regexp_extract(text, r"(\d+)", 1).try_cast("int")
    return F.when(contains_any(text, NO_EXPERIENCE), F.lit(0)).otherwise(years)


def determine_seniority(title: Column, years: Column) -> Column:
    """``struct<seniority, confidence, reason>``; substring hits inside words are intended."""
    text = F.lower(F.coalesce(title, F.lit("")))

    def verdict(level: str, confidence: float, reason: str) -> Column:
        return F.struct(
            F.lit(level).alias("seniority"), F.lit(confidence).alias("confidence"), F.lit(SENIORITY_REASON[reason]).alias("reason")
        )

    return (
        F.when(contains_any(text, ENTRY_WORDS), verdict("entry", 1.0, "entry_title"))
        .when(contains_any(text, SENIOR_WORDS), verdict("senior", 1.0, "senior_title"))
        .when(contains_any(text, MID_WORDS), verdict("mid", 0.9, "mid_title"))
        .when(years == 0, verdict("entry", 0.8, "no_years"))
        .when(years >= 3, verdict("senior", 0.8, "many_years"))
        .when(years.isNotNull(), verdict("mid", 0.8, "some_years"))
        .otherwise(verdict("unknown", 0.0, "none"))
    )


def crawl_date(crawled_at: Column, as_of: Column) -> Column:
    """Local date of the crawl in the crawl's own offset, or ``as_of`` when unreadable."""
    return F.coalesce(F.try_to_date(F.substring(crawled_at, 1, 10), "yyyy-MM-dd"), as_of.cast("date"))


def parse_posted_date(raw: Column, crawled_at: Column, as_of: Column) -> Column:
    """Absolute posting date; deadlines, future dates and invalid dates give the crawl date."""
    crawled = crawl_date(crawled_at, as_of)
    return let(strip_space(F.lower(F.coalesce(raw, F.lit("")))), lambda text: _posted_on(text, crawled))


def _posted_on(text: Column, crawled: Column) -> Column:
    days = F.regexp_extract(text, r"(?U)(\d+)\s+ngày\s+trước", 1).try_cast("int")
    dmy, ymd = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})"

    def build(pattern: str, year: int, month: int, day: int) -> Column:
        parts = [F.regexp_extract(text, pattern, group) for group in (year, month, day)]
        return F.try_to_date(F.concat_ws("-", *parts), "yyyy-M-d")

    explicit = F.when(text.rlike(dmy), build(dmy, 3, 2, 1)).when(text.rlike(ymd), build(ymd, 1, 2, 3))
    valid = F.when(explicit <= F.date_add(crawled, 1), explicit)
    return (
        F.when(contains_any(text, DEADLINE_WORDS), crawled)
        .when(days.isNotNull(), F.date_sub(crawled, days))
        .when(contains_any(text, RECENT_WORDS), crawled)
        .otherwise(F.coalesce(valid, crawled))
    )


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, path kept, query and fragment dropped."""
    text = strip_space(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    netloc = F.lower(F.regexp_extract(rest, r"^//([^/?#]*)", 1))
    path = F.regexp_extract(F.regexp_replace(rest, r"^//[^/?#]*", ""), r"^([^?#]*)", 1)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""),
        path,
    )


def stable_job_id(source: Column, url: Column) -> Column:
    text = F.substring_index(F.lower(strip_space(F.coalesce(url, F.lit("")))), "#", 1)
    return F.concat(source, F.lit("_"), F.substring(F.sha2(text, 256), 1, 16))


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def decode_entities(text: Column) -> Column:
    """All named and numeric character references; only texts with an ampersand leave the JVM."""
    marked = text.contains("&")
    return F.when(marked, _unescaped(F.when(marked, text))).otherwise(text)


def clean_html(value: Column) -> Column:
    """Visible text of an HTML fragment on one line."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?is)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<(script|style|template)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return squeeze(decode_entities(text))


def clean_text(value: Column, limit: int) -> Column:
    return F.substring(clean_html(value), 1, limit)


def salary_text(minimum: Column, maximum: Column, scalar: Column, currency: Column, unit: Column) -> Column:
    """Structured salary back to the text the salary parser reads; only plain numbers count."""

    def numeric(c: Column) -> Column:
        return F.when(F.trim(c).rlike(r"^\d+(?:[.,]\d+)?$"), F.trim(c))

    low, high, one = numeric(minimum), numeric(maximum), numeric(scalar)
    tail = F.concat(F.lit(" "), F.coalesce(currency, F.lit("")), F.lit(" "), F.coalesce(unit, F.lit("")))
    return F.trim(
        F.when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit(" - "), high, tail))
        .when(low.isNotNull(), F.concat(F.lit("Từ "), low, tail))
        .when(high.isNotNull(), F.concat(F.lit("Đến "), high, tail))
        .when(one.isNotNull(), F.concat(one, tail))
        .otherwise("Thỏa thuận")
    )


def split_skills(value: Column) -> Column:
    """Comma, semicolon or bar separated labels, trimmed, distinct, in order."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"[,;|]"), strip_space)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def is_expired(value: Column, as_of: Column) -> Column:
    return F.coalesce(F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd") < as_of.cast("date"), F.lit(False))


def relevant_description(text: Column) -> Column:
    """Lines before the first benefits heading."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\R\z", ""), r"\R", -1)

    def is_heading(line: Column) -> Column:
        bare = F.regexp_replace(norm_match(line), r"^[=:#\-*–— ]+|[=:#\-*–— ]+$", "")
        test = F.lit(False)
        for prefix in BENEFIT_HEADINGS:
            test = test | (bare == prefix) | bare.startswith(prefix + " ")
        return test

    cut = F.array_position(F.transform(lines, is_heading), True)
    kept = F.when(cut > 0, F.slice(lines, F.lit(1), cut.cast("int") - 1)).otherwise(lines)
    return F.array_join(kept, "\n")


def company_anchor(company: Column) -> Column:
    """First two non-noise ASCII tokens, joined."""
    tokens = ascii_tokens(company)
    useful = F.slice(F.filter(tokens, lambda t: ~t.isin(*COMPANY_NOISE)), 1, 2)
    return (
        F.when(F.size(useful) > 0, F.array_join(useful, " "))
        .when(F.size(tokens) > 0, F.get(tokens, F.lit(0)))
        .otherwise("unknown")
    )


def title_anchors(title: Column) -> Column:
    useful = F.filter(ascii_tokens(title), lambda t: ~t.isin(*TITLE_NOISE) & (F.length(t) > 1))
    anchors = F.slice(F.array_sort(F.array_distinct(useful)), 1, 4)
    return F.when(F.size(anchors) > 0, anchors).otherwise(F.array(F.lit("unknown")))


def date_bucket(day: Column, width: int = 30) -> Column:
    """Ordinal day divided into fixed buckets; unknown dates fall into bucket 0."""
    ordinal = F.datediff(day.cast("date"), F.lit("0001-01-01").cast("date")) + 1
    return F.coalesce(F.floor(ordinal / width), F.lit(0)).cast("int")


def job_family(title: Column) -> Column:
    text = F.lower(F.coalesce(title, F.lit("")))
    chain = F.when(F.lit(False), F.lit(""))
    for family, words in JOB_FAMILIES.items():
        chain = chain.when(contains_any(text, words), family)
    return chain.otherwise("Others")


def salary_value(low: Column, high: Column) -> Column:
    """Mean of the available bounds; unknown when there is none or one is negative."""
    return F.when(F.least(low, high) >= 0, (F.coalesce(low, high) + F.coalesce(high, low)) / 2.0)
