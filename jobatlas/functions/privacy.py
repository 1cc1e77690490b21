"""Redaction of personal data, scoring bias tokens and unsafe text or links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobatlas.functions.let import let
from jobatlas.functions.text import contains_any, squeeze, strip_space

# Patterns and markers.
EMAIL = r"(?iuU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<!\d)(?:\+?84|0)(?:[\s.\-]?\d){8,10}(?!\d)"
SECRET = r"(?iuU)\bsk-[A-Z0-9_-]{8,}\b"
GPA_VALUE = (
    r"(?iuU)\b(?:GPA|điểm\s+trung\s+bình|diem\s+trung\s+binh)"
    r"\s*[:=]?\s*\d+(?:[.,]\d+)?(?:\s*/\s*\d+(?:[.,]\d+)?)?"
)
ADDRESS = r"(?iuU)\b(?:địa\s*chỉ|dia\s*chi)\s*[:=\-]?\s*[^\n,;.!?]{1,120}"
SELF_NAME = (
    r"(?iuU)\b(?:(?:tên|ten)\s+(?:em|tôi|toi|mình|minh|cháu|chau)|"
    r"(?:em|tôi|toi|mình|minh|cháu|chau)\s+(?:tên|ten))\s+(?:là|la)\s+[^\n,;.!?]{1,80}"
)
PROTECTED = (
    r"(?iuU)\b(?:giới\s*tính|con\s+trai|con\s+gái|nam\s+giới|nữ\s+giới|"
    r"(?:em|tôi|toi|mình|minh|cháu|chau)\s+(?:là|la)\s+(?:nam|nữ|nu)|"
    r"GPA|ĐH\s+Bách\s+Khoa|Bách\s+Khoa|NEU|FTU|RMIT|trường\s+top|trường\s+nổi\s+tiếng)\b"
)
SCORING_BIAS = (
    r"(?iuU)\b(?:giới\s*tính|con\s+trai|con\s+gái|nam\s+giới|nữ\s+giới|nữ|nam|GPA|điểm\s+trung\s+bình|"
    r"ĐH\s+Bách\s+Khoa|Bách\s+Khoa|NEU|FTU|RMIT|FPT\s+University|"
    r"trường\s+top|trường\s+nổi\s+tiếng|trường\s+chuyên)\b"
)
EMAIL_MARK = "[email đã ẩn]"
PHONE_MARK = "[số điện thoại đã ẩn]"
SECRET_MARK = "[khóa bí mật đã ẩn]"
SENSITIVE_KEYS = ("gender", "sex", "school", "school_name", "school_prestige", "gpa", "name")
INJECTION = ("ignore previous", "system:", "api_key", "you are dan", "root_access", "sk-")
ANY_MARK = r"\[(?:email|số điện thoại|khóa bí mật) đã ẩn\]"
CONTACT_FIELD = (
    r"(?iuU)\b(?:e-?mail|mail|số(?:\s+điện\s+thoại)?|sđt|phone|điện\s+thoại|api\s*key|key)\s*[:=]?\s*" + ANY_MARK
)
CONTACT_WORDS = (
    r"(?iuU)\b(?:em|tôi|toi|mình|minh|cháu|chau|của|cua|là|la|và|va|liên\s+hệ|lien\s+he|qua|số|so|"
    r"điện\s+thoại|dien\s+thoai|e-?mail|mail|sđt|sdt|phone|api|key)\b"
)
VAGUE_TRAITS = (
    "chịu áp lực", "chịu được áp lực", "chăm chỉ", "có trách nhiệm", "đam mê", "ngoại hình ưa nhìn",
    "nhanh nhẹn", "sức khỏe tốt", "trung thực", "tuổi từ",
)
PROTECTED_TERMS = (
    r"(?U)(?<!\w)(?:nam|nữ|giới tính|tuổi|ngoại hình|tốt nghiệp|bằng cấp|"
    r"male|female|gender|age requirement|degree required)(?!\w)"
)


# Order of the rules, and plain substrings without which a rule cannot match; most texts
# have none of them and skip the regular expressions.
REDACTIONS = (
    (EMAIL, EMAIL_MARK, ("@",)),
    (PHONE, PHONE_MARK, ("0", "84")),
    (SECRET, SECRET_MARK, ("sk-",)),
    (GPA_VALUE, " ", ("gpa", "điểm", "diem")),
    (ADDRESS, " ", ("chỉ", "chi")),
    (SELF_NAME, " ", ("tên", "ten")),
    (PROTECTED, " ", ("giới", "con", "là", "la", "gpa", "bách", "neu", "ftu", "rmit", "trường")),
)


def redact(text: Column) -> Column:
    """Contact data and secrets become markers; grades, addresses, names and protected terms go."""
    out = F.coalesce(text, F.lit(""))
    for pattern, mark, hints in REDACTIONS:
        out = let(out, lambda t, p=pattern, m=mark, h=hints: F.when(
            contains_any(F.lower(t), h), F.regexp_replace(t, p, m)).otherwise(t))
    return squeeze(out)


def redact_map(args: Column) -> Column:
    """Drop sensitive keys of a string map and redact every remaining value."""
    kept = F.map_filter(args, lambda k, _: ~k.isin(*SENSITIVE_KEYS))
    return F.transform_values(kept, lambda _, v: F.when(v.isNotNull(), redact(v)))


def redact_list_map(args: Column) -> Column:
    """As ``redact_map`` for maps of string lists."""
    kept = F.map_filter(args, lambda k, _: ~k.isin(*SENSITIVE_KEYS))
    return F.transform_values(kept, lambda _, v: F.transform(v, redact))


def scrub_scoring_text(text: Column) -> Column:
    """Remove gender and prestige tokens from text that is only used for ranking."""
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), SCORING_BIAS, " "))


def looks_like_injection(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), INJECTION)


def has_meaningful_text(text: Column) -> Column:
    """Something is left once redaction marks and contact boilerplate are gone."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), CONTACT_FIELD, " ")
    out = F.regexp_replace(out, "(?iu)" + ANY_MARK, " ")
    out = F.regexp_replace(out, CONTACT_WORDS, " ")
    return out.rlike(r"(?U)[\wÀ-ỹ]")


def is_denied_skill(normalized: Column) -> Column:
    """Vague traits and protected attributes are never new skills."""
    return normalized.isin(*VAGUE_TRAITS) | normalized.rlike(PROTECTED_TERMS)


# Address ranges that are not globally routable.
NON_GLOBAL_V4 = (
    r"^(?:0|10|127)\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|"
    r"^192\.0\.[02]\.|^192\.168\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(?:24\d|25[0-5])\."
)
NON_GLOBAL_V6 = r"^\[(?:::1?\]|fe[89ab]|f[cd]|2001:0?db8:)"


def url_host(url: Column) -> Column:
    """Lower-case host of an http(s) URL without port and trailing dots."""
    authority = F.regexp_extract(strip_space(url), r"(?i)^https?://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"^[^@]*@", ""))
    host = F.regexp_replace(host, r":\d*$", "")
    return F.regexp_replace(host, r"\.+$", "")


def is_safe_url(url: Column) -> Column:
    host = url_host(url)
    authority = F.regexp_extract(strip_space(url), r"(?i)^https?://([^/?#]*)", 1)
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    ipv4 = host.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    return F.coalesce(
        (host != "")
        & ~authority.rlike(r"^[^@:]+(?::[^@]*)?@")
        & ~host.isin("localhost", "localhost.localdomain")
        & ~host.endswith(".local")
        & ~(ipv4 & host.rlike(NON_GLOBAL_V4))
        & ~host.rlike(NON_GLOBAL_V6),
        F.lit(False),
    )


# Source tiers.
OFFICIAL_DOMAINS = (".gov.vn", "moet.gov.vn", "molisa.gov.vn")
JOB_BOARDS = ("itviec.com", "vietnamworks.com", "topcv.vn")


def source_tier(domain: Column, education=(".edu.vn",), official=OFFICIAL_DOMAINS, boards=JOB_BOARDS) -> Column:
    def ends(suffixes) -> Column:
        test = F.lit(False)
        for s in suffixes:
            test = test | domain.endswith(s)
        return test

    board = domain.isin(*boards) | ends([f".{b}" for b in boards])
    return (
        F.when(ends(education), "education").when(ends(official), "official").when(board, "job_board").otherwise("other")
    )
