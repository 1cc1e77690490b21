import random

import pytest
from pyspark.sql import functions as F

from jobatlas.functions import grounding, numbers, parsing, privacy, scoring, text, turns


def values(spark, rows, expr, schema="v string"):
    df = spark.createDataFrame([(i, *([r] if not isinstance(r, tuple) else r)) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(expr.alias("x")).collect()]


def test_salary(spark):
    cases = {
        "9 - 15 triệu": (9.0, 15.0), "Đến 20 triệu": (None, 20.0), "$800-1200": (20.4, 30.6), "15.000.000": (15.0, 15.0),
        "1,5 triệu": (1.5, 1.5), "Thỏa thuận": (None, None), "Từ 10 triệu": (10.0, None), "15,000,000 - 20,000,000 VND": (15.0, 20.0),
        "": (None, None), "Lương thương lượng": (None, None), "$100": (2.5, 2.5),
    }
    assert [tuple(x) for x in values(spark, list(cases), parsing.parse_salary(F.col("v")))] == list(cases.values())


def test_posted_date(spark):
    at = "2026-07-18T23:30:00+07:00"
    cases = {
        "3 ngày trước": "2026-07-15", "Hôm nay": "2026-07-18", "17/07/2026": "2026-07-17", "2026-07-01": "2026-07-01",
        "Hạn nộp 30/07/2026": "2026-07-18", "25/12/2026": "2026-07-18", "31/02/2026": "2026-07-18", "Đăng gần đây": "2026-07-18",
    }
    got = values(spark, list(cases), parsing.parse_posted_date(F.col("v"), F.lit(at), F.lit("2026-01-01")))
    assert [str(d) for d in got] == list(cases.values())


def test_region_experience_seniority(spark):
    assert values(spark, ["Quận 1, TP. HCM", "Ha Noi", "Đà Nẵng", "Cần Thơ", None], parsing.map_region(F.col("v"))) == ["hcm", "hanoi", "danang", "other", "other"]
    assert values(spark, ["Không yêu cầu", "2 - 3 năm", "Theo thỏa thuận", None], parsing.parse_experience(F.col("v"))) == [0, 2, None, None]
    levels = values(spark, ["Internal auditor", "Director", "Senior Dev", "Middle Dev", "Kế toán"],
                    parsing.determine_seniority(F.col("v"), F.lit(None).cast("int"))["seniority"])
    assert levels == ["entry", "senior", "senior", "mid", "unknown"]


def test_text_forms(spark):
    assert values(spark, ["Lập  Trình ệ"], text.norm_match(F.col("v"))) == ["lập trình ệ"]
    assert values(spark, ["Đà Nẵng"], text.fold(F.col("v"))) == ["da nang"]
    assert values(spark, ["Đà Nẵng"], text.fold_nodj(F.col("v"))) == ["đa nang"]
    assert values(spark, ["Đà Nẵng Co."], text.ascii_tokens(F.col("v"))) == [["a", "nang", "co"]]
    assert values(spark, ["em biet lap trinh", "hạn dây chuyền", "kỹ thuật hàn dây"], text.contains_keywords(F.col("v"), ("lập trình", "hàn dây"))) == [True, False, True]


def test_urls(spark):
    urls = ["HTTPS://Ex.com/P?q=1#f", "https://ex.com/P?q=1"]
    assert values(spark, urls, parsing.canonical_url(F.col("v"))) == ["https://ex.com/P", "https://ex.com/P"]
    a, b = values(spark, [" https://EX.com/a#x", "https://ex.com/a"], parsing.stable_job_id(F.lit("s"), F.col("v")))
    assert a == b and a.startswith("s_") and len(a) == 18
    bad = ["http://localhost/a", "https://10.0.0.1/", "https://u@ex.com/", "ftp://ex.com", "https://x.local/", "https://[::1]/", "https://192.168.1.1"]
    assert values(spark, bad, privacy.is_safe_url(F.col("v"))) == [False] * len(bad)
    assert values(spark, ["https://8.8.8.8/", "https://vieclam.gov.vn"], privacy.is_safe_url(F.col("v"))) == [True, True]


def test_redaction(spark):
    raw = ["Em tên là Nam An, email a.b@c.vn, sđt 0912 345 678, GPA: 3.5/4.0, key sk-abcdefgh12", "email: x@y.com", "Em thích vẽ"]
    clean = values(spark, raw, privacy.redact(F.col("v")))
    assert "a.b@c.vn" not in clean[0] and "0912" not in clean[0] and "3.5" not in clean[0] and privacy.EMAIL_MARK in clean[0]
    assert values(spark, clean, privacy.has_meaningful_text(F.col("v"))) == [False, False, True] or clean[2] == "Em thích vẽ"
    nested = spark.range(1).select(privacy.redact_map(F.create_map(F.lit("gpa"), F.lit("4"), F.lit("note"), F.lit("a@b.vn"))).alias("m")).first()["m"]
    assert nested == {"note": privacy.EMAIL_MARK}


def test_section_cut(spark):
    raw = "Biết python\n== QUYỀN LỢI ==\njava"
    assert values(spark, [raw, "a\nb\n", "Benefits of x\nb"], parsing.relevant_description(F.col("v"))) == ["Biết python", "a\nb", ""]


@pytest.mark.parametrize("a,b,want", [("C", "CI/CD", False), ("c", "C", True), ("React", "React Native", True), ("", "x", False)])
def test_soft_label_match(spark, a, b, want):
    assert spark.range(1).select(scoring.skill_match(F.lit(a), F.lit(b))).first()[0] is want


def test_grounding(spark):
    allowed = F.array(F.lit("12.0"), F.lit("6.5"))
    assert values(spark, ["12 và 6,5", "13 tin", "không số"], grounding.numbers_grounded(F.col("v"), allowed)) == [True, False, True]
    assert values(spark, ["thích vẽ", "xyz"], grounding.quote_belongs(F.col("v"), F.array(F.lit("Em thích vẽ")))) == [True, False]


def test_exact_rounding(spark):
    raw = [2.675, 0.125, 0.135, 2.5, -1.005, 1e9 / 3]
    got = values(spark, raw, numbers.round_exact(F.col("v"), 2), "v double")
    assert got == [round(x, 2) for x in raw]


def test_turn_slots(spark):
    said = ["em chưa biết Python nhưng đã dùng SQL", "em biết Excel", "chưa biết excel"]
    assert values(spark, said, turns.tool_skills(F.col("v"))) == [["SQL"], ["Excel"], []]
    labels = values(spark, ["em học lớp 12, em thích vẽ tranh", "không biết nữa, bình thường", "em là sinh viên năm ba"], turns.compact_interest(F.col("v")))
    assert labels == ["em thích vẽ tranh", None, None]
    assert values(spark, ["em ở Đà Nẵng", "sài gòn", "huế"], turns.region_slot(F.col("v"))) == ["danang", "hcm", None]
    assert values(spark, ["muốn làm dữ liệu", "thích marketing", "hôm nay mưa"], turns.job_goal(F.col("v"))) == [
        "việc dữ liệu / phân tích entry-level", "việc digital marketing entry-level", None]


def test_indexed_quotes_equal_the_plain_test(spark):
    rng = random.Random(7)
    words = ["an", "bee", "cat", "dog", "Emu", "ß", "é"]
    quotes = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["  fox  an bee cat dog  ", ""[:0] or "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += ["zz" + q + "yy" for q in quotes] + [q[1:-1] for q in quotes] + [None, "", "  ", "fox  an bee cat dog"]
    items = spark.createDataFrame([(q,) for q in quotes[::3] + ["fox  an bee cat dog"]], "q string")
    packs = items.agg(F.collect_list("q").alias("plain"), F.collect_list(grounding.quote_item(F.col("q"))).alias("items"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").crossJoin(packs)
    got = rows.select(grounding.quotes_hold(F.col("t"), F.col("items")).alias("a"), grounding.quote_belongs(F.col("t"), F.col("plain")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len({r.a for r in got}) == 2
