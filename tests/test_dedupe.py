import datetime as dt
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from jobatlas.functions.parsing import company_anchor
from jobatlas.operators import dedupe

SCHEMA = "id string, title string, company string, posted_date date, crawled_at string"


def similar(a, b):
    return SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio() >= 0.85


def brute(rows, anchors):
    kept = []
    for r in sorted(rows, key=lambda r: (r[4], r[0]), reverse=True):
        dup = any(
            anchors[r[2]] == anchors[k[2]] and abs((r[3] - k[3]).days) <= 30 and similar(r[1], k[1]) and similar(r[2], k[2])
            for k in kept if r[3] and k[3]
        )
        if not dup:
            kept.append(r)
    return sorted(k[0] for k in kept)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    anchors = {r["company"]: r["a"] for r in df.select("company", company_anchor(F.col("company")).alias("a")).distinct().collect()}
    assert sorted(r["id"] for r in dedupe.deduplicate_postings(df).collect()) == brute(rows, anchors)


def test_reference_cases(spark):
    d = dt.date(2026, 7, 1)
    rows = [
        ("a", "Lập trình viên Python", "FPT Software", d, "2026-07-03"), ("b", "Lập trình viên  Python", "FPT Software Co.", d - dt.timedelta(days=5), "2026-07-02"),
        ("c", "Lập trình viên Python", "FPT Software", d - dt.timedelta(days=60), "2026-05-01"), ("d", "Lập trình viên Python", "VNG", d, "2026-07-01"),
    ]
    check(spark, rows)


def test_random_hot_company_equals_brute_force(spark):
    rng = random.Random(11)
    base = ["nhân viên kinh doanh", "kế toán tổng hợp", "data analyst", "qa", "x", "lập trình viên java", "thợ điện"]
    rows = []
    for i in range(220):
        title = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(title))
            title = title[:k] + rng.choice(["", " ", "a", "n", "1"]) + title[k + rng.randint(0, 1):]
        company = rng.choice(["Acme Group", "Acme Group", "Acme Groupe", "ACME group JSC", "Beta"])
        day = dt.date(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 120))
        rows.append((f"p{i:03d}", title, company, day, f"2026-06-{rng.randint(1, 28):02d}"))
    rows.append(("undated", "qa", "Beta", None, "2026-06-30"))
    check(spark, rows)


def test_repeated_ids_and_uneven_titles_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        title = rng.choice(["nhân viên kinh doanh", "chuyên viên phân tích dữ liệu cao cấp", "data analyst senior hanoi"]) + rng.choice(["", " 1", " hcm", " toàn quốc"])
        day = dt.date(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 90))
        rows.append((f"p{rng.randint(0, 30):03d}", title, rng.choice(["Acme Group", "Acme Groupe"]), day, f"2026-06-{i % 28 + 1:02d}T{i:03d}"))
    check(spark, rows)


def test_rows_with_one_id_keep_one(spark):
    d = dt.date(2026, 7, 1)
    rows = [("a", "Kế toán", "VNG", d, "2026-07-03"), ("a", "Kế toán", "VNG", d, "2026-07-03"), ("a", "Kế toán", "VNG", d - dt.timedelta(days=3), "2026-07-01"), ("a", "Kế toán", "VNG", None, None)]
    got = dedupe.deduplicate_postings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["id"], r["posted_date"] == d) for r in got) == [("a", False), ("a", True)]
    assert dedupe.deduplicate_postings(spark.createDataFrame([], SCHEMA)).count() == 0
