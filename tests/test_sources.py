import json

import pyarrow as pa
from pyspark.sql import functions as F

from jobatlas.operators import sampling
from jobatlas.plans import normalize
from jobatlas.sources import commits, files, pages

def as_of():
    return F.lit("2026-07-18")


def html(job):
    return f'<html><script type="application/ld+json">{json.dumps({"@graph": [{"@type": "Org"}, job]})}</script></html>'


def test_jsonld(spark):
    job = {"@type": "JobPosting", "title": " Dev ", "hiringOrganization": {"name": "ACME"}, "validThrough": "2026-08-01",
           "jobLocation": [{"address": {"addressLocality": "Q1", "addressRegion": "HCM"}}, "Hà Nội"],
           "baseSalary": {"currency": "VND", "value": {"minValue": 9, "maxValue": "15", "unitText": "MONTH"}},
           "experienceRequirements": {"monthsOfExperience": 12}, "skills": "Python, SQL; Python", "description": "<p>a&amp;b</p>c"}
    bad_pay = {**job, "baseSalary": {"value": "Hấp dẫn"}, "skills": ["A", "A", "B"]}
    rows = [("https://x.vn/1?a", html(job)), ("https://x.vn/2", html({**job, "validThrough": "2026-07-01"})), ("https://x.vn/3", html(bad_pay)), ("https://x.vn/4", "<p>JobPosting ld+json</p>")]
    got = {r["url"]: r for r in pages.jsonld_postings(spark.createDataFrame(rows, "url string, html string"), "s", as_of(), as_of()).collect()}
    assert set(got) == {"https://x.vn/1", "https://x.vn/3"}
    r = got["https://x.vn/1"]
    assert (r["title"], r["company"], r["region_raw"], r["salary_raw"], r["experience_raw"]) == ("Dev", "ACME", "Q1, HCM, Hà Nội", "9 - 15 VND MONTH", "12 tháng")
    assert r["skills"] == ["Python", "SQL"] and r["description"] == "a&b c" and r["posted_date_raw"] == "Đăng gần đây"
    assert got["https://x.vn/3"]["salary_raw"] == "Thỏa thuận" and got["https://x.vn/3"]["skills"] == ["A", "B"]


def test_framework_payload(spark):
    job = {"jobId": 7, "jobTitle": "Data", "companyName": "Beta", "isActive": True, "isSalaryVisible": True, "salaryMin": 500, "salaryMax": 900,
           "salaryCurrency": "USD", "jobDescription": "$1a", "jobRequirement": "<b>SQL</b>", "skills": [{"skillName": "SQL"}, {"name": "R"}], "locations": "$1b", "jobLevelVI": "Nhân viên"}
    payload = '0:{"x":1}\n1a:T20,<p>Mô tả, dài</p>\n1b:[{"name":"Hà Nội"}]\n2:' + json.dumps(job, ensure_ascii=False)
    half = len(payload) // 2
    body = "".join(f"<script>self.__next_f.push({json.dumps([1, part], ensure_ascii=False)})</script>" for part in (payload[:half], payload[half:]))
    got = pages.payload_postings(spark.createDataFrame([("https://v.vn/a-jv", body)], "url string, html string"), "v", as_of(), as_of()).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["title"], r["company"], r["salary_raw"], r["region_raw"]) == ("Data", "Beta", "500 - 900 USD", "Hà Nội")
    assert r["description"] == "Mô tả, dài SQL" and r["skills"] == ["SQL", "R"] and r["experience_raw"] == "Nhân viên"


def test_resume_offset(spark):
    urls = spark.createDataFrame([(f"https://a.vn/{i}", i) for i in range(8)], "url string, pos int")
    done = spark.createDataFrame([("x", "https://a.vn/1"), ("y", "https://A.vn/4?q=1")], "id string, url string")
    assert pages.resume_offset(urls, done) == 5
    assert pages.remaining_urls(urls, done, "s").count() == 3


def test_scans_and_atomic_sink(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "A_1.jsonl").write_text('{"id": "1", "v": "old"}\n\nbroken\n')
    (folder / "b_2.jsonl").write_text('{"id": "1", "v": "new"}\n{"id": "2", "v": "x"}\n')
    good, bad = files.split_rejects(files.read_tolerant(spark, str(folder), "id string, v string"))
    assert bad.count() == 1 and {r["id"]: r["v"] for r in files.latest_per_key(good).collect()} == {"1": "new", "2": "x"}
    try:
        files.read_strict(spark, str(folder), "id string, v string").collect()
    except Exception:
        pass
    else:
        raise AssertionError("must fail")
    target = str(tmp_path / "out")
    for n in (3, 5):
        written = files.write_atomic(spark.range(n).select(F.col("id").cast("string")), target)
        assert written == commits.current_folder(spark, target) and files.read_strict(spark, written, "id string").count() == n
    assert files.write_report(spark.range(1), str(tmp_path / "dry"), dry_run=True).count() == 1 and not (tmp_path / "dry").exists()


def test_pipeline_end_to_end(spark):
    text = "Công việc yêu cầu Python và SQL. " * 5
    raw = [(f"p{i}", "s", f"https://x/{i}", t, c, "Hà Nội", "10 - 20 triệu", "2 năm", f"{i} ngày trước", d, [], "2026-07-18T00:00:00+07:00")
           for i, (t, c, d) in enumerate([("Data Analyst", "ACME", text), ("Data Analyst", "ACME", text), ("Kế toán", "ACME", text), ("Data Analyst", "Beta", "ngắn")])]
    df = spark.createDataFrame(raw, "id string, source string, url string, title string, company string, region_raw string, salary_raw string, experience_raw string, "
                                    "posted_date_raw string, description string, skills array<string>, crawled_at string")
    from jobatlas.operators import matching

    posts = normalize.normalize(df, as_of())
    aliases = matching.alias_table(spark.createDataFrame([("Python", ["py"], 0), ("SQL", ["sql"], 1)], "name string, aliases array<string>, taxonomy_order int"))
    enriched = normalize.enrich(posts, aliases, "1.0.0", "h")
    kb = spark.createDataFrame([("data", "Data", ["data analyst"])], "career_id string, title string, title_patterns array<string>")
    mapped = normalize.map_careers(enriched, matching.pattern_table(kb), "k").cache()
    got = {r["id"]: r for r in mapped.collect()}
    assert set(got) == {"p1", "p2"} and got["p1"]["career_id"] == "data" and got["p2"]["career_id"] == "unmapped"
    assert got["p1"]["skills"] == ["Python", "SQL"] and got["p1"]["skill_extraction"]["low_signal"]
    tables = normalize.market_tables(mapped, kb.select("career_id", "title"))
    assert tables["career_stats"].where("region = 'all'").first()["demand_count_90d"] == 1


def test_balanced_sample(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("family"), F.when(F.col("id") < 450, "x").otherwise("y").alias("region"))
    got = sampling.balanced_sample(rows, "family", "region", ["0", "1"], per_family=20, total=50)
    assert got.count() == 50 and got.select("id").distinct().count() == 50
    assert got.where("family = '0' and region = 'y'").count() >= 10


def test_commit_log(spark, tmp_path):
    """Readers meet whole versions only; failed and half-finished writers change nothing; old versions go by age."""
    import pytest

    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        commits.read_current(spark, path)
    for n in (3, 5):
        commits.commit(spark.range(n), path)
    assert commits.read_current(spark, path).count() == 5 and commits.read_current(spark, path, version=1).count() == 3
    broken = spark.range(4).select(F.raise_error(F.concat(F.lit("no "), F.col("id").cast("string"))).cast("int").alias("id"))
    with pytest.raises(Exception, match="no "):
        commits.commit(broken, path)
    assert commits.versions(spark, path) == [1, 2] and commits.read_current(spark, path).count() == 5
    # A writer that died in the middle of its commit: the number is taken, the version is not there.
    (tmp_path / "t" / "_commits" / "000000000003").write_text("name without an end")
    assert commits.read_current(spark, path).count() == 5
    held = commits.read_current(spark, path)
    commits.commit(spark.range(7), path)
    assert commits.versions(spark, path) == [1, 2, 4] and commits.read_current(spark, path).count() == 7 and held.count() == 5
    now = max(f.stat().st_mtime_ns for f in (tmp_path / "t" / "_commits").iterdir()) // 1_000_000
    assert commits.expire(spark, path, 3_600_000, now) == []
    assert commits.expire(spark, path, 1000, now + 10_000) == [1, 2]
    assert len(list((tmp_path / "t" / "_data").iterdir())) == 1 and commits.read_current(spark, path).count() == 7


def test_pages_are_parsed_in_small_slices():
    n = 3 * pages.PAGES_A_SLICE + 1
    scripts = [['not json', '{"@graph": [{"x": 1}, {"@type": "JobPosting", "title": "T%d"}]}' % i] for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array(scripts, pa.list_(pa.string()))], ["url", "scripts"])
    parts = list(pages._first_jobs(iter([batch])))
    assert max(p.num_rows for p in parts) <= pages.PAGES_A_SLICE
    assert [json.loads(j)["title"] for p in parts for j in p.column("job").to_pylist()] == [f"T{i}" for i in range(n)]
