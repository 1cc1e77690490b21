"""Postings from web pages: embedded job descriptions, framework payloads, sitemaps, resume offsets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobatlas.functions.parsing import canonical_url, clean_html, is_expired, salary_text, split_skills, stable_job_id
from jobatlas.operators.sampling import seeded_order

# Fixed values.
LD_JSON = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
PUSHED = r"(?is)<script[^>]*>self\.__next_f\.push\((\[.*?\])\)</script>"
SEGMENT_KEY = r"(?:^|\n)([0-9a-f]+):"
UNKNOWN_EXPERIENCE = "Không rõ"
NEGOTIABLE = "Thỏa thuận"
RECENT = "Đăng gần đây"


def _deep_find(value, wanted: str):
    """Depth-first search of the first object of a type."""
    stack = [value]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            if node.get("@type") == wanted:
                return node
            stack.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            stack.extend(reversed(node))
    return None


#: Pages whose scripts are Python objects at a time.
PAGES_A_SLICE = 64


def _first_job(bodies) -> str | None:
    """First ``JobPosting`` object among a page's scripts, at any depth, as JSON text."""
    for body in bodies or ():
        try:
            found = _deep_find(json.loads(body), "JobPosting")
        except ValueError:
            continue
        if found is not None:
            return json.dumps(found, ensure_ascii=False)
    return None


def _first_jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``url, job`` of ``url, scripts``, slice by slice: besides the batch itself a worker holds a slice's objects only."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_A_SLICE):
            part = batch.slice(at, PAGES_A_SLICE)
            jobs = pa.array([_first_job(scripts) for scripts in part.column("scripts").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("url").cast(pa.string()), jobs], ["url", "job"])


def _field(job: Column, path: str) -> Column:
    return F.get_json_object(job, f"$.{path}")


def _is_object(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).startswith("{")


def _flatten_json(text: Column) -> Column:
    """Comma text of a JSON value: preferred address keys, else every filled value."""
    preferred = F.array(*[F.get_json_object(text, f"$.{k}") for k in ("addressLocality", "addressRegion", "name", "value")])
    named = F.array_join(F.filter(F.array_compact(preferred), lambda v: v != ""), ", ")
    values = F.map_values(F.from_json(text, "map<string,string>"))
    every = F.array_join(F.filter(F.array_compact(values), lambda v: v != ""), ", ")
    return F.when(_is_object(text), F.when(named != "", named).otherwise(every)).otherwise(F.coalesce(text, F.lit("")))


def _items(text: Column) -> Column:
    """JSON value as an array of JSON texts; a single value is a one-element array."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text)).otherwise(
        F.array().cast("array<string>")
    )


def _locations(text: Column) -> Column:
    def one(item: Column) -> Column:
        return _flatten_json(F.when(_is_object(item), F.coalesce(F.get_json_object(item, "$.address"), item)).otherwise(item))

    return F.array_join(F.filter(F.transform(_items(text), one), lambda t: t != ""), ", ")


def _base_salary(job: Column) -> Column:
    value = _field(job, "baseSalary.value")
    nested = _is_object(value)
    return salary_text(
        _field(job, "baseSalary.value.minValue"), _field(job, "baseSalary.value.maxValue"),
        F.when(nested, _field(job, "baseSalary.value.value")).otherwise(value),
        _field(job, "baseSalary.currency"), F.when(nested, _field(job, "baseSalary.value.unitText")),
    )


def jsonld_postings(pages: DataFrame, source: str, as_of: Column, crawled_at: Column) -> DataFrame:
    """Raw postings from ``url, html`` pages with an embedded, unexpired job description.

    Pages without such a script are dropped by a plain substring test before any parsing.
    """
    hinted = pages.where(F.col("html").contains("JobPosting") & F.lower("html").contains("ld+json"))
    scripts = hinted.select("url", F.regexp_extract_all("html", F.lit(LD_JSON), F.lit(1)).alias("scripts"))
    found = scripts.mapInArrow(_first_jobs, "url string, job string")
    job = F.col("job")
    live = found.where(job.isNotNull() & ~is_expired(_field(job, "validThrough"), as_of))
    months = _field(job, "experienceRequirements.monthsOfExperience")
    wanted = _field(job, "experienceRequirements")
    org = F.coalesce(_field(job, "hiringOrganization.name"), _field(job, "hiringOrganization"))
    skills = _field(job, "skills")
    return live.select(
        stable_job_id(F.lit(source), F.col("url")).alias("id"), F.lit(source).alias("source"),
        canonical_url(F.col("url")).alias("url"),
        F.trim(F.coalesce(_field(job, "title"), F.lit(""))).alias("title"),
        _flatten_json(org).alias("company"), _locations(_field(job, "jobLocation")).alias("region_raw"),
        F.when(_is_object(_field(job, "baseSalary")), _base_salary(job)).otherwise(NEGOTIABLE).alias("salary_raw"),
        F.when(months.isNotNull(), F.concat(months, F.lit(" tháng")))
        .otherwise(F.when(F.coalesce(wanted, F.lit("")) == "", UNKNOWN_EXPERIENCE).otherwise(_flatten_json(wanted)))
        .alias("experience_raw"),
        F.coalesce(F.nullif(_field(job, "datePosted"), F.lit("")), F.lit(RECENT)).alias("posted_date_raw"),
        clean_html(_field(job, "description")).alias("description"),
        F.when(F.coalesce(skills, F.lit("")).startswith("["), F.array_distinct(F.filter(_items(skills), lambda s: s != "")))
        .otherwise(split_skills(skills)).alias("skills"),
        crawled_at.cast("string").alias("crawled_at"),
    )


def payload_segments(html: Column) -> Column:
    """Framework payload of a page as ``array<struct<key, body>>`` in page order."""
    chunks = F.transform(
        F.regexp_extract_all(html, F.lit(PUSHED), F.lit(1)),
        lambda c: F.get(F.from_json(c, "array<string>"), F.lit(1)),
    )
    payload = F.array_join(F.array_compact(chunks), "")
    keys = F.regexp_extract_all(payload, F.lit(SEGMENT_KEY), F.lit(1))
    pieces = F.split(payload, SEGMENT_KEY, -1)
    bodies = F.slice(pieces, F.lit(2), F.size(pieces))
    return F.zip_with(keys, bodies, lambda k, b: F.struct(k.alias("key"), F.trim(b).alias("body")))


def _after_tag(body: Column) -> Column:
    """Segment content: JSON as it is, otherwise what follows the first comma."""
    is_json = body.rlike(r'^[\[{"]')
    rest = F.when(F.locate(",", body) > 0, F.regexp_replace(body, r"(?s)^[^,]*,", "")).otherwise(body)
    content = F.when(is_json, body).otherwise(rest)
    quoted = F.get(F.from_json(F.concat(F.lit("["), content, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(content.startswith('"'), F.coalesce(quoted, content)).otherwise(content)


def _resolve(segments: Column, value: Column) -> Column:
    """Follow a ``$hex`` reference one level; the last segment of a key wins."""
    ref = F.regexp_extract(value, r"^\$([0-9a-f]+)$", 1)
    body = F.try_element_at(F.filter(segments, lambda s: s.key == ref), F.lit(-1)).body
    return F.when(ref == "", value).otherwise(F.coalesce(_after_tag(body), F.lit("")))


def payload_postings(pages: DataFrame, source: str, as_of: Column, crawled_at: Column) -> DataFrame:
    """Raw postings from pages that carry a framework payload with a job object."""
    hinted = pages.where(F.col("html").contains("self.__next_f.push("))
    parsed = hinted.select("url", payload_segments(F.col("html")).alias("seg"))
    seg = F.col("seg")
    jobs = F.filter(
        F.transform(
            F.filter(seg, lambda s: s.body.contains('"jobId"') & s.body.contains('"jobTitle"')), lambda s: _after_tag(s.body)
        ),
        lambda j: F.coalesce(F.get_json_object(j, "$.jobId"), F.lit("")).isin("", "0", "false") == F.lit(False),
    )
    found = parsed.withColumn("job", F.get(jobs, F.lit(0)))
    job = F.col("job")
    live = found.where(
        job.isNotNull() & (F.coalesce(_field(job, "isActive"), F.lit("true")) != "false") & ~is_expired(_field(job, "expiredOn"), as_of)
    )
    low, high = _field(job, "salaryMin"), _field(job, "salaryMax")
    currency = F.coalesce(F.nullif(_field(job, "salaryCurrency"), F.lit("")), F.lit("USD"))
    visible = _field(job, "isSalaryVisible") == "true"
    salary = (
        F.when(visible & low.isNotNull() & high.isNotNull(), F.concat(low, F.lit(" - "), high, F.lit(" "), currency))
        .when(visible & low.isNotNull(), F.concat(F.lit("Từ "), low, F.lit(" "), currency))
        .when(visible & high.isNotNull(), F.concat(F.lit("Đến "), high, F.lit(" "), currency))
        .otherwise(NEGOTIABLE)
    )

    def resolved(name: str) -> Column:
        return _resolve(seg, _field(job, name))

    skills = F.transform(
        _items(resolved("skills")),
        lambda s: F.when(_is_object(s), F.coalesce(F.get_json_object(s, "$.skillName"), F.get_json_object(s, "$.name"))).otherwise(s),
    )
    places = F.coalesce(F.nullif(resolved("locations"), F.lit("")), resolved("workingLocations"))
    text = F.array_join(F.filter(F.array(clean_html(resolved("jobDescription")), clean_html(resolved("jobRequirement"))), lambda t: t != ""), " ")
    return live.select(
        stable_job_id(F.lit(source), F.col("url")).alias("id"), F.lit(source).alias("source"),
        canonical_url(F.col("url")).alias("url"),
        F.trim(F.coalesce(_field(job, "jobTitle"), F.lit(""))).alias("title"),
        F.trim(F.coalesce(_field(job, "companyName"), F.lit(""))).alias("company"),
        F.array_join(F.filter(F.transform(_items(places), _flatten_json), lambda t: t != ""), ", ").alias("region_raw"),
        salary.alias("salary_raw"),
        F.coalesce(_field(job, "jobLevelVI"), _field(job, "jobLevel"), F.lit(UNKNOWN_EXPERIENCE)).alias("experience_raw"),
        F.coalesce(_field(job, "approvedOn"), _field(job, "approvedOnText"), F.lit(RECENT)).alias("posted_date_raw"),
        text.alias("description"), F.array_distinct(F.array_compact(skills)).alias("skills"),
        crawled_at.cast("string").alias("crawled_at"),
    )


def sitemap_urls(sitemaps: DataFrame, condition, limit: int | None = None, seed: int | None = None) -> DataFrame:
    """``url, pos`` of ``seq, xml`` sitemaps: filtered, distinct, in listing or seeded order, optionally limited.

    ``condition`` maps the URL column to a predicate.
    """
    listed = sitemaps.select(
        "seq", F.posexplode(F.xpath("xml", F.lit("//*[local-name()='loc']/text()"))).alias("i", "raw")
    ).select("seq", "i", F.trim("raw").alias("url")).where((F.col("url") != "") & condition(F.col("url")))
    first = listed.groupBy("url").agg(F.min(F.struct("seq", "i")).alias("pos"))
    ordered = first.orderBy(F.col("pos") if seed is None else seeded_order(F.col("url"), seed))
    return ordered if limit is None else ordered.limit(limit)


def resume_offset(inventory: DataFrame, ingested: DataFrame) -> int:
    """Position after the furthest already ingested URL of ``url, pos``; a single scalar."""
    known = ingested.select(canonical_url(F.col("url")).alias("c")).distinct()
    hit = inventory.select(canonical_url(F.col("url")).alias("c"), "pos").join(known, "c", "left_semi")
    last = hit.agg(F.max("pos").alias("m")).first()["m"]
    return 0 if last is None else int(last) + 1


def remaining_urls(inventory: DataFrame, ingested: DataFrame, source: str) -> DataFrame:
    """URLs after the resume offset whose id is not ingested yet."""
    rest = inventory.where(F.col("pos") >= resume_offset(inventory, ingested))
    return rest.withColumn("id", stable_job_id(F.lit(source), F.col("url"))).join(ingested.select("id"), "id", "left_anti")
