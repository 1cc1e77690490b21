"""Scalar functions over whole tables: text forms, parsers, URLs, redaction, grounding, turn flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobatlas.catalog.base import postings, query, table, with_ctes
from jobatlas.functions import grounding, hashing, parsing, privacy, text, turns
from jobatlas.operators import guidance, links, matching, reports
from jobatlas.operators.packs import meet, pack
from jobatlas.plans import normalize

SP = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'))"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def has_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def documents(spark, sf):
    return table(spark, sf, "documents")


def pages(spark, sf):
    return table(spark, sf, "pages")


@query(f"""SELECT doc_id, md5({squeeze_sql("replace(lower(nfc_normalize(text)), 'ß', 'ss')")}) AS norm_match,
    md5(nfc_normalize({strip_sql('lower(text)')})) AS norm_region, md5(lower({squeeze_sql('text')})) AS norm_label,
    md5(strip_accents(replace(lower(text), 'đ', 'd'))) AS fold, md5(strip_accents(lower(text))) AS fold_nodj FROM documents""")
def text_normal_forms(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select(
        "doc_id", F.md5(text.norm_match(t)).alias("norm_match"), F.md5(text.norm_region(t)).alias("norm_region"),
        F.md5(text.norm_label(t)).alias("norm_label"), F.md5(text.fold(t)).alias("fold"), F.md5(text.fold_nodj(t)).alias("fold_nodj"),
    )


@query("""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM (
    SELECT doc_id, regexp_extract_all(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]+', '', 'g')), '[a-z0-9]+') AS t FROM documents)""")
def ascii_blocking_tokens(spark, sf):
    tokens = text.ascii_tokens(F.col("text"))
    return documents(spark, sf).select(
        "doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens"))


STRIPPED = "html"
for _pattern in ("(?is)<!--.*?-->", "(?is)<script\\b.*?</script\\s*>", "(?is)<style\\b.*?</style\\s*>", "(?is)<template\\b.*?</template\\s*>", "<[^>]+>"):
    STRIPPED = f"regexp_replace({STRIPPED}, '{_pattern}', ' ', 'g')"
# The references that the given pages hold, each as it reads; the ampersand last.
REFERENCES = (("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&amp;?", "&"))
for _entity, _char in REFERENCES:
    STRIPPED = f"regexp_replace({STRIPPED}, '{_entity}', '{_char}', 'g')"
CLEAN = squeeze_sql(f"'Kỹ sư à á ế < ' || {STRIPPED}")


@query(f"SELECT page_id, md5({CLEAN}) AS body, left({CLEAN}, 180) AS head FROM pages")
def html_to_text(spark, sf):
    """Pages with named, decimal and hexadecimal references put before them."""
    body = F.concat(F.lit("<b>K&#7929;</b> s&#432; &agrave; &aacute; &#x1EBF; &lt; "), "html")
    return pages(spark, sf).select(
        "page_id", F.md5(parsing.clean_html(body)).alias("body"), parsing.clean_text(body, 180).alias("head"))


HOST = "regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^[^@]*@', '')), ':[0-9]*$', ''), '[.]+$', '')"


@query(f"""SELECT page_id, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS canonical,
    'web_' || left(sha256(split_part(lower(url), '#', 1)), 16) AS job_id, {HOST} AS host,
    regexp_matches({HOST}, '^[^ ]+$') AND NOT regexp_matches({HOST}, '[.]local$') AND {HOST} <> 'localhost' AS safe,
    CASE WHEN {HOST} LIKE '%.org' THEN 'education' WHEN {HOST} LIKE '%.net' THEN 'official' WHEN {HOST} = 'example.com' OR {HOST} LIKE '%.example.com' THEN 'job_board' ELSE 'other' END AS tier
    FROM pages""")
def url_functions(spark, sf):
    url = F.col("url")
    host = privacy.url_host(url)
    return pages(spark, sf).select(
        "page_id", parsing.canonical_url(url).alias("canonical"), parsing.stable_job_id(F.lit("web"), url).alias("job_id"),
        host.alias("host"), privacy.is_safe_url(url).alias("safe"),
        privacy.source_tier(host, (".org",), (".net",), ("example.com",)).alias("tier"))


REDACTED = "text"
for _pattern, _mark in (
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", privacy.EMAIL_MARK),
    (r"(^|[^0-9])(?:\+?84|0)(?:[\s.\-]?\d){8,10}($|[^0-9])", r"\1" + privacy.PHONE_MARK + r"\2"),
    (r"(?i)\bsk-[A-Z0-9_-]{8,}\b", privacy.SECRET_MARK),
):
    REDACTED = f"regexp_replace({REDACTED}, '{_pattern}', '{_mark}', 'g')"
REDACTED = squeeze_sql(
    f"regexp_replace(regexp_replace({REDACTED}, '(?i)\\bGPA\\s*[:=]?\\s*\\d+(?:[.,]\\d+)?(?:\\s*/\\s*\\d+(?:[.,]\\d+)?)?', ' ', 'g'), '(?i)\\b(?:GPA|NEU|FTU|RMIT)\\b', ' ', 'g')")


@query(f"""SELECT doc_id, md5({REDACTED}) AS redacted, {has_any('lower(text)', privacy.INJECTION)} AS injection,
    contains({REDACTED}, '{privacy.EMAIL_MARK}') AS has_email FROM documents""")
def redacted_documents(spark, sf):
    t = F.col("text")
    clean = privacy.redact(t)
    return documents(spark, sf).select(
        "doc_id", F.md5(clean).alias("redacted"), privacy.looks_like_injection(t).alias("injection"),
        clean.contains(privacy.EMAIL_MARK).alias("has_email"))


@query(f"""SELECT doc_id, 'lang,text' AS keys, md5({REDACTED}) AS body, lang FROM documents""")
def redacted_nested_values(spark, sf):
    args = F.create_map(F.lit("name"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("text"), F.col("text"))
    out = privacy.redact_map(args)
    return documents(spark, sf).select(
        "doc_id", F.array_join(F.array_sort(F.map_keys(out)), ",").alias("keys"), F.md5(out["text"]).alias("body"), out["lang"].alias("lang"))


SCRUBBED = "text"
for _ in range(2):
    SCRUBBED = f"regexp_replace({SCRUBBED}, '(?i)(^|[^\\pL\\pN\\pM_])(?:nam|GPA|NEU|FTU|RMIT)($|[^\\pL\\pN\\pM_])', '\\1 \\2', 'g')"


@query(f"SELECT doc_id, md5({squeeze_sql(SCRUBBED)}) AS scrubbed FROM documents")
def scrubbed_scoring_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(privacy.scrub_scoring_text(F.col("text"))).alias("scrubbed"))


@query("""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_numbers, md5(array_to_string(t, ' ')) AS numbers,
    len(list_filter(t, lambda x: NOT (x = CAST(n_chars AS VARCHAR) OR replace(x, ',', '.') = n_chars || '.0' OR replace(x, ',', '.') = CAST(n_chars AS VARCHAR)))) = 0 AS grounded FROM (
    SELECT doc_id, n_chars, regexp_extract_all(text, '(^|[^A-Za-z_])([0-9]+(?:[.,][0-9]+)?)', 2) AS t FROM documents)""")
def number_grounding(spark, sf):
    tokens = grounding.number_tokens(F.col("text"))
    allowed = F.concat(grounding.int_spelling(F.col("n_chars")), grounding.double_spellings(F.col("n_chars")))
    return documents(spark, sf).select(
        "doc_id", F.size(tokens).cast("long").alias("n_numbers"), F.md5(F.array_join(tokens, " ")).alias("numbers"),
        grounding.numbers_grounded(F.col("text"), allowed).alias("grounded"))


@query(f"""SELECT d.doc_id, bool_or(contains(lower(trim(d.text)), lower(trim(b.text))) OR contains(lower(trim(b.text)), lower(trim(d.text)))) AS belongs
    FROM documents d, benchmark b GROUP BY d.doc_id""")
def quote_membership(spark, sf):
    quotes = table(spark, sf, "benchmark").where(F.col("text").isNotNull()).select(grounding.quote_item(F.col("text")).alias("q")).distinct()
    packs, n = pack(quotes, F.col("q"))
    tested = meet(documents(spark, sf).select("doc_id", "text"), packs, n)
    return tested.groupBy("doc_id").agg(F.max(grounding.quotes_hold(F.col("text"), F.col("items"))).alias("belongs"))


@query(f"""SELECT doc_id, {"CASE " + " ".join(f"WHEN {has_any('lower(text)', words)} THEN '{fam}'" for fam, words in parsing.JOB_FAMILIES.items())} ELSE 'Others' END AS family FROM documents""")
def job_family_of_text(spark, sf):
    return documents(spark, sf).select("doc_id", parsing.job_family(F.col("text")).alias("family"))


@query("""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_parts, md5(array_to_string(t, '|')) AS parts FROM (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS t FROM (
    SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[,;|]'), lambda x: STRIP), lambda x: x <> '') AS l FROM documents))""".replace("STRIP", strip_sql("x")))
def delimited_labels(spark, sf):
    parts = parsing.split_skills(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(parts).cast("long").alias("n_parts"), F.md5(F.array_join(parts, "|")).alias("parts"))


@query("""SELECT DISTINCT p_partkey, array_to_string(list_sort(string_split(p_name, ' '))[1:4], ' ') AS title_anchors, 'brand ' || lower(replace(p_brand, 'Brand#', '')) AS company_anchor FROM part""")
def blocking_anchors(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(parsing.title_anchors(F.col("p_name")), " ").alias("title_anchors"),
        parsing.company_anchor(F.concat(F.col("p_brand"), F.lit(" Co Ltd"))).alias("company_anchor"))


@query("SELECT o_orderkey, CAST(floor((date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1) / 30) AS INT) AS bucket FROM orders")
def thirty_day_bucket(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", parsing.date_bucket(F.to_date("o_orderdate")).alias("bucket"))


@query("""SELECT p_partkey, 'sha256:' || sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_type":"' || p_type || '"}') AS content_hash,
    left(sha256(CAST(p_partkey AS VARCHAR)), 16) AS session_key, sha256('sha256:' || sha256('{"id":"' || p_partkey || '","title":"' || p_name || '","description":"' || p_brand || '"}') || '|tax|v1') AS cache_key FROM part""")
def content_hashes(spark, sf):
    key = F.col("p_partkey").cast("string")
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return parts.select(
        "p_partkey", hashing.row_hash(parts).alias("content_hash"), hashing.session_key(key).alias("session_key"),
        hashing.extraction_cache_key(hashing.posting_input_hash(key, F.col("p_name"), F.col("p_brand")), "tax", "v1").alias("cache_key"))


@query()
def table_fingerprint(spark, sf):
    return hashing.table_fingerprint(postings(spark, sf))


# ---------------------------------------------------------------- raw postings derived from orders

RAW = """SELECT CAST(o_orderkey AS VARCHAR) AS id, c_mktsegment AS source, 'http://jobs.example.com/' || o_orderkey AS url, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice,
    floor(o_totalprice / 10000) AS million, CAST(o_orderdate AS DATE) AS crawled, r_name FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
REGION_NAMES = {"AFRICA": "Hà Nội", "AMERICA": "TP. HCM", "ASIA": "Đà Nẵng", "EUROPE": "Quận 1, Sài Gòn", "MIDDLE EAST": "Cần Thơ"}


def raw_postings(spark, sf):
    """Raw posting texts written from the order columns, so that every parser branch is met."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    nations, regions = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    m = F.floor(F.col("o_totalprice") / 10000).cast("string")
    price, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    salary = (
        F.when(price == "1-URGENT", F.concat(F.lit("Đến "), m, F.lit(" triệu")))
        .when(price == "2-HIGH", F.concat(F.lit("Từ "), m, F.lit(",5 triệu")))
        .when(price == "3-MEDIUM", F.concat(m, F.lit(" - "), m, F.lit(".500.000 VND")))
        .when(price == "4-NOT SPECIFIED", F.concat(F.lit("$"), m, F.lit("00 - "), m, F.lit("50")))
        .otherwise("Thỏa thuận")
    )
    experience = F.when(status == "F", F.concat(F.substring(m, 1, 1), F.lit(" năm kinh nghiệm"))).when(status == "O", "Không yêu cầu").otherwise("Theo thỏa thuận")
    title = F.when(price == "1-URGENT", "Senior Analyst").when(price == "2-HIGH", "Thực tập sinh").when(price == "3-MEDIUM", "Junior Dev").otherwise("Nhân viên bán hàng")
    crawled = F.date_format("o_orderdate", "yyyy-MM-dd")
    posted = (
        F.when(price == "1-URGENT", F.concat(m, F.lit(" ngày trước"))).when(price == "2-HIGH", F.concat(F.lit("Hạn nộp "), crawled))
        .when(price == "3-MEDIUM", F.date_format("o_orderdate", "dd/MM/yyyy")).when(price == "4-NOT SPECIFIED", "31/02/1999").otherwise("2031-01-01")
    )
    region = F.create_map(*[F.lit(x) for kv in REGION_NAMES.items() for x in kv])[F.col("r_name")]
    description = F.when(status == "P", F.repeat(F.lit("mô tả "), 10)).otherwise(F.repeat(F.lit("mô tả công việc "), 20))
    return rows.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("c_mktsegment").alias("source"),
        F.concat(F.lit("http://jobs.example.com/"), F.col("o_orderkey")).alias("url"), title.alias("title"), F.col("c_name").alias("company"),
        region.alias("region_raw"), F.when(price.isin("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED") | (status != "O"), salary).alias("salary_raw"),
        experience.alias("experience_raw"), posted.alias("posted_date_raw"), description.alias("description"),
        F.array().cast("array<string>").alias("skills"), F.concat(crawled, F.lit("T23:30:00+07:00")).alias("crawled_at"),
        # Some low-priority records lack the salary key; others have it with a null value, which is no fault.
        F.when((price == "5-LOW") & (F.col("o_orderkey") % 11 == 0), F.array(F.lit("salary_raw"))).alias("missing_keys"),
    )


NORM = """SELECT id, source, CASE r_name WHEN 'AFRICA' THEN 'hanoi' WHEN 'AMERICA' THEN 'hcm' WHEN 'ASIA' THEN 'danang' WHEN 'EUROPE' THEN 'hcm' ELSE 'other' END AS region,
    CASE o_orderpriority WHEN '2-HIGH' THEN million + 0.5 WHEN '3-MEDIUM' THEN million
      WHEN '4-NOT SPECIFIED' THEN CAST(format('{:.1f}', (CASE WHEN million * 100 >= 100000 THEN million * 100 / 1e6 ELSE million * 100 END) * 25500 / 1e6) AS DOUBLE) END AS salary_min_trieu,
    CASE o_orderpriority WHEN '1-URGENT' THEN million WHEN '3-MEDIUM' THEN (CASE WHEN million = 0 THEN 500000 ELSE million * 1000000 + 500000 END) / 1e6
      WHEN '4-NOT SPECIFIED' THEN CAST(format('{:.1f}', CAST(CAST(CAST(million AS INT) AS VARCHAR) || '50' AS DOUBLE) * 25500 / 1e6) AS DOUBLE) END AS salary_max_trieu,
    CASE o_orderstatus WHEN 'F' THEN CAST(left(CAST(CAST(million AS INT) AS VARCHAR), 1) AS INT) WHEN 'O' THEN 0 END AS experience_min_years,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'senior' WHEN '2-HIGH' THEN 'entry' WHEN '3-MEDIUM' THEN 'mid' ELSE
      CASE o_orderstatus WHEN 'O' THEN 'entry' WHEN 'F' THEN CASE WHEN left(CAST(CAST(million AS INT) AS VARCHAR), 1) = '0' THEN 'entry' WHEN CAST(left(CAST(CAST(million AS INT) AS VARCHAR), 1) AS INT) >= 3 THEN 'senior' ELSE 'mid' END ELSE 'unknown' END END AS seniority,
    CAST(CASE o_orderpriority WHEN '1-URGENT' THEN crawled - CAST(million AS INT) ELSE crawled END AS VARCHAR) AS posted_date,
    CASE WHEN o_orderpriority = '5-LOW' AND CAST(id AS BIGINT) % 11 = 0 THEN 'invalid' WHEN o_orderstatus = 'P' THEN 'short' END AS reject_reason FROM raw"""


@query(with_ctes("SELECT * FROM norm", raw=RAW, norm=NORM))
def normalized_postings(spark, sf):
    tagged = normalize.tag_normalized(raw_postings(spark, sf), F.lit("2001-01-01"))
    return tagged.select(
        "id", "source", "region", "salary_min_trieu", "salary_max_trieu", "experience_min_years", "seniority",
        F.col("posted_date").cast("string").alias("posted_date"), "reject_reason")


@query(with_ctes("""SELECT count(*) AS total_loaded, count(*) FILTER (WHERE reject_reason = 'invalid') AS dropped_invalid, count(*) FILTER (WHERE reject_reason = 'short') AS dropped_short,
    count(*) FILTER (WHERE reject_reason IS NULL) AS kept, count(*) FILTER (WHERE reject_reason IS NULL AND (salary_min_trieu IS NOT NULL OR salary_max_trieu IS NOT NULL)) AS with_salary,
    count(*) FILTER (WHERE reject_reason IS NULL AND experience_min_years IS NOT NULL) AS with_experience,
    round(count(*) FILTER (WHERE reject_reason IS NULL AND (salary_min_trieu IS NOT NULL OR salary_max_trieu IS NOT NULL)) * 100 / CAST(count(*) FILTER (WHERE reject_reason IS NULL) AS DOUBLE), 1) AS salary_pct FROM norm""",
                 raw=RAW, norm=NORM))
def normalization_report(spark, sf):
    return reports.normalization_report(normalize.tag_normalized(raw_postings(spark, sf), F.lit("2001-01-01")))


@query(with_ctes("""SELECT f.field, f.value, f.n, round(f.n / CAST(t.n AS DOUBLE) * 100, 1) AS pct FROM (SELECT 'region' AS field, region AS value, count(*) AS n FROM norm WHERE reject_reason IS NULL GROUP BY ALL
    UNION ALL SELECT 'seniority', seniority, count(*) FROM norm WHERE reject_reason IS NULL GROUP BY ALL) f, (SELECT count(*) AS n FROM norm WHERE reject_reason IS NULL) t""", raw=RAW, norm=NORM))
def normalized_distributions(spark, sf):
    kept = normalize.normalize(raw_postings(spark, sf), F.lit("2001-01-01"), dedupe=False)
    return reports.distribution(kept, "region").unionByName(reports.distribution(kept, "seniority"))


@query(with_ctes("""SELECT source, 'all' AS scope, count(*) AS n FROM norm WHERE reject_reason IS NULL GROUP BY source""", raw=RAW, norm=NORM))
def kept_by_source(spark, sf):
    kept = normalize.normalize(raw_postings(spark, sf), F.lit("2001-01-01"), dedupe=False)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit("all"))


@query("""SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-01-01' AS expired FROM orders""")
def expired_postings(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", parsing.is_expired(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1998-01-01")).alias("expired"))


SALARY_TEXT = """CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) || ' - ' || o_custkey || ' VND MONTH' WHEN o_orderstatus = 'O' THEN 'Từ ' || o_orderkey || ' VND MONTH' ELSE 'Thỏa thuận' END"""


@query(f"SELECT o_orderkey, {SALARY_TEXT} AS salary_text FROM orders")
def structured_salary_text(spark, sf):
    status = F.col("o_orderstatus")
    low = F.when(status.isin("F", "O"), F.col("o_orderkey").cast("string"))
    high = F.when(status == "F", F.col("o_custkey").cast("string")).otherwise("negotiable")
    return table(spark, sf, "orders").select(
        "o_orderkey", parsing.salary_text(low, high, F.lit(None).cast("string"), F.lit("VND"), F.lit("MONTH")).alias("salary_text"))


# ---------------------------------------------------------------- conversation flags

WORD = r"[\pL\pN_]"
KEYS = ("the", "dans", "ungen", "être")


@query(f"""SELECT conv_id, turn, {has_any('lower(text)', turns.DECLINES)} AS declines, {has_any("strip_accents(replace(lower(text), 'đ', 'd'))", turns.WANTS_RESULTS)} AS wants_results,
    {has_any('lower(text)', turns.WANTS_DONE)} AS wants_done,
    regexp_matches(lower(text), '(^|[^\\pL\\pN_])(the|dans|ungen|être)($|[^\\pL\\pN_])') OR (strip_accents(lower(text)) = lower(text) AND NOT contains(lower(text), 'đ')
      AND regexp_matches(lower(text), '(^|[^\\pL\\pN_])(the|dans|ungen|etre)($|[^\\pL\\pN_])')) AS has_keyword FROM conversations""")
def turn_intents(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", turns.declines_constraint(t).alias("declines"), turns.wants_results(t).alias("wants_results"),
        turns.wants_done(t).alias("wants_done"), text.contains_keywords(t, KEYS).alias("has_keyword"))


CONTENT_STOP = "'" + "','".join(sorted({text.py_fold(w) for w in turns.INTEREST_STOPWORDS})) + "'"


@query(f"""SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words FROM (SELECT conv_id, turn,
    list_filter(regexp_extract_all(strip_accents(replace(lower(text), 'đ', 'd')), '[a-z]+'), lambda x: len(x) >= 2 AND x NOT IN ({CONTENT_STOP})) AS w FROM conversations)""")
def content_words_of_turns(spark, sf):
    words = turns.content_words(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(words).cast("long").alias("n_words"), F.md5(F.array_join(words, " ")).alias("words"))


@query(f"""SELECT conv_id, turn, CAST(len(d) AS BIGINT) AS n, md5(array_to_string(d, ' ')) AS words FROM (SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(l, lower(x)) = i) AS d
    FROM (SELECT conv_id, turn, w, list_transform(w, lambda x: lower(x)) AS l FROM (SELECT conv_id, turn, regexp_extract_all(text, '{WORD}+') AS w FROM conversations)))""")
def ordered_distinct_words(spark, sf):
    kept = guidance.distinct_by_label(text.word_tokens(F.col("text")), lambda w: F.lower(w))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(kept).cast("long").alias("n"), F.md5(F.array_join(kept, " ")).alias("words"))


@query("""SELECT a.p_name AS label_a, b.p_type AS label_b, lower(a.p_name) = lower(b.p_type) OR contains(lower(a.p_name), lower(b.p_type)) OR contains(lower(b.p_type), lower(a.p_name)) AS matches
    FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS p_type FROM part) b""")
def soft_label_match(spark, sf):
    part = table(spark, sf, "part")
    words = part.select(F.upper(F.split("p_name", " ")[0]).alias("label_b"))
    return matching.judged_label_pairs(part.select(F.col("p_name").alias("label_a")), words, "label_a", "label_b")


TITLE = squeeze_sql("regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')")
for _entity, _char in REFERENCES:
    TITLE = f"regexp_replace({TITLE}, '{_entity}', '{_char}', 'g')"


@query(with_ctes(f"""SELECT subject, card, url, domain, title, CASE WHEN domain LIKE '%.edu.vn' THEN 'education' WHEN domain LIKE '%.gov.vn' THEN 'official' ELSE 'other' END AS source_tier FROM (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY page_id, url) AS card FROM u WHERE rn = 1) WHERE card <= 5""",
    u0=f"SELECT page_id, url, {HOST} AS domain, regexp_extract(url, '^https?://[^/?#]*/([a-z]+)', 1) AS subject, left({squeeze_sql(TITLE)}, 180) AS title FROM pages",
    u="SELECT *, row_number() OVER (PARTITION BY subject, url ORDER BY page_id) AS rn FROM u0 WHERE domain <> '' AND title <> ''"))
def link_cards(spark, sf):
    rows = pages(spark, sf).select(
        F.regexp_extract("url", r"^https?://[^/?#]*/([a-z]+)", 1).alias("subject"), F.col("page_id").alias("position"), "url",
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.lit("").alias("snippet"))
    return links.link_cards(rows, "subject").select("subject", F.col("card").cast("long").alias("card"), "url", "domain", "title", "source_tier")


@query(f"""SELECT page_id, len(list_filter(string_split_regex(replace(strip_accents(lower(regexp_extract(url, '^https?://([^/?#]*)', 1))), '-', ' '), '[ .]+'),
    lambda x: len(x) >= 3 AND contains(strip_accents(lower(html)), x))) > 0 AS relevant FROM pages""")
def title_relevance(spark, sf):
    host = F.regexp_replace(F.regexp_extract("url", r"^https?://([^/?#]*)", 1), r"\.", " ")
    return pages(spark, sf).select("page_id", links.is_relevant(host, F.col("html"), F.lit("")).alias("relevant"))
