"""Matching, reuse, dedupe, sampling, evaluation, reports and audits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jobatlas.catalog.base import order_lines, postings, query, table, with_ctes
from jobatlas.catalog.text_queries import NORM, RAW, raw_postings
from jobatlas.functions.text import norm_match, word_tokens
from jobatlas.operators import dedupe, evaluation, incremental, market, matching, quality, reports, sampling
from jobatlas.plans import normalize
from jobatlas.session import cut_lineage

# ---------------------------------------------------------------- skills in documents


def benchmark_taxonomy(spark, sf):
    """Skills are all words of the benchmark texts and all pairs of neighbouring ones, in alphabetical order."""
    words = table(spark, sf, "benchmark").select(word_tokens(norm_match(F.col("text"))).alias("w"))
    single = words.select(F.explode("w").alias("name"))
    pairs = words.where(F.size("w") > 1).select(F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> concat_ws(' ', w[i - 1], w[i]))")).alias("name"))
    names = single.union(pairs).distinct().orderBy("name")
    return names.select("name", F.array().cast("array<string>").alias("aliases"), F.monotonically_increasing_id().alias("taxonomy_order"))


def normalized_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", norm_match(F.col("text")).alias("text"))


NORM_DOC = r"trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g'))"
WORDS = r"'[\pL\pN\pM_]+'"
PIECES = r"'[\pL\pN\pM_]+|[^\pL\pN\pM_]+'"
BENCH = {
    "bw": f"SELECT item_id, regexp_extract_all({NORM_DOC}, {WORDS}) AS w FROM benchmark",
    "bench": """SELECT DISTINCT name FROM (SELECT unnest(w) AS name FROM bw
        UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM bw)""",
    "nd": f"SELECT doc_id, {NORM_DOC} AS text FROM documents",
    "pc": f"SELECT doc_id, unnest(regexp_extract_all(text, {PIECES})) AS p, generate_subscripts(regexp_extract_all(text, {PIECES}), 1) AS i FROM nd",
    "tk": """SELECT doc_id, i, p, sum(length(p)) OVER w - length(p) AS start, lead(p) OVER w AS gap, lead(p, 2) OVER w AS later FROM pc WINDOW w AS (PARTITION BY doc_id ORDER BY i)""",
    "cand": """SELECT doc_id, start, p AS name FROM tk WHERE EXISTS (FROM bench WHERE name = p)
        UNION ALL SELECT doc_id, start, p || ' ' || later FROM tk WHERE gap = ' ' AND EXISTS (FROM bench WHERE name = p || ' ' || later)""",
}


@query(with_ctes("SELECT DISTINCT doc_id, name AS skill FROM cand", **BENCH))
def dictionary_skill_presence(spark, sf):
    return matching.find_skills(normalized_documents(spark, sf), matching.alias_table(benchmark_taxonomy(spark, sf)), "doc_id").select("doc_id", "skill")


@query("WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in BENCH.items()) + r""",
    runs AS (SELECT *, start - (length(name) + 1) // 2 * row_number() OVER (PARTITION BY doc_id, name ORDER BY start) AS run FROM cand),
    spread AS (SELECT doc_id, start, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name, run ORDER BY start) AS k FROM runs)
        WHERE k % 2 = 1 OR NOT contains(name, ' ') OR split_part(name, ' ', 1) <> split_part(name, ' ', 2)),
    free AS (SELECT c.*, start + length(name) AS stop FROM spread c JOIN nd USING (doc_id)
        WHERE NOT regexp_matches(substr(text, greatest(start - 54, 1)::bigint, least(start, 55)::bigint), '((không|chưa)\s+(yêu cầu|bắt buộc|cần)(\s+(ứng viên|phải|biết|sử dụng|thành thạo)){0,4}\s*|(not|required no|without)\s+)$')
          AND NOT regexp_matches(substr(text, (start + length(name) + 1)::bigint, 35), '^\s*((là\s+)?(không|chưa)\s+(bắt buộc|cần thiết|yêu cầu)|(is\s+)?not\s+required)')),
    fresh AS (SELECT *, coalesce(start >= max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::int AS f FROM free),
    clusters AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY start, stop) AS k FROM fresh),
    step AS (SELECT doc_id, k, list({'r': start - stop, 'start': start, 'name': name, 'stop': stop} ORDER BY start - stop, start, name) AS rest, [] ::varchar[] AS kept FROM clusters GROUP BY doc_id, k
        UNION ALL SELECT doc_id, k, list_filter(rest, lambda x: x.start >= rest[1].stop OR x.stop <= rest[1].start), list_append(kept, rest[1].name) FROM step WHERE len(rest) > 0),
    got AS (SELECT DISTINCT doc_id, unnest(kept) AS name FROM step WHERE len(rest) = 0)
    SELECT doc_id, count(*) AS n_skills, md5(string_agg(name, '|' ORDER BY name)) AS skills FROM got GROUP BY doc_id""")
def dictionary_skill_tags(spark, sf):
    tagged = matching.tag_skills(normalized_documents(spark, sf), matching.alias_table(benchmark_taxonomy(spark, sf)), "doc_id")
    return tagged.select("doc_id", F.size("skills").cast("long").alias("n_skills"), F.md5(F.array_join("skills", "|")).alias("skills"))


# ---------------------------------------------------------------- titles to careers


def part_patterns(spark, sf):
    """Nouns, adjectives and some full names as title patterns, each owned by one career."""
    names = table(spark, sf, "part").groupBy("p_name").agg(F.max("p_size").alias("s"), F.count(F.lit(1)).alias("n"))
    two = F.split("p_name", " ")
    full = names.where((F.col("n") % 2) == 0).select(F.concat(F.lit("full "), F.col("p_name")).alias("career_id"), F.col("p_name").alias("pattern"))
    noun = names.select(F.concat(F.lit("noun "), two[1]).alias("career_id"), two[1].alias("pattern")).distinct()
    adjective = names.select(F.concat(F.lit("adj "), two[0]).alias("career_id"), two[0].alias("pattern")).distinct()
    return full.union(noun).union(adjective)


PATTERNS = {
    "nm": "SELECT p_name, count(*) AS n FROM part GROUP BY p_name",
    "pat": """SELECT 'full ' || p_name AS career_id, p_name AS pattern FROM nm WHERE n % 2 = 0 UNION SELECT 'noun ' || split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) FROM nm
        UNION SELECT 'adj ' || split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) FROM nm""",
    "hits": """SELECT title, career_id, pattern, rank() OVER (PARTITION BY title ORDER BY title = pattern DESC, len(string_split(pattern, ' ')) DESC, length(pattern) DESC) AS r
        FROM (SELECT DISTINCT title FROM po) JOIN pat ON contains(' ' || title || ' ', ' ' || pattern || ' ')""",
    "decided": """SELECT title, CASE WHEN count(DISTINCT career_id) > 1 THEN 'unmapped' ELSE min(career_id) END AS career_id,
        CASE WHEN count(DISTINCT career_id) > 1 THEN 'ambiguous_title_pattern' WHEN bool_or(title = pattern) THEN 'exact_title_pattern' ELSE 'contained_title_pattern' END AS reason,
        CASE WHEN count(DISTINCT career_id) = 1 THEN min(pattern) END AS matched_pattern FROM hits WHERE r = 1 GROUP BY title""",
    "mp": """SELECT po.id, po.source, po.region, po.title, coalesce(d.career_id, 'unmapped') AS career_id, coalesce(d.reason, 'no_title_pattern') AS reason, d.matched_pattern
        FROM po LEFT JOIN decided d ON d.title = po.title""",
}


def mapped(spark, sf):
    patterns = part_patterns(spark, sf).groupBy("career_id").agg(F.collect_list("pattern").alias("title_patterns"))
    rows = postings(spark, sf).select("id", "source", "region", "title")
    return matching.map_postings(rows, matching.pattern_table(patterns))


@query(with_ctes("SELECT id, career_id, reason, matched_pattern FROM mp", "po", **PATTERNS))
def career_title_mapping(spark, sf):
    return mapped(spark, sf).select("id", "career_id", "reason", "matched_pattern")


@query(with_ctes("""SELECT id, coalesce(f.career_id, 'unmapped') AS career_id, f.pattern AS matched_pattern FROM po LEFT JOIN (SELECT title, career_id, pattern, row_number() OVER (PARTITION BY title ORDER BY career_id, pattern) AS k
    FROM (SELECT DISTINCT title FROM po) JOIN pat ON contains(title, pattern)) f ON f.title = po.title AND k = 1""", "po", **PATTERNS))
def career_first_substring(spark, sf):
    patterns = part_patterns(spark, sf)
    ordered = patterns.select("career_id", "pattern", F.dense_rank().over(W.orderBy("career_id")).alias("career_pos"),
                              F.row_number().over(W.partitionBy("career_id").orderBy("pattern")).alias("pattern_pos"))
    return matching.map_first_substring(postings(spark, sf).select("id", "title"), ordered).select("id", "career_id", "matched_pattern")


@query(with_ctes("""SELECT source, count(*) FILTER (WHERE career_id <> 'unmapped') AS mapped, count(*) FILTER (WHERE career_id = 'unmapped') AS unmapped, count(*) AS denominator,
    round(count(*) FILTER (WHERE career_id <> 'unmapped') / CAST(count(*) AS DOUBLE), 4) AS coverage FROM mp GROUP BY source""", "po", **PATTERNS))
def mapping_coverage_by_source(spark, sf):
    return reports.coverage_by(mapped(spark, sf), "source")


@query(with_ctes("""SELECT count(*) AS postings_total, count(*) FILTER (WHERE career_id <> 'unmapped') AS mapped_postings, count(*) FILTER (WHERE career_id = 'unmapped') AS unmapped_postings,
    count(*) FILTER (WHERE reason = 'ambiguous_title_pattern') AS ambiguous_postings, round(count(*) FILTER (WHERE career_id <> 'unmapped') / CAST(count(*) AS DOUBLE), 4) AS mapping_coverage FROM mp""", "po", **PATTERNS))
def mapping_report(spark, sf):
    return reports.mapping_report(mapped(spark, sf))


@query(with_ctes("SELECT career_id, count(*) AS n FROM mp GROUP BY career_id", "po", **PATTERNS))
def mapped_career_counts(spark, sf):
    return reports.career_counts(mapped(spark, sf))


@query(with_ctes("SELECT title AS title_key, count(*) AS n FROM mp WHERE career_id = 'unmapped' GROUP BY title HAVING count(*) >= 50", "po", **PATTERNS))
def unmapped_title_clusters(spark, sf):
    return reports.unmapped_clusters(mapped(spark, sf))


# ---------------------------------------------------------------- reuse of earlier results


@query(with_ctes("SELECT id, seniority <> 'entry' AS resumed, CASE WHEN seniority = 'entry' THEN lower(title) ELSE title END AS value FROM po", "po"))
def resumed_mapping(spark, sf):
    p = postings(spark, sf).select("id", "title", "seniority")
    current = p.withColumn("stamp", F.sha2("title", 256)).select("id", "title", "stamp")
    old = p.withColumn("stamp", F.when(F.col("seniority") == "entry", "old").otherwise(F.sha2("title", 256))).select("id", F.col("title").alias("value"), "stamp")
    out = incremental.resume(current, old, ["stamp"], lambda d: d.select("id", F.lower("title").alias("value"), "stamp"))
    return out.select("id", "resumed", "value")


@query(with_ctes("""SELECT po.id, CASE WHEN c.title IS NULL THEN 'miss' ELSE c.title END AS cached FROM po LEFT JOIN (SELECT DISTINCT p_name AS title FROM part WHERE p_type = 'PROMO' AND p_size > 40) c USING (title)""", "po"))
def cached_extraction(spark, sf):
    rows = postings(spark, sf).select("id", F.sha2("title", 256).alias("cache_key"))
    cache = table(spark, sf, "part").where((F.col("p_type") == "PROMO") & (F.col("p_size") > 40)).select("p_name").distinct().select(
        F.sha2("p_name", 256).alias("cache_key"), F.array("p_name").alias("skills"), F.array().cast("array<string>").alias("new_skills"))
    return incremental.with_cached(rows, cache).select("id", F.coalesce(F.col("cached_skills")[0], F.lit("miss")).alias("cached"))


@query("""SELECT c.conv_id || '/' || c.turn AS posting_id, b.ok AS batch_ok, CASE WHEN b.ok THEN c.role ELSE '' END AS skills, CASE WHEN b.ok AND c.turn = 0 THEN 'opening' ELSE '' END AS new_skills
    FROM conversations c JOIN (SELECT conv_id, bool_and(role <> 'system') AS ok FROM conversations GROUP BY conv_id) b USING (conv_id)""")
def external_results(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat_ws("/", "conv_id", "turn").alias("posting_id"))
    asked = rows.select(F.col("conv_id").alias("batch_id"), "posting_id")
    empty = F.array().cast("array<string>")
    given = rows.where(F.col("role") != "system").select(
        F.col("conv_id").alias("batch_id"), "posting_id", F.array(F.upper("role")).alias("skills"),
        F.when(F.col("turn") == 0, F.array(F.lit(" opening "), F.lit("chăm chỉ"), F.lit(""))).otherwise(empty).alias("new_skills"))
    taxonomy = rows.select(F.col("role").alias("name")).distinct().where(F.col("name") != "system").withColumn("aliases", empty).withColumn(
        "taxonomy_order", F.row_number().over(W.orderBy("name")))
    out = incremental.accept_external(asked, given, matching.alias_table(taxonomy))
    return out.select("posting_id", "batch_ok", F.array_join("skills", ",").alias("skills"), F.array_join("new_skills", ",").alias("new_skills"))


# ---------------------------------------------------------------- duplicates


@query("""SELECT max(o_orderkey) AS newest, c_mktsegment AS company, o_orderpriority AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def exact_duplicates(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        F.col("o_orderkey").alias("id"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0").alias("crawled_at"),
        F.col("o_orderpriority").alias("title"), F.col("c_mktsegment").alias("company"), F.to_date("o_orderdate").alias("posted_date"))
    kept = dedupe.exact_key_dedupe(rows)
    return kept.select(F.col("id").alias("newest"), F.upper("_company").alias("company"), F.upper("_title").alias("title"), F.col("posted_date").cast("string").alias("day"))


def _title_postings(spark, sf):
    """Orders as postings of one part title by one market segment: few names, hot companies, many days."""
    p = postings(spark, sf)
    return p.where(F.col("title") != "").select("id", "title", F.col("source").alias("company"), "posted_date", F.col("posted_date").cast("string").alias("crawled_at"))


@query()
def fuzzy_duplicates_removed(spark, sf):
    rows = _title_postings(spark, sf)
    kept = dedupe.deduplicate_postings(rows)
    return kept.groupBy("company").agg(F.count(F.lit(1)).alias("kept"), F.min("posted_date").cast("string").alias("first"), F.max("posted_date").cast("string").alias("last"))


@query()
def similar_title_pairs(spark, sf):
    nodes = dedupe.with_blocks(dedupe.exact_key_dedupe(_title_postings(spark, sf)))
    return dedupe.similar_names(nodes.select("_title", "_company", "_anchor").distinct()).select("ta", "tb", "ca", "ab", "ba")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT o_orderpriority AS title, c_mktsegment AS company, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey),
    k AS (SELECT title, company, max(d) AS d FROM n GROUP BY ALL
    UNION ALL SELECT title, company, d FROM (SELECT n.title, n.company, n.d, row_number() OVER (PARTITION BY n.title, n.company ORDER BY n.d DESC) AS r FROM k JOIN n ON n.title = k.title AND n.company = k.company AND n.d < k.d - 30) WHERE r = 1)
    SELECT title, company, CAST(d AS VARCHAR) AS day FROM k""")
def reposted_priorities_removed(spark, sf):
    """Titles so far apart that only equal ones are similar; ids repeat: the order rule alone decides."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        F.col("o_custkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("crawled_at"), F.col("o_orderpriority").alias("title"),
        F.col("c_mktsegment").alias("company"), F.to_date("o_orderdate").alias("posted_date"))
    return dedupe.deduplicate_postings(rows).select("title", "company", F.col("posted_date").cast("string").alias("day"))


# ---------------------------------------------------------------- samples


@query(with_ctes("""SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY md5(id || ':42'), id) AS r FROM po) WHERE r <= 10""", "po"))
def stratified_sample(spark, sf):
    return sampling.stratified_sample(postings(spark, sf).select("id", "source"), "source")


@query(with_ctes("""SELECT id, family, region FROM chosen UNION ALL SELECT id, family, region FROM (SELECT id, seniority AS family, region FROM po WHERE id NOT IN (SELECT id FROM chosen)
    ORDER BY md5(id || ':42'), id LIMIT (SELECT 100 - count(*) FROM chosen))""", "po",
    inn="""SELECT id, seniority AS family, region, row_number() OVER (PARTITION BY seniority, region ORDER BY md5(id || ':42'), id) AS turn FROM po WHERE seniority IN ('entry', 'mid', 'senior')""",
    chosen="SELECT id, family, region FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY turn, region) AS pos FROM inn WHERE turn <= 20) WHERE pos <= 20"))
def balanced_sample(spark, sf):
    rows = postings(spark, sf).select("id", F.col("seniority").alias("family"), "region")
    return sampling.balanced_sample(rows, "family", "region", ["entry", "mid", "senior"])


@query(with_ctes("""SELECT v.chk AS "check", v.errors, n, round(v.errors / CAST(n AS DOUBLE) * 100, 1) AS error_pct FROM (SELECT count(*) AS n, count(*) FILTER (WHERE region = 'other' AND r_name = 'EUROPE') AS region_errors,
    count(*) FILTER (WHERE o_orderpriority = 'x') AS none FROM s) t, LATERAL (VALUES ('salary_parse_error', none), ('region_map_error', region_errors), ('date_parse_error', none), ('exp_parse_error', none), ('seniority_error', none)) AS v(chk, errors)""",
    raw=RAW, norm=NORM, s0="SELECT n.*, r.r_name, r.o_orderpriority FROM norm n JOIN raw r USING (id) WHERE reject_reason IS NULL",
    s="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(id || ':42'), id) AS k FROM s0) WHERE k <= 10"))
def qa_error_rates(spark, sf):
    kept = normalize.normalize(raw_postings(spark, sf), F.lit("2001-01-01"), dedupe=False)
    return reports.qa_errors(sampling.stratified_sample(kept, "source"))


# ---------------------------------------------------------------- evaluation


def label_pairs(spark, sf):
    """Gold: part types of an order.  Predicted: those of its larger lines."""
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    sets = lines.groupBy(F.col("l_orderkey").alias("posting_id")).agg(
        F.collect_set("p_type").alias("skills"),
        F.collect_set(F.when((F.col("l_quantity") > 20) | (F.col("p_type") == "LARGE"), F.col("p_type"))).alias("p"),
        F.collect_set(F.when(F.col("l_quantity") > 48, F.lit("PHANTOM"))).alias("extra"))
    gold = sets.select("posting_id", "skills")
    return evaluation.label_pairs(gold, sets.select("posting_id", F.concat("p", "extra").alias("skills")))


EVAL = {
    "ln": "SELECT l_orderkey, p_type, l_quantity > 20 OR p_type = 'LARGE' AS hit, l_quantity > 48 AS ghost FROM lineitem JOIN part ON l_partkey = p_partkey",
    "per": """SELECT l_orderkey AS posting_id, count(DISTINCT p_type) FILTER (WHERE hit) AS tp, CAST(bool_or(ghost) AS BIGINT) AS fp, count(DISTINCT p_type) - count(DISTINCT p_type) FILTER (WHERE hit) AS fn FROM ln GROUP BY 1""",
    "tot": "SELECT count(*) AS items, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) FILTER (WHERE fp = 0 AND fn = 0) AS exact, count(*) FILTER (WHERE tp + fp = 0) AS zero FROM per",
    "pr2": "SELECT *, tp / CAST(tp + fp AS DOUBLE) AS p, tp / CAST(tp + fn AS DOUBLE) AS r FROM tot",
}


@query(with_ctes("SELECT posting_id, tp, fp, fn FROM per", **EVAL))
def label_counts_per_item(spark, sf):
    return evaluation.per_item_counts(label_pairs(spark, sf), "posting_id").drop("empty")


@query(with_ctes("""SELECT items, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1, round(exact / CAST(items AS DOUBLE), 4) AS exact_match_rate,
    round(zero / CAST(items AS DOUBLE), 4) AS zero_rate, p >= 0.8 AND r >= 0.65 AND 2 * p * r / (p + r) >= 0.7 AS passed FROM pr2""", **EVAL))
def micro_precision_recall(spark, sf):
    return evaluation.micro_metrics(evaluation.per_item_counts(label_pairs(spark, sf)))


@query(with_ctes("""SELECT kind, skill, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, skill) AS rank FROM (
    SELECT 'false_positive' AS kind, 'PHANTOM' AS skill, count(*) AS n FROM per WHERE fp = 1 UNION ALL
    SELECT 'false_negative', p_type, count(*) FROM (SELECT l_orderkey, p_type FROM ln GROUP BY ALL HAVING NOT bool_or(hit)) GROUP BY p_type)) WHERE rank <= 10""", **EVAL))
def most_common_label_errors(spark, sf):
    return evaluation.confusion_top(label_pairs(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


SLICED = with_ctes("""SELECT slice, items, round(tp / CAST(tp + fp AS DOUBLE), 4) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall FROM (
    SELECT o_orderpriority AS slice, count(*) AS items, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM per JOIN orders ON o_orderkey = posting_id GROUP BY 1)""", **EVAL)


@query(SLICED)
def sliced_label_metrics(spark, sf):
    items = evaluation.per_item_counts(label_pairs(spark, sf), "posting_id")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("slice"))
    return evaluation.micro_metrics(items.join(orders, F.col("posting_id") == F.col("o_orderkey")), "slice").select("slice", "items", "precision", "recall")


@query(with_ctes(f"SELECT slice, items, precision, precision + rank * 0.004 AS baseline_precision FROM (SELECT *, row_number() OVER (ORDER BY slice) AS rank FROM ({SLICED})) WHERE precision + rank * 0.004 - precision > 0.01"))
def precision_regressions(spark, sf):
    now = sliced_label_metrics(spark, sf)
    rank = F.row_number().over(W.orderBy("slice"))
    baseline = now.select("slice", (F.col("precision") + rank * 0.004).alias("precision"))
    return evaluation.precision_regressions(now, baseline, "slice").select("slice", "items", "precision", "baseline_precision")


@query("""SELECT lang, source, count(*) AS items, round(avg(CASE WHEN (n_chars > 300) = (quality = 1) THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def mapping_accuracy_by_slice(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", (F.col("n_chars") > 300).cast("int").alias("predicted"))
    return evaluation.accuracy_by(table(spark, sf, "labels").withColumnRenamed("quality", "gold").join(docs, "doc_id"), "lang", "source")


@query("""SELECT event_type, n, (SELECT min(value) FROM r WHERE r.event_type = t.event_type AND k >= ceil(n * 0.95)) AS p95, round(median, 4) AS median FROM (SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1) t""".replace(
    "SELECT event_type, n, (", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k FROM events) SELECT event_type, n, (", 1))
def nearest_rank_latency(spark, sf):
    return evaluation.nearest_rank(table(spark, sf, "events"), ["event_type"], "value")


# ---------------------------------------------------------------- reports


@query(with_ctes("""SELECT CASE grouping_id(source, region) WHEN 0 THEN 'source_region' WHEN 1 THEN 'source' WHEN 2 THEN 'region' ELSE 'total' END AS level, source, region, count(*) AS n,
    count(*) FILTER (WHERE salary_min_trieu IS NOT NULL OR salary_max_trieu IS NOT NULL) AS with_salary, count(experience_min_years) AS with_experience,
    count(*) FILTER (WHERE seniority = 'entry') AS entry, count(*) FILTER (WHERE seniority = 'mid') AS mid, count(*) FILTER (WHERE seniority = 'senior') AS senior, count(*) FILTER (WHERE seniority = 'unknown') AS unknown,
    round(count(*) FILTER (WHERE salary_min_trieu IS NOT NULL OR salary_max_trieu IS NOT NULL) / CAST(count(*) AS DOUBLE) * 100, 2) AS salary_pct,
    round(count(experience_min_years) / CAST(count(*) AS DOUBLE) * 100, 2) AS experience_pct FROM norm WHERE reject_reason IS NULL GROUP BY GROUPING SETS ((source), (region), (source, region), ())""", raw=RAW, norm=NORM))
def manifest_counts(spark, sf):
    return reports.manifest_counts(normalize.normalize(raw_postings(spark, sf), F.lit("2001-01-01"), dedupe=False))


@query(with_ctes("SELECT (SELECT count(*) FROM norm) AS raw_total, count(*) AS normalized_total, (SELECT count(*) FROM norm) - count(*) AS dropped_or_deduped, round(((SELECT count(*) FROM norm) - count(*)) / CAST((SELECT count(*) FROM norm) AS DOUBLE) * 100, 2) AS dedupe_rate_pct FROM norm WHERE reject_reason IS NULL", raw=RAW, norm=NORM))
def raw_to_normalized_rate(spark, sf):
    raw = raw_postings(spark, sf)
    return reports.drop_rate(raw, normalize.normalize(raw, F.lit("2001-01-01"), dedupe=False))


@query(with_ctes("""SELECT count(*) AS postings_total, count(*) FILTER (WHERE ns < 3) AS low_signal_postings, count(*) FILTER (WHERE ns = 0) AS zero_skill_postings, round(avg(ns), 3) AS average_skills_per_posting,
    CAST(0 AS BIGINT) AS new_skill_candidates, count(*) FILTER (WHERE ns >= 3) AS status_not_needed, count(*) FILTER (WHERE ns < 3) AS status_dictionary_fallback, CAST(0 AS BIGINT) AS status_cache_hit, CAST(0 AS BIGINT) AS status_success,
    CAST(ceil(sum(length(title)) / 4.0) AS BIGINT) AS estimated_input_tokens, CAST(ceil(sum(ns) / 4.0) AS BIGINT) AS estimated_output_tokens,
    round(ceil(sum(length(title)) / 4.0) * 0.5 / 1e6 + ceil(sum(ns) / 4.0) * 1.5 / 1e6, 6) AS estimated_cost_usd FROM (SELECT po.id, any_value(title) AS title, count(skill) AS ns FROM po LEFT JOIN po_skill USING (id) GROUP BY po.id)""", "po", "po_skill"))
def extraction_report(spark, sf):
    p = postings(spark, sf)
    low = incremental.low_signal(F.col("skills"))
    rows = p.select(
        "skills", F.array().cast("array<string>").alias("new_skills"), low.alias("low_signal"),
        F.when(low, "dictionary_fallback").otherwise("not_needed").alias("status"), F.length("title").alias("input_chars"), F.size("skills").alias("output_chars"))
    return reports.extraction_report(rows, 0.5, 1.5).drop("estimated_cost_per_1k_usd")


@query("SELECT lower(p_type) AS term, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 5")
def new_term_candidates(spark, sf):
    return reports.candidate_terms(table(spark, sf, "part"), "p_type", 5)


@query(with_ctes("""SELECT career_id, slice AS region, count(*) AS demand_count, count(sal) AS salary_samples, CASE WHEN count(sal) >= 5 THEN round(quantile_cont(sal, 0.25), 2) END AS salary_p25,
    CASE WHEN count(sal) >= 5 THEN round(quantile_cont(sal, 0.5), 2) END AS salary_p50, CASE WHEN count(sal) >= 5 THEN round(quantile_cont(sal, 0.75), 2) END AS salary_p75 FROM (
    SELECT career_id, unnest([region, 'all']) AS slice, (coalesce(salary_min_trieu, salary_max_trieu) + coalesce(salary_max_trieu, salary_min_trieu)) / 2 AS sal FROM po) WHERE slice IN ('all', 'ASIA') AND career_id <> 'unmapped' GROUP BY ALL""", "po"))
def traceability_audit(spark, sf):
    audit = table(spark, sf, "part").select(F.col("p_brand").alias("career_id")).distinct().select("career_id", F.explode(F.array(F.lit("all"), F.lit("ASIA"))).alias("region"))
    return reports.traceability(postings(spark, sf), audit)


@query(with_ctes("""SELECT id, career_id, slice AS region FROM (SELECT id, career_id, unnest([region, 'all']) AS slice FROM po) WHERE slice IN ('all', 'ASIA') AND career_id <> 'unmapped'""", "po"))
def traceability_posting_ids(spark, sf):
    audit = table(spark, sf, "part").select(F.col("p_brand").alias("career_id")).distinct().select("career_id", F.explode(F.array(F.lit("all"), F.lit("ASIA"))).alias("region"))
    return reports.traceability_ids(postings(spark, sf), audit).select("id", "career_id", "region")


@query(with_ctes("""SELECT 'group_share' AS insight, 'group' AS item, CAST(count(*) FILTER (WHERE career_id IN ('Brand#1', 'Brand#2')) AS DOUBLE) AS numerator, count(*) FILTER (WHERE career_id <> 'unmapped') AS denominator,
    round(count(*) FILTER (WHERE career_id IN ('Brand#1', 'Brand#2')) / CAST(count(*) FILTER (WHERE career_id <> 'unmapped') AS DOUBLE) * 100, 1) AS value FROM po
    UNION ALL SELECT 'region_share', region, CAST(count(*) AS DOUBLE), (SELECT count(*) FROM po), round(count(*) / CAST((SELECT count(*) FROM po) AS DOUBLE) * 100, 1) FROM po GROUP BY region
    UNION ALL SELECT 'mean_salary', seniority, round(sum(sal), 1), count(sal), round(avg(sal), 1) FROM (SELECT seniority, (coalesce(salary_min_trieu, salary_max_trieu) + coalesce(salary_max_trieu, salary_min_trieu)) / 2 AS sal FROM po) WHERE seniority IN ('entry', 'senior') GROUP BY seniority""", "po"))
def market_insights(spark, sf):
    return reports.insights(postings(spark, sf), ["Brand#1", "Brand#2"])


ATTEMPTS = """SELECT c_mktsegment AS source, CASE o_orderpriority WHEN '1-URGENT' THEN 404 WHEN '2-HIGH' THEN 0 ELSE 200 END AS status,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'http' WHEN o_orderstatus = 'P' THEN 'inactive' WHEN o_orderpriority = '5-LOW' THEN 'parse_error' ELSE 'ok' END AS outcome, o_orderstatus = 'O' AS resumed FROM orders JOIN customer ON o_custkey = c_custkey"""


def _attempts(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    p = F.col("o_orderpriority")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        F.col("c_mktsegment").alias("source"), F.when(p == "1-URGENT", 404).when(p == "2-HIGH", 0).otherwise(200).alias("status"),
        F.when(p.isin("1-URGENT", "2-HIGH"), "http").when(F.col("o_orderstatus") == "P", "inactive").when(p == "5-LOW", "parse_error").otherwise("ok").alias("outcome"),
        (F.col("o_orderstatus") == "O").alias("resumed"))


@query(with_ctes("""SELECT source, count(*) AS discovered_urls, count(*) FILTER (WHERE resumed) AS resumed_records, count(*) FILTER (WHERE NOT resumed) AS attempted_urls, count(*) FILTER (WHERE outcome = 'inactive') AS skipped_inactive,
    count(*) FILTER (WHERE outcome = 'parse_error') AS parse_errors, count(*) FILTER (WHERE status <> 200 AND NOT resumed) AS http_errors, count(*) FILTER (WHERE outcome = 'ok' OR resumed) AS unique_records, false AS blocked, 'public_inventory_exhausted' AS stop_reason FROM att GROUP BY source""", att=ATTEMPTS))
def ingest_metrics(spark, sf):
    return reports.ingest_metrics(_attempts(spark, sf))


@query(with_ctes("SELECT source, CASE status WHEN 0 THEN 'network' ELSE CAST(status AS VARCHAR) END AS status, count(*) AS n FROM att WHERE status <> 200 AND NOT resumed GROUP BY ALL", att=ATTEMPTS))
def ingest_http_errors(spark, sf):
    return reports.http_error_counts(_attempts(spark, sf))


@query(with_ctes("""SELECT source, field, filled, n, round(filled / CAST(n AS DOUBLE) * 100, 2) AS filled_pct FROM (SELECT source, count(*) AS n, count(salary_min_trieu) AS a, count(experience_min_years) AS b FROM
    (SELECT unnest([source, 'all']) AS source, salary_min_trieu, experience_min_years FROM norm) GROUP BY source) t, LATERAL (VALUES ('salary_min_trieu', a), ('experience_min_years', b)) AS v(field, filled)""", raw=RAW, norm=NORM))
def field_coverage_profile(spark, sf):
    tagged = normalize.tag_normalized(raw_postings(spark, sf), F.lit("2001-01-01"))
    return reports.profile_fields(tagged, "source", ["salary_min_trieu", "experience_min_years"])


@query(with_ctes("""SELECT source, CASE WHEN age <= 7 THEN '0-7' WHEN age <= 30 THEN '8-30' WHEN age <= 90 THEN '31-90' ELSE '91+' END AS bucket, count(*) AS n FROM (SELECT source, date_diff('day', posted_date, (SELECT max(posted_date) FROM po)) AS age FROM po) GROUP BY ALL""", "po"))
def freshness_profile(spark, sf):
    p = postings(spark, sf)
    return reports.freshness_buckets(p, market.latest_day(p))


# ---------------------------------------------------------------- contracts


def _part_taxonomy(spark, sf):
    names = table(spark, sf, "part").select("p_name", "p_type").groupBy("p_name").agg(F.min("p_type").alias("t"))
    kind = F.when(F.col("t") == "ECONOMY", "tool").when(F.col("t") == "LARGE", "technical").when(F.col("t") == "SMALL", "Small").otherwise("domain")
    return names.select(F.col("p_name").alias("name"), F.array(F.split("p_name", " ")[0], F.upper(F.split("p_name", " ")[1])).alias("aliases"), kind.alias("type"))


@query(with_ctes("""SELECT 'unknown type' AS rule, p_name AS item FROM t WHERE tp = 'SMALL' UNION ALL SELECT 'alias not lower case', upper(split_part(p_name, ' ', 2)) FROM t
    UNION ALL SELECT DISTINCT 'alias collision', split_part(p_name, ' ', 1) FROM t UNION ALL SELECT DISTINCT 'alias collision', split_part(p_name, ' ', 2) FROM t
    UNION ALL SELECT 'missing type soft', 'types' UNION ALL SELECT 'missing type technical', 'types' FROM (SELECT count(*) AS n FROM t WHERE tp = 'LARGE') WHERE n = 0
    UNION ALL SELECT 'missing type domain', 'types' FROM (SELECT count(*) AS n FROM t WHERE tp NOT IN ('LARGE', 'SMALL', 'ECONOMY')) WHERE n = 0
    UNION ALL SELECT 'missing type tool', 'types' FROM (SELECT count(*) AS n FROM t WHERE tp = 'ECONOMY') WHERE n = 0""", t="SELECT p_name, min(p_type) AS tp FROM part GROUP BY p_name"))
def taxonomy_violations(spark, sf):
    return quality.taxonomy_violations(_part_taxonomy(spark, sf))


@query("""SELECT 'shared pattern' AS rule, p AS item FROM (SELECT DISTINCT p_brand, p_name AS p FROM part) GROUP BY p HAVING count(*) > 1""")
def career_base_violations(spark, sf):
    kb = table(spark, sf, "part").groupBy(F.col("p_brand").alias("career_id")).agg(F.collect_set("p_name").alias("title_patterns")).withColumn("title", F.col("career_id"))
    return quality.career_violations(kb)


@query(with_ctes("""SELECT 'duplicate id' AS rule, company AS item FROM po GROUP BY company HAVING count(*) > 1 UNION ALL SELECT 'invalid date', company FROM po WHERE seniority = 'mid'""", "po"))
def market_input_violations(spark, sf):
    rows = postings(spark, sf).select(
        F.col("company").alias("id"), "skills", "career_id", F.when(F.col("seniority") != "mid", F.col("posted_date")).alias("posted_date"))
    return quality.market_input_violations(rows)


@query("""SELECT 'wrong size' AS rule, CAST(count(DISTINCT l_orderkey) AS VARCHAR) AS item FROM lineitem UNION ALL SELECT 'too few groups', '3' UNION ALL SELECT 'label outside taxonomy', 'PROMO'""")
def gold_contract_violations(spark, sf):
    lines = order_lines(spark, sf)
    status = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("career_group"), F.col("o_orderpriority").alias("region"))
    # Six rules read the orders; they are gathered once.
    gold = cut_lineage(lines.join(status, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").cast("string").alias("posting_id"), "region", "career_group", "skills"))
    labels = table(spark, sf, "part").select(F.col("p_type").alias("skill")).distinct().where(F.col("skill") != "PROMO")
    return quality.gold_violations(gold, labels, 100, 3, 5, None)


@query(with_ctes("""SELECT 'duplicate id' AS rule, title AS item FROM po GROUP BY title HAVING count(*) > 1 UNION ALL SELECT 'mixed versions', '3' UNION ALL SELECT 'blank id', title FROM po WHERE title = ''""", "po"))
def enriched_input_violations(spark, sf):
    p = postings(spark, sf)
    meta = F.struct(F.lit("v1").alias("version"), F.lit("t1").alias("taxonomy_version"), F.when(F.col("salary_min_trieu").isNull(), "a").when(F.col("salary_max_trieu").isNull(), "b").otherwise("c").alias("taxonomy_hash"))
    return quality.enriched_violations(p.select(F.col("title").alias("id"), F.col("company").alias("title"), "skills", meta.alias("skill_extraction")))


@query(with_ctes("""SELECT 'CANDIDATE_NOT_RELEASED' AS release_status, 'Career mapping accuracy is NOT_RUN' || CASE WHEN share > 0.5 THEN '|Region ''other'' dominates the snapshot' ELSE '' END AS blockers FROM (SELECT count(*) FILTER (WHERE region = 'ASIA') / CAST(count(*) AS DOUBLE) AS share FROM po)""", "po"))
def release_gate(spark, sf):
    report = postings(spark, sf).agg((F.count_if(F.col("region") == "ASIA") / F.count(F.lit(1))).alias("other_region_share")).withColumn("mapping_accuracy", F.lit("NOT_RUN"))
    return quality.release_gate(report).select("release_status", F.array_join("release_blockers", "|").alias("blockers"))
