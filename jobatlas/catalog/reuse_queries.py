"""Snapshots, caches, dimension documents, fingerprints and incremental enrichment over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from jobatlas.catalog.base import query, table
from jobatlas.catalog.session_queries import _run_folder
from jobatlas.catalog.text_queries import REDACTED
from jobatlas.functions import hashing, parsing, privacy
from jobatlas.operators import explain, incremental, quality
from jobatlas.sources import files
from jobatlas.streaming import market as market_stream


@query("""SELECT o_orderkey AS id, o_totalprice AS price, NULL AS note FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'""")
def union_of_snapshots(spark, sf):
    """Two snapshots that overlap and of which only the later has a column."""
    orders = table(spark, sf, "orders")
    early = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    late = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("note"))
    return files.union_snapshots(early, late)


@query("""SELECT sha256(p_name) AS cache_key, CASE WHEN length(p_name) % 2 = 0 THEN 'new' ELSE 'old' END AS skill FROM part GROUP BY p_name""")
def merged_extraction_cache(spark, sf):
    """Fresh results replace cached ones of the same key; other cached rows stay."""
    names = table(spark, sf, "part").select("p_name").distinct()
    key = F.sha2("p_name", 256).alias("cache_key")
    cache = names.select(key, F.array(F.lit("old")).alias("skills"))
    fresh = names.where("length(p_name) % 2 = 0").select(key, F.array(F.lit("new")).alias("skills"))
    return incremental.merge_cache(cache, fresh).select("cache_key", F.element_at("skills", 1).alias("skill"))


@query("""SELECT o_orderkey AS id, array_to_string(list_filter(['F', 'O', 'P', '1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'],
    lambda x: x = o_orderstatus OR x = o_orderpriority OR x = '3-MEDIUM'), ',') AS labels FROM orders""")
def labels_in_taxonomy_order(spark, sf):
    order = F.array(*map(F.lit, ("F", "O", "P", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    left, right = F.array("o_orderpriority", F.lit("unknown label")), F.array(F.lit("3-MEDIUM"), F.col("o_orderstatus"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(incremental.union_in_order(left, right, order), ",").alias("labels"))


HEADER = """SELECT p_partkey % 3 AS schema_version, CASE WHEN p_size % 4 = 0 THEN '1.' || p_size ELSE '1.' || p_size || '.0' END AS version,
    CASE WHEN p_size = 31 THEN '2026-02-31' WHEN p_size > 45 THEN 'soon' ELSE '2026-01-' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') END AS built_at,
    p_brand AS taxonomy_hash, CASE WHEN p_size % 2 = 0 THEN p_brand END AS expected_hash FROM part"""


@query(f"""WITH h AS ({HEADER}), v AS (
    SELECT 'schema version' AS rule, CAST(schema_version AS VARCHAR) AS item FROM h WHERE schema_version <> 1
    UNION ALL SELECT 'semantic version', version FROM h WHERE NOT regexp_full_match(version, '[0-9]+[.][0-9]+[.][0-9]+')
    UNION ALL SELECT 'build date', built_at FROM h WHERE built_at IN ('soon', '2026-02-31')
    UNION ALL SELECT 'taxonomy hash', taxonomy_hash FROM h WHERE taxonomy_hash IS DISTINCT FROM expected_hash)
    SELECT rule, item, count(*) AS n FROM v GROUP BY ALL""")
def taxonomy_header_rules(spark, sf):
    size = F.col("p_size")
    header = table(spark, sf, "part").select(
        (F.col("p_partkey") % 3).alias("schema_version"),
        F.concat(F.lit("1."), size, F.when(size % 4 == 0, "").otherwise(".0")).alias("version"),
        F.when(size == 31, "2026-02-31").when(size > 45, "soon").otherwise(F.concat(F.lit("2026-01-"), F.lpad((size % 28 + 1).cast("string"), 2, "0"))).alias("built_at"),
        F.col("p_brand").alias("taxonomy_hash"), F.when(size % 2 == 0, F.col("p_brand")).alias("expected_hash"),
    )
    return quality.header_violations(header).groupBy("rule", "item").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand AS name, lower(p_brand) AS alias, p_type AS type, row_number() OVER (ORDER BY p_brand) - 1 AS taxonomy_order
    FROM (SELECT p_brand, min(p_type) AS p_type FROM part GROUP BY p_brand)""")
def taxonomy_document_skills(spark, sf):
    """A taxonomy written as one document and loaded as a dimension."""
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_type").alias("p_type"))
    skill = F.struct(F.col("p_brand").alias("name"), F.array(F.lower("p_brand")).alias("aliases"), F.col("p_type").alias("type"))
    doc = brands.agg(F.array_sort(F.collect_list(skill)).alias("skills")).select(F.lit(1).alias("schema_version"), F.lit("1.0.0").alias("version"), "skills")
    path = files.write_atomic(doc.coalesce(1), f"{_run_folder(spark)}/taxonomy")
    return files.taxonomy_dimension(spark, path).select("name", F.element_at("aliases", 1).alias("alias"), "type", F.col("taxonomy_order").cast("long").alias("taxonomy_order"))


@query("""SELECT r_name AS career_id, n AS members, row_number() OVER (ORDER BY r_name) - 1 AS career_pos
    FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)""")
def career_document_rows(spark, sf):
    regions = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    career = F.struct(F.col("r_name").alias("career_id"), F.col("n").alias("members"))
    path = files.write_atomic(regions.agg(F.array_sort(F.collect_list(career)).alias("careers")).coalesce(1), f"{_run_folder(spark)}/careers")
    return files.career_dimension(spark, path, "career_id string, members long").withColumn("career_pos", F.col("career_pos").cast("long"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_name || chr(10) || p_type WHEN p_size % 3 = 1 THEN p_name ELSE p_name || chr(10) || 'benefitsplan' || chr(10) || p_type END AS relevant FROM part""")
def lines_before_benefits(spark, sf):
    """The cut falls before a heading line, decorated or not, and not before a word that only begins like one."""
    size = F.col("p_size")
    heading = F.when(size % 3 == 1, F.when(size % 2 == 0, "** Quyền lợi: **").otherwise("BENEFITS of the job")).when(size % 3 == 2, "benefitsplan")
    text = F.concat_ws("\n", "p_name", heading, "p_type")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), parsing.relevant_description(text).alias("relevant"))


@query("SELECT (SELECT count(*) FROM nation) AS n_rows, true AS reordered_same, false AS changed_same, true AS excluded_same, true AS pinned_passes, true AS wrong_pin_stops")
def fingerprint_properties(spark, sf):
    """A table's fingerprint is free of row and column order and sees one changed value; a wrong pin stops the run."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    mark = lambda df, **k: hashing.table_fingerprint(df, **k).first()
    own = mark(nation)
    reordered = mark(nation.select("n_regionkey", "n_name", "n_nationkey").orderBy(F.desc("n_name")).repartition(3))
    changed = mark(nation.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "X").otherwise(F.col("n_name"))))
    noted = mark(nation.withColumn("note", F.rand(1)), exclude=("note",))
    try:
        quality.require_fingerprint(nation, changed["fingerprint"])
        stopped = False
    except ValueError:
        stopped = True
    passed = quality.require_fingerprint(nation, hashing.dimension_hash(nation, *nation.columns))
    same = lambda x: F.lit(x["fingerprint"] == own["fingerprint"])
    return passed.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", same(reordered).alias("reordered_same"), same(changed).alias("changed_same"), same(noted).alias("excluded_same"),
        (F.col("n_rows") == own["n_rows"]).alias("pinned_passes"), F.lit(stopped).alias("wrong_pin_stops"))


@query("""SELECT CASE WHEN CAST(ts AS DATE) < DATE '2024-01-10' THEN 'late' ELSE 'on time' END AS side, event_type, count(*) AS n FROM events GROUP BY ALL""")
def late_events_aside(spark, sf):
    """Rows before the cutoff go to the side output; none vanishes."""
    timed = table(spark, sf, "events").select("event_type", F.to_timestamp("ts").alias("event_time"))
    on_time, late = market_stream.split_late(timed, F.lit("2024-01-10").cast("timestamp"))
    both = on_time.withColumn("side", F.lit("on time")).unionByName(late.withColumn("side", F.lit("late")))
    return both.groupBy("side", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'v2' ELSE 'v1' END AS stamp, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS batch FROM orders""")
def enriched_in_batches(spark, sf):
    """Two batches, the second with some changed stamps: only those are recomputed, and each id has one current row."""
    path = f"{_run_folder(spark)}/enriched"
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    step = market_stream.enrich_changed(path, ["stamp"], lambda rows: rows.withColumn("done", F.lit(True)))
    step(orders.withColumn("stamp", F.lit("v1")), 0)
    step(orders.withColumn("stamp", F.when(F.col("o_orderstatus") == "F", "v2").otherwise("v1")), 1)
    return market_stream.current_results(spark, path).select("id", "stamp", F.col("batch").cast("int").alias("batch"))


#: The redaction of a text, over one of its lines.
LISTED = re.sub(r"\btext\b", "line", REDACTED)


@query(f"""SELECT doc_id, 'lines,source' AS keys, md5(string_agg(coalesce({LISTED}, ''), chr(31) ORDER BY i)) AS lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id""")
def redacted_list_values(spark, sf):
    """Arguments that are lists: sensitive keys go, every string of the others is redacted."""
    lines = F.split("text", "\n", -1)
    args = F.create_map(F.lit("lines"), lines, F.lit("gpa"), lines, F.lit("school"), F.array("lang"), F.lit("source"), F.array("source"))
    out = privacy.redact_list_map(args)
    return table(spark, sf, "documents").where(F.col("text").isNotNull()).select(
        "doc_id", F.array_join(F.array_sort(F.map_keys(out)), ",").alias("keys"), F.md5(F.array_join(out["lines"], "\x1f")).alias("lines"))


@query("""WITH c AS (SELECT conv_id, turn, role, left(text, 40) AS quote, left(text, 60) AS known, CAST(length(text) AS VARCHAR) AS n,
      regexp_matches(lower(left(text, 40)), 'ignore previous|system:|api_key|you are dan|root_access|sk-') AS attack FROM conversations)
    SELECT conv_id, turn, CASE WHEN role <> 'system' THEN CASE WHEN trim(quote) <> '' AND NOT attack AND turn % 5 <> 4 THEN quote ELSE known END END AS quote,
      CASE WHEN role <> 'system' THEN CASE WHEN trim(quote) <> '' AND NOT attack AND turn % 5 <> 4 THEN 'bạn viết ' || n || ' ký tự' ELSE 'dựa trên điều bạn đã chia sẻ trong hồ sơ' END END AS reason,
      CASE WHEN role <> 'system' THEN 'có ' || n || ' tin' END AS market,
      CASE WHEN role <> 'system' THEN CASE turn % 3 WHEN 0 THEN 'sự thật ' || n WHEN 1 THEN 'Nếu khác đi' ELSE 'sự thật ' || n END END AS counterfactual FROM c""")
def validated_explanations(spark, sf):
    """Drafted explanations with planted faults: foreign quotes, unknown numbers and keys, missing statements.

    Every fifth turn's draft quotes something that was never said; drafts for system turns state only a number that is
    not known, so nothing of them stands.
    """
    n = F.length("text").cast("string")
    item = lambda quote, reason: F.struct(quote.alias("quote"), reason.alias("reason"))
    line = lambda stat, key: F.struct(stat.alias("stat"), F.lit(key).alias("stat_key"))
    unknown = F.lit("có 987654321987 tin")
    quote = F.when(F.col("turn") % 5 == 4, "chưa từng nói điều này §").otherwise(F.left("text", F.lit(40)))
    why = F.struct(
        F.array(item(quote, F.concat(F.lit("bạn viết "), n, F.lit(" ký tự"))), item(F.lit("§ lời của người khác §"), F.lit("không"))).alias("from_you"),
        F.array(line(F.when(F.col("role") == "system", unknown).otherwise(F.concat(F.lit("có "), n, F.lit(" tin"))), "demand_count"), line(unknown, "salary"), line(F.lit("tốt"), "rumour")).alias("from_market"),
        F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "Nếu khác đi").otherwise("Nếu có 987654321987").alias("counterfactual"),
    )
    kept = explain.validated_why(why, F.array(F.left("text", F.lit(60))), F.array(n), F.concat(F.lit("sự thật "), n))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", kept.alias("why"))
    return rows.select(
        "conv_id", "turn", F.col("why.from_you")[0].quote.alias("quote"), F.col("why.from_you")[0].reason.alias("reason"),
        F.array_join(F.transform("why.from_market", lambda m: m.stat), " | ").alias("market"), F.col("why.counterfactual").alias("counterfactual"))
