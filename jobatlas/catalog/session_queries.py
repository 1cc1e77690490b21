"""Session folds, turn signals, trailing frames, ingest and streaming runs over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobatlas.catalog.base import dimension_map, EVENT_TYPES, postings, profiles, query, table, with_ctes
from jobatlas.functions import turns as turn_functions
from jobatlas.functions.scoring import DIMENSIONS, completeness
from jobatlas.operators import market, sessions
from jobatlas.session import ensure_checkpoint_dir
from jobatlas.sources import files, pages as page_source
from jobatlas.streaming import market as market_stream


def conversation_turns(spark, sf):
    """User turns of every conversation as session turns; the mode follows the conversation's first role."""
    rows = table(spark, sf, "conversations").where(F.col("role") == "user")
    return rows.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"),
        F.when(F.length("text") > 400, "launch").otherwise("explore").alias("journey_mode"), "text")


@query()
def session_profile_fold(spark, sf):
    snaps = sessions.fold_sessions(conversation_turns(spark, sf))
    last = sessions.latest_profiles(snaps)
    return last.select("session_id", "turn", "journey_mode", "phase", "done", "completeness", F.size("skills").cast("long").alias("n_skills"),
                       F.size("interests").cast("long").alias("n_interests"), F.col("constraints.region_pref").alias("region_pref"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS quotes FROM conversations WHERE role = 'user' AND trim(text) <> ''
    AND NOT regexp_matches(lower(text), 'ignore previous|system:|api_key|you are dan|root_access|sk-') GROUP BY conv_id""")
def session_evidence_quotes(spark, sf):
    snaps = sessions.fold_sessions(conversation_turns(spark, sf))
    return sessions.evidence_quotes(snaps).groupBy("session_id").agg(F.count(F.lit(1)).alias("quotes"))


@query()
def conversation_signals(spark, sf):
    signals = turn_functions.turn_signals(conversation_turns(spark, sf))
    return signals.select(
        "session_id", "seq", "meaningful", "injection", "negation", F.array_join("dims_hit", ",").alias("dims"), F.array_join("tools", ",").alias("tools"),
        "label", "education", "goal", "region", "budget", "no_experience")


@query()
def keyword_dimension_strength(spark, sf):
    return sessions.dimension_strength(turn_functions.turn_signals(conversation_turns(spark, sf)))


@query("""SELECT conv_id, turn, role, array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), ',') AS kept,
    array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), ',') AS history,
    CASE WHEN role = 'assistant' THEN array_to_string(list(turn) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ',') END AS last_assistant FROM conversations""")
def trailing_message_frames(spark, sf):
    rows = sessions.trailing_messages(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id")

    def text(c):
        return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)

    return rows.select("conv_id", "turn", "role", text("kept"), text("history"), text("last_assistant"))


@query(with_ctes("""SELECT session_id, round(CASE WHEN journey_mode = 'launch' THEN (0 + 0 + 1.0 + least(1.0, ns / 2.0) + 1.0) / 5 ELSE (least(1.0, ni / 2.0) + least(1.0, na / 2.0) + least(1.0, ns / 2.0) + 1.0) / 4 END, 2) AS completeness,
    CASE WHEN journey_mode = 'launch' THEN CASE WHEN ns < 2 THEN 'sourced_skills' ELSE '' END ELSE array_to_string(list_filter([CASE WHEN ni < 2 THEN 'interests' END, CASE WHEN ns < 2 THEN 'sourced_skills' END], lambda x: x IS NOT NULL), ',') END AS missing
    FROM (SELECT pr.*, (SELECT count(DISTINCT label) FROM ev WHERE event_type = 'purchase' AND CAST(user_id AS VARCHAR) = pr.session_id) AS ns, (SELECT count(DISTINCT label) FROM ev WHERE event_type = 'click' AND CAST(user_id AS VARCHAR) = pr.session_id) AS ni,
    CAST(e1 > 0.05 AS INT) + CAST(e2 > 0.05 AS INT) + CAST(e3 > 0.05 AS INT) + CAST(e4 > 0.05 AS INT) + CAST(e5 > 0.05 AS INT) AS na FROM pr)""", "pr", "ev"))
def profile_completeness_and_gaps(spark, sf):
    n_skills = F.size(F.filter("skills", lambda s: s.source_quote != ""))
    active = F.size(F.filter(F.map_values("dimensions"), lambda v: v > 0.05))
    full = completeness(F.col("journey_mode"), F.lit(""), F.col("job_goal"), F.col("constraints.notes"), F.size("experiences"), n_skills,
                        F.size("interests"), active, F.col("constraints.region_pref").isNotNull())
    rows = profiles(spark, sf).withColumn("full", full)
    gaps = sessions.missing_slots(F.col("journey_mode"), F.size("interests"), n_skills, F.size("experiences"), F.lit(1.0))
    return rows.select("session_id", F.col("full").alias("completeness"), F.array_join(gaps, ",").alias("missing"))


def _dims_until(spark, sf, cut):
    e = table(spark, sf, "events")
    e = e if cut is None else e.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
    agg = e.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("event_type") == t).alias(d) for t, d in zip(EVENT_TYPES, DIMENSIONS)],
        F.array_sort(F.collect_set(F.when(F.col("value") > 100, F.col("event_type")))).alias("interests"))
    none = F.array().cast("array<struct<name:string,level:string,source_quote:string>>")
    exp = F.array().cast("array<struct<title:string,kind:string,description:string,skills:array<string>,source_quote:string>>")
    return agg.select("session_id", dimension_map("n").alias("dimensions"), none.alias("skills"), "interests", exp.alias("experiences"))


_SHARES = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') / CAST(count(*) AS DOUBLE) AS {d}" for t, d in zip(EVENT_TYPES, DIMENSIONS))
_MOVED = " || ".join(f"CASE WHEN abs(a.{d} - coalesce(b.{d}, 0)) >= 0.01 THEN '{d},' ELSE '' END" for d in DIMENSIONS)


@query(f"""WITH a AS (SELECT user_id, {_SHARES}, list(DISTINCT event_type ORDER BY event_type) FILTER (WHERE value > 100) AS i FROM events GROUP BY 1),
    b AS (SELECT user_id, {_SHARES}, list(DISTINCT event_type ORDER BY event_type) FILTER (WHERE value > 100) AS i FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1)
    SELECT CAST(a.user_id AS VARCHAR) AS session_id, {_MOVED} AS moved, array_to_string(list_filter(coalesce(a.i, []), lambda x: NOT list_contains(coalesce(b.i, []), x)), ',') AS added FROM a LEFT JOIN b USING (user_id)""")
def profile_snapshot_diff(spark, sf):
    diff = sessions.profile_diff(_dims_until(spark, sf, "2024-01-10 00:00:00"), _dims_until(spark, sf, None))
    order = F.array(*[F.lit(d) for d in DIMENSIONS])
    moved = F.array_join(F.transform(F.filter(order, lambda d: F.array_contains("changed_dimensions", d)), lambda d: F.concat(d, F.lit(","))), "")
    return diff.select("session_id", moved.alias("moved"), F.array_join("added_interests", ",").alias("added"))


# ---------------------------------------------------------------- scans, sinks and inventories


def _run_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


@query("""SELECT p_partkey AS id, p_name, p_brand FROM part""")
def json_round_trip(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    path = files.write_atomic(parts, f"{_run_folder(spark)}/part")
    return files.read_strict(spark, path, "id long, p_name string, p_brand string")


@query("""SELECT count(*) FILTER (WHERE p_size > 10) AS good, count(*) FILTER (WHERE p_size <= 10) AS rejected FROM part""")
def tolerant_json_scan(spark, sf):
    line = F.when(F.col("p_size") > 10, F.to_json(F.struct(F.col("p_partkey").alias("id"), "p_name"))).otherwise(F.concat(F.lit("{broken "), "p_name"))
    path = f"{_run_folder(spark)}/lines"
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    good, bad = files.split_rejects(files.read_tolerant(spark, path, "id long, p_name string"))
    counts = good.select(F.lit(1).alias("g"), F.lit(0).alias("b")).unionByName(bad.select(F.lit(0).alias("g"), F.lit(1).alias("b")))
    return counts.agg(F.sum("g").alias("good"), F.sum("b").alias("rejected"))


@query("""SELECT CAST(user_id AS VARCHAR) AS id, event_type AS last_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1""")
def latest_snapshot_per_key(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("last_type"), "event_id",
                                          F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("file_name"))
    return files.latest_per_key(e).select("id", "last_type", "event_id")


@query(with_ctes("SELECT career_id, count(*) AS n FROM po WHERE region = 'ASIA' GROUP BY career_id", "po"))
def partitioned_market_scan(spark, sf):
    counts = postings(spark, sf).groupBy("career_id", "region").agg(F.count(F.lit(1)).alias("n"))
    base = _run_folder(spark)
    files.write_market({"demand": counts}, base)
    return files.read_market(spark, base, "demand", "ASIA").select("career_id", "n")


@query("""SELECT url FROM (SELECT url, min(page_id) AS p FROM pages WHERE contains(url, 'example.com') GROUP BY url)""")
def sitemap_inventory(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.replace("url", F.lit("&"), F.lit("&amp;")).alias("url"))
    xml = F.concat(F.lit('<urlset xmlns="http://s.org/x"><url><loc> '), "url", F.lit(" </loc></url></urlset>"))
    maps = rows.select(F.col("page_id").alias("seq"), xml.alias("xml"))
    return page_source.sitemap_urls(maps, lambda u: u.contains("example.com")).select("url")


@query("""SELECT page_id, url FROM pages WHERE page_id > (SELECT max(page_id) FROM pages WHERE contains(url, '/fr/')) ORDER BY page_id""")
def resumed_inventory(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url")
    inventory = rows.select(F.col("page_id").alias("pos"), "url", "page_id")
    done = rows.where(F.col("url").contains("/fr/")).select(F.concat(F.lit("x"), "page_id").alias("id"), "url")
    return page_source.remaining_urls(inventory, done, "web").select("page_id", "url")


@query("""SELECT CAST(page_id AS VARCHAR) AS page, upper(left(url, 4)) AS title FROM pages WHERE contains(url, '/en/')""")
def embedded_job_pages(spark, sf):
    """Pages with an embedded job description written from the page's own columns."""
    rows = table(spark, sf, "pages")
    job = F.to_json(F.struct(
        F.lit("JobPosting").alias("@type"), F.upper(F.substring("url", 1, 4)).alias("title"), F.struct(F.col("page_id").cast("string").alias("name")).alias("hiringOrganization"),
        F.col("html").alias("description"), F.when(F.col("url").contains("/en/"), "2030-01-01").otherwise("2020-01-01").alias("validThrough")))
    # A closing script tag inside JSON text is written with an escaped slash.
    safe = F.replace(job, F.lit("</"), F.lit("<\\/"))
    html = F.concat(F.lit('<html><script type="application/ld+json">{"@graph":[{"x":1},'), safe, F.lit("]}</script></html>"))
    found = page_source.jsonld_postings(rows.select("url", html.alias("html")), "web", F.lit("2025-01-01"), F.lit("2025-01-01"))
    return found.select(F.col("company").alias("page"), "title")


# ---------------------------------------------------------------- streaming


def _drain(stream, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    run = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()


CRAWLED = "2030-01-01"


def _demand(spark, sf, parts, deadlines=False):
    """Orders as a stream of files, one batch each: those of each condition in ``parts``, then a flush of all shards.

    The stream goes on from its checkpoint after each part and takes all files written since, so every part is written
    and read by many tasks.
    Event times are resolved in the stream from the date as written; with ``deadlines``, that of a pending order is one.
    """
    base = _run_folder(spark)
    shard = F.col("o_orderkey") % 4
    written = F.date_format("o_orderdate", "dd/MM/yyyy")
    raw = F.when((F.col("o_orderstatus") == "P") & F.lit(deadlines), F.concat(F.lit("Hạn nộp: "), written)).otherwise(written)
    rows = table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("ordered"), raw.alias("posted_date_raw"), F.col("o_orderpriority").alias("career_id"), F.col("o_orderstatus").alias("region"), shard.alias("shard"))
    keyed = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("career_id"), F.col("o_orderstatus").alias("region"), shard.alias("shard")).distinct()
    schema = "posted_date_raw string, career_id string, region string, shard long, flush boolean"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (*parts, None):
            own = rows.where(part).drop("ordered").withColumn("flush", F.lit(False)) if part else keyed.select(F.lit(None).cast("string").alias("posted_date_raw"), "*", F.lit(True).alias("flush"))
            own.write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema(schema).parquet(f"{base}/in").withColumn("crawled_at", F.lit(CRAWLED).cast("timestamp"))
            stream = market_stream.resolved_event_time(stream, F.lit(CRAWLED).cast("timestamp"))
            counts = market_stream.daily_demand(stream, "7 days", F.col("shard"))
            run = counts.writeStream.foreachBatch(market_stream.write_demand(f"{base}/main", f"{base}/late")).option("checkpointLocation", f"{base}/state")
            run = run.outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
            if run.exception() is not None:
                raise run.exception()
    finally:
        spark.conf.set(provider, before)
    return base


@query("""WITH k AS (SELECT *, CAST(o_orderdate AS DATE) AS day, max(o_orderdate) OVER (PARTITION BY o_orderpriority, o_orderstatus, o_orderkey % 4) AS clock FROM orders)
    SELECT CAST(day AS VARCHAR) AS day, o_orderpriority AS career_id, o_orderstatus AS region, count(*) AS n, bool_or(day >= CAST(clock - INTERVAL 7 DAY AS DATE)) AS open FROM k GROUP BY ALL""")
def streamed_daily_demand(spark, sf):
    """Every day of a file stream that arrives in two halves: closed days, and those still open, flushed and marked."""
    years = table(spark, sf, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b")).first()
    middle = (years.a + years.b) // 2
    base = _demand(spark, sf, [f"year(ordered) <= {middle}", f"year(ordered) > {middle}"])
    return market_stream.merged_demand(spark, f"{base}/main").select(F.col("day").cast("string").alias("day"), "career_id", "region", "n", "open")


@query(f"""WITH o AS (SELECT *, o_orderkey % 4 AS s, month(o_orderdate) > 3 AS early, CASE WHEN o_orderstatus = 'P' THEN DATE '{CRAWLED}' ELSE CAST(o_orderdate AS DATE) END AS day FROM orders),
    c AS (SELECT o_orderpriority, o_orderstatus, s, max(day) AS clock FROM o WHERE early GROUP BY ALL)
    SELECT CAST(day AS VARCHAR) AS day, o_orderpriority AS career_id, o_orderstatus AS region,
      CASE WHEN NOT early AND day < clock - INTERVAL 7 DAY THEN 'late' ELSE 'counted' END AS side, count(*) AS n FROM o LEFT JOIN c USING (o_orderpriority, o_orderstatus, s) GROUP BY ALL""")
def streamed_late_rows(spark, sf):
    """The first quarter of every year arrives after all else: what is late by then stands in the side table.

    Deadlines count for the day of the crawl, so they are never late.
    """
    base = _demand(spark, sf, ["month(ordered) > 3", "month(ordered) <= 3"], deadlines=True)
    counted = market_stream.merged_demand(spark, f"{base}/main").select("day", "career_id", "region", F.lit("counted").alias("side"), "n")
    late = spark.read.option("basePath", f"{base}/late").parquet(f"{base}/late/part=*").groupBy(F.to_date("event_time").alias("day"), "career_id", "region").agg(F.count("*").alias("n"))
    return counted.unionByName(late.select("day", "career_id", "region", F.lit("late").alias("side"), "n")).withColumn("day", F.col("day").cast("string"))


@query("""SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events""")
def streamed_first_arrivals(spark, sf):
    base = _run_folder(spark)
    table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), "ts").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("id string, ts timestamp_ntz").parquet(f"{base}/in")
    _drain(market_stream.new_postings(stream, F.col("ts"), "60 days"), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("id")


@query(with_ctes("SELECT career_id, day, n, demand_90d FROM (SELECT career_id, CAST(day AS VARCHAR) AS day, n, CAST(sum(n) OVER (PARTITION BY career_id ORDER BY day RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS demand_90d FROM (SELECT o_orderpriority AS career_id, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL))"))
def rolling_demand_from_daily_counts(spark, sf):
    daily = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("career_id"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return market.moving_demand(daily).select("career_id", F.col("day").cast("string").alias("day"), "n", "demand_90d")


@query()
def streamed_session_profiles(spark, sf):
    """The stateful stream over all conversations; it must agree with the batch fold."""
    from jobatlas.streaming.sessions import session_profiles

    base = _run_folder(spark)
    events = conversation_turns(spark, sf).withColumn("patch", F.lit(None).cast("string")).withColumn("erase", F.lit(False))
    # One file holds whole sessions, so that their order does not depend on the order of files.
    events.repartition("session_id").write.parquet(f"{base}/in")
    # A session is in one file, so a micro-batch holds no more of it with more files; each core gets some of them.
    # The session's own provider comes back afterwards.
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4 * spark.sparkContext.defaultParallelism).parquet(f"{base}/in")
        _drain(session_profiles(stream, ttl_ms=None), f"{base}/out", f"{base}/state")
    finally:
        spark.conf.set(provider, before)
    last = sessions.latest_profiles(spark.read.parquet(f"{base}/out"))
    return last.select("session_id", "turn", "phase", "done", "completeness")
