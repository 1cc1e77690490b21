import datetime as dt
import pathlib
import random

import numpy as np
from pyspark.sql import functions as F

from jobatlas.catalog import base, session_queries
from jobatlas.operators import market
from jobatlas.streaming import market as market_stream

END = dt.date(2026, 7, 1)
SCHEMA = ("id string, source string, career_id string, region string, posted_date date, salary_min_trieu double, "
          "salary_max_trieu double, seniority string, skills array<string>")


def rows(spark, n, career="dev"):
    ages = [80, 70, 60, 50, 45, 20, 15, 12, 10, 8, 5, 1][:n]
    data = [(f"{career}{i}", "s1" if i % 2 else "s2", career, "hanoi" if i < 8 else "", END - dt.timedelta(days=a), float(i + 1), None,
             "entry" if i % 4 == 0 else "mid", ["Python"] + (["SQL"] if i % 3 == 0 else [])) for i, a in enumerate(ages)]
    return spark.createDataFrame(data, SCHEMA)


def test_confident_career(spark):
    titles = spark.createDataFrame([("dev", "Developer")], "career_id string, title string")
    stats = {r["region"]: r for r in market.career_stats(rows(spark, 12), titles, END).collect()}
    r = stats["all"]
    assert (r["demand_count_90d"], r["entry_level_count_90d"], r["salary_p50_trieu"], r["trend_pct"]) == (12, 3, 6.5, 40.0)
    assert not r["low_confidence"] and r["top_skills"] == ["Python", "SQL"] and r["top_regions"] == ["hanoi", "other"]
    assert r["source_counts"] == {"s1": 6, "s2": 6} and stats["other"]["demand_count_90d"] == 4


def test_small_career_stays_unknown(spark):
    titles = spark.createDataFrame([("dev", "Developer")], "career_id string, title string")
    r = market.career_stats(rows(spark, 4), titles, END).where("region = 'all'").first()
    assert r["salary_p50_trieu"] is None and r["trend_pct"] is None and r["low_confidence"]


def test_unknown_career_fails(spark):
    titles = spark.createDataFrame([("other", "Other")], "career_id string, title string")
    try:
        market.career_stats(rows(spark, 4), titles, END).collect()
    except Exception as e:
        assert "absent from the base" in str(e)
    else:
        raise AssertionError("must fail")


def test_percentiles_match_interpolation_on_a_hot_group(spark):
    rng = random.Random(5)
    data = [("hot", rng.choice([rng.lognormvariate(2, 1), 7.5])) for _ in range(30000)] + [("cold", float(i)) for i in range(7)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r for r in market.exact_percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.95}).collect()}
    for g in ("hot", "cold"):
        vals = [v for k, v in data if k == g]
        assert [got[g]["a"], got[g]["b"], got[g]["c"]] == [round(float(np.percentile(vals, q)), 2) for q in (25, 50, 95)]


def test_lookup_falls_back(spark):
    titles = spark.createDataFrame([("dev", "Developer")], "career_id string, title string")
    stats = market.career_stats(rows(spark, 12), titles, END)
    asked = spark.createDataFrame([("dev", "hanoi"), ("dev", "hcm"), ("none", "hcm")], "career_id string, region string")
    out = {(r["career_id"], r["region"]): r for r in market.career_market(asked, stats, "s").collect()}
    assert out["dev", "hanoi"]["market_scope"] == "region" and out["dev", "hanoi"]["demand_count_90d"] == 8
    assert out["dev", "hcm"]["market_scope"] == "national" and "toàn quốc" in out["dev", "hcm"]["source_note"]
    assert out["none", "hcm"]["demand_count_90d"] == 0 and out["none", "hcm"]["low_confidence"]


def test_skill_gap_score(spark):
    got = {(r["skill"], r["region"]): r for r in market.skill_stats(rows(spark, 12), END).collect()}
    assert got["Python", "all"]["gap_score"] == 1.0 and got["SQL", "all"]["gap_score"] == round(4 / 12, 4)
    assert got["Python", "all"]["related_careers"] == ["dev"]


def test_more_lines_are_dealt_over_more_tasks(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "b", "n", "t")], "p_partkey long, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(400).select((F.col("id") % 50).alias("l_orderkey"), F.lit(1).cast("long").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"),
                            F.col("id").cast("int").alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(base, "LINES_A_TASK", 20)
    orders = base.order_lines(spark, str(tmp_path))
    assert orders.rdd.getNumPartitions() == 20 and orders.count() == 50


def test_late_and_counted_days_of_large_batches(spark, tmp_path):
    """A part of the stream is written by several tasks and still is one batch."""
    days = spark.range(0, 4000, 1, 4).select(
        F.col("id").alias("o_orderkey"), F.expr("timestamp'1995-01-01' + make_dt_interval(cast(id % 700 as int))").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"), F.lit("F").alias("o_orderstatus"))
    days.write.parquet(f"{tmp_path}/orders.parquet")
    folder = session_queries._demand(spark, str(tmp_path), ["month(ordered) > 3", "month(ordered) <= 3"]).removeprefix("file:")
    assert len(list(pathlib.Path(folder, "in").glob("*.parquet"))) >= 8
    assert len(list(pathlib.Path(folder, "state", "commits").glob("[0-9]*"))) == 3
    late = spark.read.parquet(f"{folder}/late").count()
    counted = market_stream.merged_demand(spark, f"{folder}/main").agg(F.sum("n")).first()[0]
    assert late > 0 and late + counted == 4000
