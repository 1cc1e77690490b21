"""Order statistics and event-time demand where one group holds much of the table."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from jobatlas.functions.text import nfc
from jobatlas.operators import evaluation, market
from jobatlas.operators.order_stats import running_counts
from jobatlas.streaming import market as stream


def values(rng):
    """A hot group with all distinct values, one of ties, one of a single value, a null key and null values."""
    rows = [("hot", rng.random() * 1000) for _ in range(4000)] + [("ties", float(rng.randint(1, 3))) for _ in range(500)] + [("one", 7.0)]
    rows += [(None, float(i)) for i in range(11)] + [("hot", None), ("empty", None)]
    rng.shuffle(rows)
    return rows


def test_running_counts_spread_a_hot_group(spark):
    rows = values(random.Random(1))
    ranked = running_counts(spark.createDataFrame(rows, "g string, v double").repartition(8), ["g"], "v")
    want = defaultdict(list)
    for g, v in rows:
        if v is not None:
            want[g].append(v)
    got = ranked.collect()
    assert len(got) == sum(len(set(v)) for v in want.values())
    for r in got:
        own = want[r["g"]]
        assert (r["_c"], r["_cum"], r["_n"]) == (own.count(r["_v"]), sum(x <= r["_v"] for x in own), len(own))


def test_percentiles_and_nearest_ranks(spark):
    rows = values(random.Random(2))
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    own = {g: sorted(v for k, v in rows if k == g and v is not None) for g in ("hot", "ties", "one", None)}
    got = {r["g"]: r for r in market.exact_percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 1.0}).collect()}
    near = {r["g"]: r for r in evaluation.nearest_rank(df, ["g"], "v").collect()}
    assert set(got) == set(near) == set(own)
    for g, v in own.items():
        for name, q in (("a", 0.25), ("b", 0.5), ("c", 1.0)):
            at = (len(v) - 1) * q
            low = math.floor(at)
            high = min(low + 1, len(v) - 1)
            assert abs(got[g][name] - (v[low] + (v[high] - v[low]) * (at - low))) < 0.006
        assert near[g]["p95"] == v[math.ceil(len(v) * 0.95) - 1] and near[g]["n"] == len(v)
        assert abs(near[g]["median"] - (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2) < 1e-3


def test_no_values_give_no_rows(spark):
    none = spark.createDataFrame([("a", None)], "g string, v double")
    assert market.exact_percentiles(none, ["g"], "v", {"a": 0.5}).count() == 0 == evaluation.nearest_rank(none, ["g"], "v").count()


def test_composition_of_other_scripts(spark):
    pairs = [("é", "é"), ("й", "й"), ("ऩ", "ऩ"), ("が", "が"), ("ố", "ố"), ("ά", "ά"), ("plain", "plain"), (None, None)]
    df = spark.createDataFrame(list(enumerate(p[0] for p in pairs)), "id int, t string").select("id", nfc(F.col("t")).alias("t"))
    assert [r["t"] for r in df.orderBy("id").collect()] == [p[1] for p in pairs]


def test_demand_stream_keeps_late_rows_and_flushes_open_days(spark, tmp_path):
    """One career holds most rows; the second batch brings late ones, the third flushes, the fourth closes more."""
    rng, day = random.Random(5), dt.datetime(2024, 1, 1)
    rows = lambda lo, hi, n: [(day + dt.timedelta(days=rng.randint(lo, hi), hours=rng.randint(0, 23)), rng.choice(["a", "a", "a", "b"]), "r", i % 3, False) for i in range(n)]
    flush = [(None, c, "r", s, True) for c in "ab" for s in range(3)]
    batches = [rows(20, 40, 300), rows(0, 45, 300), flush, rows(60, 90, 200), flush]
    schema = "event_time timestamp, career_id string, region string, shard int, flush boolean"
    base = str(tmp_path)
    late, counted, clock = Counter(), Counter(), {}
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(schema).parquet(f"{base}/in")
        run = (stream.daily_demand(source, "7 days", F.col("shard")).writeStream.foreachBatch(stream.write_demand(f"{base}/main", f"{base}/late"))
               .option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start())
        assert run.awaitTermination(120) and run.exception() is None
        before = dict(clock)
        for at, career, _, shard, is_flush in batch:
            if is_flush:
                continue
            key = (career, shard)
            if key in before and at < before[key] - dt.timedelta(days=7):
                late[at.date(), career] += 1
            else:
                counted[at.date(), career] += 1
            clock[key] = max(clock.get(key, at), at)
        if i in (2, 4):
            merged = stream.merged_demand(spark, f"{base}/main").collect()
            assert {(r["day"], r["career_id"]): r["n"] for r in merged} == dict(counted)
            assert any(r["open"] for r in merged) and not all(r["open"] for r in merged)
    aside = spark.read.parquet(f"{base}/late/part=*").groupBy(F.to_date("event_time").alias("d"), "career_id").count().collect()
    assert {(r["d"], r["career_id"]): r["count"] for r in aside} == dict(late) and late
