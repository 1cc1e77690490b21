"""Incremental ingest and event-time demand on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from jobatlas.functions.parsing import parse_posted_date
from jobatlas.operators.incremental import split_reusable


def new_postings(stream: DataFrame, event_time: Column, delay: str = "7 days") -> DataFrame:
    """First arrival of each id within the watermark."""
    timed = stream.withColumn("event_time", event_time.cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["id"])


def resolved_event_time(stream: DataFrame, as_of: Column) -> DataFrame:
    """Posting dates resolved before any watermark: deadlines and future dates clamp to the crawl date."""
    day = parse_posted_date(F.col("posted_date_raw"), F.col("crawled_at"), as_of)
    return stream.withColumn("posted_date", day).withColumn("event_time", day.cast("timestamp"))


def split_late(stream: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """``(on_time, late)``: late rows go to a side output instead of vanishing."""
    late = F.col("event_time") < cutoff
    return stream.where(~late), stream.where(late)


DEMAND = "kind string, day date, career_id string, region string, shard int, n long, event_time timestamp"


class OpenDays(StatefulProcessor):
    """Daily counts of one career, region and shard, with a clock of its own.

    The clock is the latest event time of earlier micro-batches.  A row older than the clock less the delay is late: it
    leaves as it is, so nothing vanishes.  Others count for their day.  A day leaves, closed, when the clock less the
    delay has passed its end.  A row with ``flush`` makes the open days leave as they stand, marked open; they stay.
    """

    def __init__(self, delay: str) -> None:
        self.delay = pd.Timedelta(delay)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "at timestamp")
        self.days = handle.getMapState("days", "day date", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        career, region, shard = key
        before = pd.Timestamp(self.clock.get()[0]) if self.clock.exists() else None
        latest, flush = before, False
        known = {day[0]: n[0] for day, n in self.days.iterator()}
        days = dict(known)
        for batch in rows:
            flush = flush or bool(batch["flush"].any())
            batch = batch[~batch["flush"].astype(bool) & batch["event_time"].notna()]
            if batch.empty:
                continue
            late = (batch["event_time"] < before - self.delay).to_numpy() if before is not None else np.zeros(len(batch), bool)
            # Dates are made once for each distinct day.
            place, distinct = pd.factorize(batch["event_time"].dt.normalize())
            dates = np.array([at.date() for at in distinct], object)
            if late.any():
                own = batch.loc[late, "event_time"]
                yield pd.DataFrame({"kind": "late", "day": dates[place[late]], "career_id": career, "region": region, "shard": shard, "n": 1, "event_time": own})
            for day, n in zip(dates, np.bincount(place[~late], minlength=len(dates)).tolist()):
                if n:
                    days[day] = days.get(day, 0) + n
            newest = batch["event_time"].max()
            latest = newest if latest is None else max(latest, newest)
        if latest is None:
            return
        self.clock.update((latest.to_pydatetime(),))
        done = (latest - self.delay).date()
        # Only open days are kept; those that open and close within one batch never reach the state.
        for day, n in days.items():
            if day < done and day in known:
                self.days.removeKey((day,))
            elif day >= done and known.get(day) != n:
                self.days.updateValue((day,), (n,))
        out = [("closed" if day < done else "open", day, n) for day, n in sorted(days.items()) if day < done or flush]
        if out:
            yield pd.DataFrame([(kind, day, career, region, shard, n, pd.NaT) for kind, day, n in out], columns=["kind", "day", "career_id", "region", "shard", "n", "event_time"])

    def close(self) -> None:
        pass


def daily_demand(stream: DataFrame, delay: str = "7 days", shard: Column | None = None) -> DataFrame:
    """Tumbling daily counts per career and region, and late rows, in one output (DEMAND).

    ``stream`` has ``event_time, career_id, region`` and ``flush`` (true in rows that only ask for the open days; one for
    each shard that is asked).  ``merged_demand`` adds up the shards.  Rows without an event time count nowhere.  Needs
    the RocksDB state store provider.

    Ninety-day figures are then rolling sums over these few counts
    (``operators.market.moving_demand``) instead of ninety overlapping windows per row.
    """
    part = F.lit(0) if shard is None else shard
    rows = stream.select("event_time", "career_id", "region", F.coalesce("flush", F.lit(False)).alias("flush"), part.cast("int").alias("shard"))
    return rows.groupBy("career_id", "region", "shard").transformWithStateInPandas(
        statefulProcessor=OpenDays(delay), outputStructType=DEMAND, outputMode="Append", timeMode="None")


def write_demand(main: str, late: str):
    """``foreachBatch`` function: one stream, two tables; a retried batch overwrites its own folders."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.where("kind <> 'late'").drop("event_time").withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{main}/part={batch_id}")
        batch.where("kind = 'late'").select("event_time", "career_id", "region").write.mode("overwrite").parquet(f"{late}/part={batch_id}")
        batch.unpersist()

    return run


def merged_demand(spark: SparkSession, main: str) -> DataFrame:
    """``day, career_id, region, n, open`` out of the main table: the newest count of each shard, added up.

    A shard closes a day once; what it flushed of the day before is older.
    """
    rows = spark.read.option("basePath", main).parquet(f"{main}/part=*")
    newest = rows.groupBy("day", "career_id", "region", "shard").agg(F.max_by(F.struct("n", "kind"), "batch").alias("x"))
    return newest.groupBy("day", "career_id", "region").agg(F.sum("x.n").alias("n"), F.max(F.col("x.kind") == "open").alias("open"))


def current_results(spark: SparkSession, results_path: str, key: str = "id", before: int | None = None) -> DataFrame:
    """The newest row of each key among the batches written so far (those before ``before``, if given)."""
    rows = spark.read.option("basePath", results_path).parquet(f"{results_path}/batch=*")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    body = F.struct(*[F.col(c) for c in rows.columns if c != key])
    newest = rows.groupBy(key).agg(F.max_by(body, "batch").alias("_b"))
    return newest.select(key, *[F.col(f"_b.{c}").alias(c) for c in rows.columns if c != key])


def enrich_changed(results_path: str, stamps: list[str], compute: Callable[[DataFrame], DataFrame], key: str = "id"):
    """``foreachBatch`` function that recomputes only rows whose stamps differ from their newest result.

    Each batch writes its own folder, so a retried batch overwrites itself and stays exact; ``current_results`` reads
    one row a key, so an older version of a changed row is no longer seen.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        stale = batch
        if batch_id > 0:
            _, stale = split_reusable(batch, current_results(batch.sparkSession, results_path, key, batch_id), stamps, key)
        compute(stale).write.mode("overwrite").parquet(f"{results_path}/batch={batch_id}")

    return run
