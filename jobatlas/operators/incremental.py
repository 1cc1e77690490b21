"""Reuse of earlier results: resume joins, content-keyed result tables and external results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jobatlas.functions.privacy import is_denied_skill
from jobatlas.functions.text import norm_match, squeeze
from jobatlas.operators.matching import resolve_labels

LOW_SIGNAL_THRESHOLD = 3
MAX_BATCH = 10


def split_reusable(current: DataFrame, previous: DataFrame, stamps: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """``(reused, stale)``: rows of ``previous`` whose key and every stamp still match, and the current rows left to do."""
    marks = current.select(key, *stamps)
    reused = previous.join(marks, [key, *stamps], "left_semi")
    stale = current.join(previous.select(key, *stamps), [key, *stamps], "left_anti")
    return reused, stale


def resume(current: DataFrame, previous: DataFrame, stamps: list[str], compute: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """Reused rows plus the recomputed rest, marked by ``resumed``."""
    reused, stale = split_reusable(current, previous, stamps, key)
    fresh = compute(stale).withColumn("resumed", F.lit(False))
    return reused.withColumn("resumed", F.lit(True)).unionByName(fresh)


def with_cached(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows with the cached ``cached_skills, cached_new_skills`` of their content key, null on a miss."""
    known = cache.select(key, F.col("skills").alias("cached_skills"), F.col("new_skills").alias("cached_new_skills"))
    return rows.join(known, key, "left")


def merge_cache(cache: DataFrame, fresh: DataFrame, key: str = "cache_key") -> DataFrame:
    """New keys replace old ones."""
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*cache.columns))


def low_signal(skills: Column, threshold: int = LOW_SIGNAL_THRESHOLD) -> Column:
    return F.size(F.coalesce(skills, F.array().cast("array<string>"))) < threshold


def extraction_requests(rows: DataFrame, key: str = "id", batch_size: int = MAX_BATCH, max_description: int | None = None) -> DataFrame:
    """Bounded requests for an external extractor: ``batch_id, posting_id, title, description``.

    Postings are spread over buckets of about a thousand by a stable hash and numbered
    inside the bucket, so no batch is larger than ``batch_size``.  Descriptions go whole, unless the extractor's own
    limit is given as ``max_description`` characters.
    """
    if not 1 <= batch_size <= MAX_BATCH:
        raise ValueError(f"batch_size must be between 1 and {MAX_BATCH}")
    description = F.col("description") if max_description is None else F.left("description", F.lit(max_description))
    n_buckets = max(1, -(-rows.count() // 1000))
    numbered = rows.withColumn("_b", F.pmod(F.xxhash64(F.col(key)), F.lit(n_buckets))).withColumn(
        "_i", F.row_number().over(W.partitionBy("_b").orderBy(key)) - 1
    )
    return numbered.select(
        (F.col("_b") * 1_000_000 + F.floor(F.col("_i") / batch_size)).alias("batch_id"),
        F.col(key).alias("posting_id"), "title", description.alias("description"),
    )


def run_extractor(requests: DataFrame, extractor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Pluggable batch function over Arrow batches; its rows are only trusted after ``accept_external``."""
    schema = "batch_id bigint, posting_id string, skills array<string>, new_skills array<string>"
    return requests.mapInPandas(extractor, schema)


def accept_external(requests: DataFrame, results: DataFrame, aliases: DataFrame) -> DataFrame:
    """Accepted results per posting: ``posting_id, batch_ok, skills, new_skills``.

    A batch counts only when its ids equal the requested ids, none is repeated and every
    skill resolves in the taxonomy; otherwise all of its postings fall back.
    """
    asked = requests.select("batch_id", "posting_id").withColumn("_asked", F.lit(True))
    counted = results.groupBy("batch_id", "posting_id").agg(F.count(F.lit(1)).alias("_n"))
    ids = asked.join(counted, ["batch_id", "posting_id"], "full_outer").select(
        "batch_id", (F.col("_asked").isNull() | F.coalesce(F.col("_n") != 1, F.lit(True))).alias("_bad")
    )
    labels = results.select("batch_id", "posting_id", F.explode(F.concat(
        F.transform("skills", lambda s: F.struct(s.alias("label"), F.lit(False).alias("is_new"))),
        F.transform("new_skills", lambda s: F.struct(squeeze(s).alias("label"), F.lit(True).alias("is_new"))),
    )).alias("l")).select("batch_id", "posting_id", "l.label", "l.is_new")
    resolved = resolve_labels(labels, aliases).withColumn("norm", norm_match(F.col("label")))
    unknown = resolved.select("batch_id", (~F.col("is_new") & F.col("skill").isNull()).alias("_bad"))
    batches = ids.unionByName(unknown).groupBy("batch_id").agg((~F.max("_bad")).alias("batch_ok"))
    usable = resolved.where(F.col("skill").isNotNull() | (F.col("is_new") & (F.col("norm") != "") & ~is_denied_skill(F.col("norm"))))
    per_label = usable.groupBy("posting_id", "skill", "taxonomy_order", F.when(F.col("skill").isNull(), F.col("norm")).alias("norm")).agg(
        F.min("label").alias("label")
    )
    lists = per_label.groupBy("posting_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("skill").isNotNull(), F.struct("taxonomy_order", "skill")))).alias("_s"),
        F.array_sort(F.collect_list(F.when(F.col("skill").isNull(), F.struct("norm", "label")))).alias("_n"),
    )
    empty = F.array().cast("array<string>")
    ok = F.coalesce("batch_ok", F.lit(False))
    return asked.drop("_asked").join(batches, "batch_id", "left").join(lists, "posting_id", "left").select(
        "posting_id", ok.alias("batch_ok"),
        F.when(ok, F.coalesce(F.transform("_s", lambda s: s.skill), empty)).otherwise(empty).alias("skills"),
        F.when(ok, F.coalesce(F.transform("_n", lambda s: s.label), empty)).otherwise(empty).alias("new_skills"),
    )


def union_in_order(left: Column, right: Column, order: Column) -> Column:
    """Set union of two label lists in the order of the ``order`` array."""
    both = F.array_union(left, right)
    return F.filter(order, lambda s: F.array_contains(both, s))
