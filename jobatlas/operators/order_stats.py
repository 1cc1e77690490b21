"""Exact order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jobatlas.session import cut_lineage

#: Bits of the running number within a partition in ``monotonically_increasing_id``.
_LOCAL_BITS = 33


def running_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``*keys, _v, _c, _cum, _n``: distinct values of each group with their count, running count and the group's total.

    Values are counted before anything is ordered.  The counts are sorted over range partitions of (keys, value); a
    value's running count is that within its partition plus the sums of the group's earlier partitions, of which a
    group has no more than there are partitions.  So a group of any size is spread over tasks, by one path.  Null values
    are left out; null keys are a group; ties are one value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    order = [*keys, "_v"]
    ordered = cut_lineage(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    parted = ordered.withColumn("_part", F.shiftright("_at", _LOCAL_BITS))
    sums = parted.groupBy(*keys, "_part").agg(F.sum("_c").alias("_m"))
    group = W.partitionBy(*keys)
    earlier = F.coalesce(F.sum("_m").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), earlier.alias("_before"), F.sum("_m").over(group).alias("_n"))
    own = F.sum("_c").over(W.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    ranked = parted.withColumn("_own", own)
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(offsets, same).select(*keys, "_v", "_c", (F.col("_before") + F.col("_own")).alias("_cum"), "_n")


def value_at(rank):
    """Aggregate over ``running_counts``: the value of this rank, counted from one."""
    return F.min(F.when(F.col("_cum") >= rank, F.col("_v")))
