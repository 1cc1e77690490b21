"""Seeded stratified and balanced samples.  The per-group limits are the feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def seeded_order(key: Column, seed: int = 42) -> Column:
    """Reproducible pseudo-random order of a key, the same in any engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def stratified_sample(df: DataFrame, stratum: str, key: str = "id", size: int = 10, seed: int = 42) -> DataFrame:
    """At most ``size`` rows per stratum; ranks are pruned before the shuffle, so a hot stratum stays cheap."""
    order = W.partitionBy(stratum).orderBy(seeded_order(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size).drop("_r")


def balanced_sample(df: DataFrame, family: str, region: str, families: list[str], key: str = "id", per_family: int = 20,
                    total: int = 100, seed: int = 42) -> DataFrame:
    """``per_family`` rows of each family, drawn round-robin over its regions, topped up to ``total``."""
    draw = seeded_order(F.col(key), seed)
    wanted = df.where(F.col(family).isin(*families)).withColumn("_draw", draw)
    inner = wanted.withColumn(
        "_turn", F.row_number().over(W.partitionBy(family, region).orderBy("_draw", key))
    ).where(F.col("_turn") <= per_family)
    chosen = inner.withColumn(
        "_pos", F.row_number().over(W.partitionBy(family).orderBy("_turn", region))
    ).where(F.col("_pos") <= per_family).drop("_turn", "_pos", "_draw")
    missing = total - chosen.count()
    if missing <= 0:
        return chosen
    rest = df.join(chosen.select(key), key, "left_anti").orderBy(draw, key).limit(missing)
    return chosen.unionByName(rest.select(*chosen.columns))
