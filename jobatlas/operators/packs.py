"""Packs: a small dimension as a few rows that each hold an array of its items.

Comparing every fact row with every dimension item is then an equi-join on the pack
number followed by array functions inside the row, so the facts are neither multiplied
by the dimension nor shuffled per item.  The optimizer broadcasts the packs while they
are small; a dimension of any size simply becomes more packs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACK_SIZE = 512


def pack(dim: DataFrame, item: Column, size: int = PACK_SIZE) -> tuple[DataFrame, int]:
    """``(packs, n_packs)`` where packs holds ``pack, items``."""
    n_packs = max(1, -(-dim.count() // size))
    items = dim.select(item.alias("item"))
    number = F.pmod(F.xxhash64("item"), F.lit(n_packs)).cast("int")
    packs = items.groupBy(number.alias("pack")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    return packs, n_packs


def meet(facts: DataFrame, packs: DataFrame, n_packs: int) -> DataFrame:
    """Each fact once per pack, with the pack's ``items``."""
    numbered = facts.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))))
    return numbered.join(packs, "pack").drop("pack")
