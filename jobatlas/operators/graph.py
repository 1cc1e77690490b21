"""Connected components by alternating large and small stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.session import cut_lineage


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = _turned(edges)
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    ends = F.explode(F.array("a", "b")).alias("a")
    return down.join(low, "a").select(ends, F.col("low").alias("b")).where("a != b").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every id has one smaller neighbour at most, and none if it is one itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("n")), F.struct(F.col("b").alias("id"), F.lit(0).alias("n")))).alias("x"))
    counts = ends.groupBy("x.id").agg(F.sum("x.n").alias("up"), F.count_if(F.col("x.n") == 0).alias("down"))
    return counts.where("up > 1 or (up > 0 and down > 0)").agg(F.count("*")).first()[0] == 0


def component_stars(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id of the written table ``links`` (a, b) that is not the smallest of its component.

    Rows with a null or with a = b name no link and are left out.  Stars move edges to smaller neighbours until only
    stars are left; the edge table never grows.  The result may read ``links`` itself.
    """
    edges = _turned(links.where("a != b"))
    while not _all_stars(edges):
        edges = cut_lineage(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id of ``links`` (a, b); the component is its smallest id.

    Repeated links count once; an empty table gives an empty table.
    """
    leaves = component_stars(cut_lineage(links.select("a", "b").distinct()))
    return leaves.unionByName(leaves.select(F.col("component").alias("id"), "component").distinct())
