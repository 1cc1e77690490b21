"""Near-duplicate removal: newest first, a posting goes when a kept one is close enough.

The rule is order dependent: keep a posting when no newer similar posting is kept.
Similarity is decided once per pair of distinct names.  Names fall into components, and
every component is swept once, newest first, in one sorted stream.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobatlas.functions.parsing import company_anchor, date_bucket
from jobatlas.functions.text import strip_space
from jobatlas.operators.graph import connected_components
from jobatlas.session import cut_lineage

THRESHOLD = 0.85
WINDOW_DAYS = 30

# Shared characters needed for the threshold, relative to the longer title; slightly
# below 0.85 / 1.15 so that rounding can only add candidates.
MIN_SHARE = 0.739
# Letters by falling selectivity; anything not listed is rarer still and sorts first.
COMMON_LETTERS = "zqjxwfvkpbyđsdmulrgocthian e"


def exact_key_dedupe(postings: DataFrame) -> DataFrame:
    """Newest posting of each exact (title, company, day); undated postings pass through.

    Copies are reduced map-side, so a text copied into a third of the table costs no
    more than any other.
    """
    keyed = _keyed(postings)
    dated = keyed.where(F.col("posted_date").isNotNull())
    newest = dated.groupBy("_title", "_company", "posted_date").agg(
        F.max(F.struct(F.coalesce(F.col("crawled_at").cast("string"), F.lit("")), F.col("id"))).alias("_top")
    )
    return newest.select("_title", "_company", "posted_date", F.col("_top.col1").alias("_order"), F.col("_top.id").alias("id"))


def _keyed(postings: DataFrame) -> DataFrame:
    return postings.select(
        "id", "crawled_at", F.col("posted_date").cast("date").alias("posted_date"),
        strip_space(F.lower(F.coalesce("title", F.lit("")))).alias("_title"),
        strip_space(F.lower(F.coalesce("company", F.lit("")))).alias("_company"),
    )


def with_blocks(nodes: DataFrame) -> DataFrame:
    """Add the company anchor and the thirty-day bucket duplicates must share or neighbour."""
    return nodes.withColumn("_anchor", company_anchor(F.col("_company"))).withColumn("_bucket", date_bucket(F.col("posted_date")))


def title_signatures(title: Column) -> Column:
    """Lossless blocking keys of a title.

    Titles above the threshold share at least ``MIN_SHARE`` of their characters, counted
    with repetition.  With all characters in one fixed order, the first
    ``length - needed + 2`` of both titles must then have two in common; each pair of
    those leading characters is a key.
    """
    chars = F.filter(F.split(title, ""), lambda c: c != "")
    tokens = F.array_sort(F.transform(
        chars,
        lambda c, i: F.struct(
            F.instr(F.lit(COMMON_LETTERS), c).alias("rank"),
            F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")).alias("t"),
        ),
    ))
    n = F.size(chars)
    needed = F.ceil(n * MIN_SHARE - 1e-9)
    lead = F.transform(F.slice(tokens, F.lit(1), (n - needed + 2).cast("int")), lambda s: s.t)
    pairs = F.flatten(F.transform(
        lead,
        lambda a, i: F.transform(F.slice(lead, i + 2, F.greatest(F.size(lead), F.lit(1))), lambda b: F.concat(a, F.lit("|"), b)),
    ))
    return F.when(n < 2, F.array(F.concat(F.lit("="), title))).otherwise(pairs)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _similar(title_a: pd.Series, company_a: pd.Series, title_b: pd.Series, company_b: pd.Series) -> pd.Series:
    """Ratio test in both directions; the ratio is not symmetric."""
    def close(a: str, b: str) -> bool:
        if a == b:
            return True
        m = SequenceMatcher(None, a, b)
        return m.real_quick_ratio() >= THRESHOLD and m.quick_ratio() >= THRESHOLD and m.ratio() >= THRESHOLD

    rows = zip(title_a, company_a, title_b, company_b)
    return pd.Series([[close(ta, tb) and close(ca, cb), close(tb, ta) and close(cb, ca)] for ta, ca, tb, cb in rows])


def similar_names(names: DataFrame) -> DataFrame:
    """Pairs of distinct (title, company) of one anchor that pass the ratio test, each with both directions.

    ``names`` has one row per ``_title, _company, _anchor``; the size of the posting table does not matter here.
    """
    keyed = names.withColumn("_sig", F.explode(title_signatures(F.col("_title")))).withColumn("_len", F.length("_title"))
    left = keyed.select("_anchor", "_sig", F.col("_title").alias("ta"), F.col("_company").alias("ca"), F.col("_len").alias("la"))
    right = keyed.select("_anchor", "_sig", F.col("_title").alias("tb"), F.col("_company").alias("cb"), F.col("_len").alias("lb"))
    sized = F.least("la", "lb") >= F.greatest("la", "lb") * MIN_SHARE
    before = F.struct("ta", "ca") < F.struct(F.col("tb").alias("ta"), F.col("cb").alias("ca"))
    candidates = left.join(right, ["_anchor", "_sig"]).where(before & sized).select("ta", "ca", "tb", "cb").distinct()
    tested = candidates.withColumn("_s", _similar("ta", "ca", "tb", "cb"))
    return tested.select("ta", "ca", "tb", "cb", F.col("_s")[0].alias("ab"), F.col("_s")[1].alias("ba")).where("ab or ba")


def name_table(nodes: DataFrame) -> DataFrame:
    """Distinct names of the nodes with their component and the names whose kept posting removes one of theirs.

    Rows ``_title, _company, _name, _component, _removers``; a name always removes its own older postings.
    """
    names = nodes.select("_title", "_company", "_anchor", "_name").distinct()
    pairs = similar_names(names).select(
        F.xxhash64("ta", "ca").alias("a"), F.xxhash64("tb", "cb").alias("b"), "ab", "ba",
    )
    pairs = cut_lineage(pairs)
    removers = pairs.where("ab").select(F.col("a").alias("_name"), F.col("b").alias("r")).unionByName(
        pairs.where("ba").select(F.col("b").alias("_name"), F.col("a").alias("r"))
    ).groupBy("_name").agg(F.array_sort(F.collect_set("r")).alias("_removers"))
    parts = connected_components(pairs).select(F.col("id").alias("_name"), F.col("component").alias("_component"))
    return names.join(parts, "_name", "left").join(removers, "_name", "left").select(
        "_title", "_company", "_name", F.coalesce("_component", "_name").alias("_component"), "_removers"
    )


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keep rows that arrive by component, newest first, unless a kept remover lies within the window.

    Only the kept days of the component at hand are held.
    """
    current, kept = None, {}
    for batch in batches:
        keep = []
        for component, name, day, removers in zip(batch["_component"], batch["_name"], batch["_day"], batch["_removers"], strict=True):
            if component != current:
                current, kept = component, {}
            free = True
            for other in (name, *(removers if removers is not None else ())):
                days = kept.get(other, ())
                at = bisect_left(days, day - WINDOW_DAYS)
                if at < len(days) and days[at] <= day + WINDOW_DAYS:
                    free = False
                    break
            if free:
                insort(kept.setdefault(name, []), day)
            keep.append(free)
        yield batch.loc[keep, ["_name", "_day"]]


def deduplicate_postings(postings: DataFrame) -> DataFrame:
    """Postings without near-duplicates; undated postings are never duplicates.

    A node is one (title, company, day) with its newest row, whatever the ids are, so repeated ids are handled like any
    others.  Nodes of one name component meet in one ordered pass; no rounds, no edges between postings.  Rows that tie
    in all of title, company, day, order and id count as one.
    """
    nodes = exact_key_dedupe(postings).withColumn("_name", F.xxhash64("_title", "_company"))
    nodes = cut_lineage(nodes.withColumn("_anchor", company_anchor(F.col("_company"))).withColumn("_day", F.datediff("posted_date", F.lit("1970-01-01").cast("date"))))
    names = name_table(nodes)
    rows = nodes.join(names.select("_title", "_company", "_component", "_removers"), ["_title", "_company"])
    newest = [F.desc("_order"), F.desc("id"), F.desc("_day"), F.desc("_title"), F.desc("_company")]
    kept = (
        rows.select("_component", "_name", "_day", "_removers", "_order", "id", "_title", "_company")
        .repartition("_component").sortWithinPartitions("_component", *newest)
        .mapInPandas(_sweep, "_name long, _day int")
    )
    survivors = nodes.join(kept, ["_name", "_day"], "left_semi").select(
        F.col("_title").alias("t"), F.col("_company").alias("c"), F.col("posted_date").alias("d"), F.col("_order").alias("o"), F.col("id").alias("i")
    )
    order = F.coalesce(F.col("crawled_at").cast("string"), F.lit(""))
    day = F.col("posted_date").cast("date")
    title, company = (strip_space(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in ("title", "company"))
    dated = postings.where(day.isNotNull()).withColumn("_t", title).withColumn("_c", company).withColumn("_d", day)
    met = dated.join(
        survivors,
        (F.col("_t") == F.col("t")) & (F.col("_c") == F.col("c")) & (F.col("_d") == F.col("d")) & (order == F.col("o")) & dated["id"].eqNullSafe(F.col("i")),
        "left_semi",
    ).dropDuplicates(["_t", "_c", "_d"])
    return met.select(*postings.columns).unionByName(postings.where(day.isNull()))
