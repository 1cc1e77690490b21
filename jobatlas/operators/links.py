"""Link cards: safe, distinct, titled links per subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jobatlas.functions.parsing import clean_text
from jobatlas.functions.privacy import is_safe_url, source_tier, url_host
from jobatlas.functions.text import fold_nodj, strip_space


def link_cards(links: DataFrame, subject: str, position: str = "position", limit: int = 5, tier=source_tier) -> DataFrame:
    """First ``limit`` usable links of each subject from ``subject, position, url, title, snippet``.

    The first row of a URL with a title wins; the limit is the size of a card block.
    """
    url = strip_space(F.col("url"))
    safe = links.where(is_safe_url(F.col("url"))).select(
        subject, position, url.alias("url"), url_host(url).alias("domain"),
        clean_text(F.col("title"), 180).alias("title"), clean_text(F.col("snippet"), 420).alias("snippet"),
    ).where(F.col("title") != "")
    first = safe.groupBy(subject, "url").agg(F.min_by(F.struct(position, "domain", "title", "snippet"), position).alias("c"))
    order = W.partitionBy(subject).orderBy(F.col("c")[position], "url")
    cards = first.withColumn("card", F.row_number().over(order)).where(F.col("card") <= limit)
    return cards.select(subject, "card", "url", "c.domain", "c.title", "c.snippet", tier(F.col("c.domain")).alias("source_tier"))


def is_relevant(career_title: Column, title: Column, snippet: Column) -> Column:
    """Any folded title word of three or more letters occurs in the card."""
    words = F.filter(F.split(F.replace(fold_nodj(career_title), F.lit("-"), F.lit(" ")), r"(?U)\s+"), lambda w: F.length(w) >= 3)
    hay = fold_nodj(F.concat_ws(" ", title, snippet))
    return F.exists(words, lambda w: hay.contains(w))
