"""Content fingerprints: row hashes, cache keys and order-free table hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobatlas.functions.parsing import relevant_description


def content_hash(*columns: Column | str) -> Column:
    """SHA-256 over the JSON of the given columns in the given order, nulls included."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def row_hash(df: DataFrame, exclude=()) -> Column:
    """Content hash of a row: columns by name, so column order does not matter."""
    return content_hash(*[F.col(f"`{c}`") for c in sorted(df.columns) if c not in set(exclude)])


def posting_input_hash(post_id: Column, title: Column, description: Column) -> Column:
    return content_hash(
        post_id.alias("id"), title.alias("title"), relevant_description(description).alias("description")
    )


def extraction_cache_key(input_hash: Column, taxonomy_hash: str, *versions: str) -> Column:
    return F.sha2(F.concat_ws("|", input_hash, F.lit(taxonomy_hash), *[F.lit(v) for v in versions]), 256)


def session_key(session_id: Column) -> Column:
    """Pseudonymous session key."""
    return F.substring(F.sha2(F.coalesce(session_id, F.lit("")), 256), 1, 16)


def table_fingerprint(df: DataFrame, exclude=()) -> DataFrame:
    """One row describing the whole table, free of row order and fully map-side combined."""
    hashed = df.select(F.xxhash64(row_hash(df, exclude)).alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor("h").alias("xor_hash"),
        F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("sum_hash"),
    ).select(
        "n_rows",
        F.concat(
            F.lit("table:"),
            F.sha2(F.concat_ws("|", "n_rows", "xor_hash", F.coalesce("sum_hash", F.lit(0))), 256),
        ).alias("fingerprint"),
    )


def dimension_hash(df: DataFrame, *columns: str) -> str:
    """Order-free hash of a small dimension (taxonomy, career base)."""
    return table_fingerprint(df.select(*columns)).first()["fingerprint"]
