"""Line-delimited JSON scans, snapshot selection and atomic sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobatlas.sources import commits

CORRUPT = "_corrupt"


def read_strict(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines where any malformed line fails the job; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """JSON lines with a corrupt-record column and the file each row came from.

    With ``required`` keys, ``missing_keys`` lists those a record lacks; a key with a null value is there.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name")).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", options)
    if not required:
        return lines.select(parsed.alias("r"), "file_name").select("r.*", "file_name")
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, required)), keys)
    return lines.select(parsed.alias("r"), "file_name", missing.alias("missing_keys")).select("r.*", "file_name", "missing_keys")


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)`` of a tolerant scan."""
    bad = F.col(CORRUPT).isNotNull()
    return rows.where(~bad).drop(CORRUPT), rows.where(bad).select("file_name", F.col(CORRUPT).alias("line"))


def latest_per_key(rows: DataFrame, key: str = "id", version: str = "file_name") -> DataFrame:
    """Last snapshot per key.  The reduction is a combinable max, so a hot key stays cheap."""
    body = F.struct(*[F.col(c) for c in rows.columns if c != key])
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(body, F.lower(F.col(version))).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in rows.columns if c != key])


def union_snapshots(*snapshots: DataFrame) -> DataFrame:
    out = snapshots[0]
    for other in snapshots[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def write_atomic(df: DataFrame, path: str, fmt: str = "json", partition_by=()) -> str:
    """Write a new version of the table at ``path`` and commit it; returns the folder of the version.

    Readers that ask ``commits.current_folder`` see the former version until the commit stands, and never a part.
    """
    return commits.commit(df, path, fmt, partition_by)


def write_market(tables: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Full refresh of the aggregate tables; those with a region are partitioned by it."""
    return {
        name: write_atomic(df, f"{base}/{name}", "parquet", ("region",) if "region" in df.columns else ())
        for name, df in tables.items()
    }


def write_report(report: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Write a one-row report, or nothing at all in a dry run; the report is returned either way."""
    if not dry_run:
        write_atomic(report.coalesce(1), path, "json")
    return report


def read_market(spark: SparkSession, base: str, table: str, region: str | None = None) -> DataFrame:
    """Aggregate table; a region predicate prunes its partitions."""
    rows = commits.read_current(spark, f"{base}/{table}", "parquet")
    return rows if region is None else rows.where(F.col("region") == region)


def taxonomy_dimension(spark: SparkSession, path: str) -> DataFrame:
    """Skills of a taxonomy document with their order: ``name, aliases, type, taxonomy_order``."""
    doc = spark.read.option("multiLine", True).schema(
        "schema_version int, version string, built_at string, taxonomy_hash string, "
        "skills array<struct<name:string,aliases:array<string>,type:string>>"
    ).json(path)
    return doc.select(F.posexplode("skills").alias("taxonomy_order", "s")).select(
        "s.name", "s.aliases", "s.type", "taxonomy_order"
    )


def career_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Careers of a career base document with their position."""
    doc = spark.read.option("multiLine", True).schema(f"careers array<struct<{_as_struct(schema)}>>").json(path)
    return doc.select(F.posexplode("careers").alias("career_pos", "c")).select("c.*", "career_pos")


def _as_struct(schema: str) -> str:
    """Column list DDL as struct fields."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)
