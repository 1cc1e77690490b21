"""Label evaluation, confusion lists, accuracy, rubric and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jobatlas.functions.numbers import round_exact
from jobatlas.operators.order_stats import running_counts, value_at

# Extraction targets.
PRECISION_TARGET, RECALL_TARGET, F1_TARGET = 0.80, 0.65, 0.70


def label_pairs(gold: DataFrame, predictions: DataFrame, key: str = "posting_id") -> DataFrame:
    """Gold and predicted label sets side by side; a gold row without prediction fails the job."""
    joined = gold.join(predictions.select(key, F.col("skills").alias("predicted")), key, "left")
    predicted = F.coalesce(
        "predicted", F.raise_error(F.concat(F.lit("missing prediction for "), F.col(key).cast("string"))).cast("array<string>")
    )
    return joined.withColumn("predicted", predicted).withColumn("gold", F.coalesce("skills", F.array().cast("array<string>")))


def per_item_counts(pairs: DataFrame, *carry: str) -> DataFrame:
    return pairs.select(
        *carry,
        F.size(F.array_intersect("predicted", "gold")).cast("long").alias("tp"),
        F.size(F.array_except("predicted", "gold")).cast("long").alias("fp"),
        F.size(F.array_except("gold", "predicted")).cast("long").alias("fn"),
        (F.size("predicted") == 0).alias("empty"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def micro_metrics(items: DataFrame, *groups: str) -> DataFrame:
    """Micro precision, recall and F1, exact and empty rates and the pass flag, per slice if asked."""
    sums = items.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("items"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"), F.count_if("empty").alias("zero"),
    )
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = _ratio(2 * p * r, p + r)
    return sums.select(
        *groups, "items", "tp", "fp", "fn",
        round_exact(p, 4).alias("precision"), round_exact(r, 4).alias("recall"), round_exact(f1, 4).alias("f1"),
        round_exact(_ratio(F.col("exact"), F.col("items")), 4).alias("exact_match_rate"),
        round_exact(_ratio(F.col("zero"), F.col("items")), 4).alias("zero_rate"),
        ((p >= PRECISION_TARGET) & (r >= RECALL_TARGET) & (f1 >= F1_TARGET)).alias("passed"),
    )


def confusion_top(pairs: DataFrame, limit: int = 10) -> DataFrame:
    """Most common false positives and false negatives."""
    wrong = pairs.select(F.explode(F.concat(
        F.transform(F.array_except("predicted", "gold"), lambda s: F.struct(F.lit("false_positive").alias("kind"), s.alias("skill"))),
        F.transform(F.array_except("gold", "predicted"), lambda s: F.struct(F.lit("false_negative").alias("kind"), s.alias("skill"))),
    )).alias("w")).groupBy("w.kind", "w.skill").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("kind").orderBy(F.desc("n"), "skill")
    return wrong.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def precision_regressions(current: DataFrame, baseline: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """Slices whose precision dropped by more than the tolerance."""
    old = baseline.select(key, F.col("precision").alias("baseline_precision"))
    return current.join(old, key).where(F.col("baseline_precision") - F.col("precision") > tolerance)


def accuracy_by(pairs: DataFrame, *groups: str, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    return pairs.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("items"), round_exact(F.avg((F.col(predicted) == F.col(gold)).cast("double")), 4).alias("accuracy")
    )


def nearest_rank(df: DataFrame, groups: list[str], value: str, q: float = 0.95) -> DataFrame:
    """Nearest-rank percentile (rank ceil(q n)) and median from counts of distinct values.

    Values are counted before anything is ordered, so repeated measurements cost nothing.
    """
    n = F.col("_n")
    middle = (value_at(F.ceil(n / 2)) + value_at(F.floor(n / 2) + 1)) / 2
    ranked = running_counts(df, groups, value)
    return ranked.groupBy(*groups, n.alias("n")).agg(value_at(F.ceil(n * q)).alias("p95"), round_exact(middle, 4).alias("median"))


def rubric(recommendations: DataFrame, key: str = "session_id") -> DataFrame:
    """Structural rubric per profile from ``career_id, is_stretch, routes, why, job_readiness, mode, grounded``."""
    bad_routes = (F.size("routes") < 2) | ~F.exists("routes", lambda r: r.type.isin("vocational", "college", "certificate"))
    empty_why = (F.size("why.from_you") == 0) | (F.size("why.from_market") == 0) | (F.coalesce("why.counterfactual", F.lit("")) == "")
    bad_mode = (F.col("mode") == "launch") != F.col("job_readiness").isNotNull()
    rows = recommendations.groupBy(key).agg(
        F.count_distinct(F.when(~F.col("is_stretch"), F.col("career_id"))).alias("n"),
        F.max(bad_routes).alias("bad_routes"), F.max(empty_why).alias("empty_why"), F.max(bad_mode).alias("bad_mode"),
        F.min("grounded").alias("grounded"), F.max("is_stretch").alias("has_stretch"),
    )
    return rows.select(
        key,
        F.when(F.col("bad_mode"), 2.0).otherwise(4.0).alias("fit"),
        F.when(~F.col("has_stretch"), 2.0).when(F.col("n") < 4, 2.5).otherwise(4.0).alias("diversity"),
        F.when(F.col("bad_routes"), 1.0).otherwise(5.0).alias("routes"),
        F.when(~F.col("grounded"), 1.0).when(F.col("empty_why"), 2.0).otherwise(4.0).alias("explain"),
    )


def rubric_summary(scores: DataFrame) -> DataFrame:
    parts = ("fit", "diversity", "routes", "explain")
    mean = sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / len(parts)
    return scores.agg(
        F.count(F.lit(1)).alias("personas"), *[round_exact(F.avg(p), 4).alias(p) for p in parts],
        round_exact(F.avg(mean), 4).alias("mean_score"),
        F.count_if(F.least(*[F.col(p) for p in parts]) <= 2.0).alias("hard_fails"),
    )
