"""Quality scores: ridge regression on random Fourier features of text statistics, then isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.llm.common import id_bucket, map_batches, read_table, save, text_bytes
from jobatlas.llm.text_stats import TextStats

FEATURES = 14
#: Random Fourier features, width of the Gaussian kernel, ridge weight, score bins of the calibration.
COMPONENTS, KERNEL_WIDTH, RIDGE, BINS = 192, 3.0, 1e-3, 400


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text, each bounded or on a log scale."""
    s = TextStats(text)
    n, size = max(1, s.n_words), max(1, len(text))
    letters = max(1, s.n_upper + s.n_lower)
    return [
        float(np.log1p(s.n_words)), min(20.0, s.word_chars / n), s.n_distinct / n, s.n_repeat_words / n,
        s.n_dup_lines / max(1, s.n_lines), min(5.0, s.n_symbols / n), min(5.0, s.n_marks / n), s.n_upper / letters,
        s.n_digits / size, (s.n_upper + s.n_lower) / size, float(np.log1p(s.n_lines)), min(100.0, n / max(1, s.n_lines)) / 20,
        text.count(b".") / n, text.count(b",") / n,
    ]


def feature_table(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, x, *carry): statistics of every row; ``carry`` names whole-number columns that go through."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in batch.column(1).to_pylist()], dtype=np.float64)
        offsets = np.arange(len(x) + 1, dtype=np.int32) * FEATURES
        values = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel())), *batch.columns[2:]]
        return pa.RecordBatch.from_arrays(values, ["doc_id", "x", *carry])

    return map_batches(docs.select("doc_id", text_bytes().alias("body"), *carry), run, "doc_id long, x array<double>" + "".join(f", {c} long" for c in carry))


@dataclass
class Model:
    """Everything a score needs; its size does not depend on the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2.0 / COMPONENTS) * np.cos(z @ self.omega + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.levels) if len(self.levels) else np.full(len(x), 0.5)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _partition_sums(rows: DataFrame, function, size: int) -> np.ndarray:
    """Sum over all partitions of a vector of fixed ``size``; partitions are added up in groups before the driver."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += function(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    sums = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[sums["i"].to_numpy()] = sums["v"].to_numpy()
    return out


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Best non-decreasing fit (pool adjacent violators)."""
    stack: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        stack.append([value, weight, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            b, a = stack.pop(), stack.pop()
            stack.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in stack]) if stack else np.zeros(0)


def fit(labelled: DataFrame, seed: int = 11) -> Model:
    """Fit on (x, label): two passes of partition sums and one of score bins; no row reaches the driver.

    Without any labelled row every score is 0.5.
    """
    rng = np.random.default_rng(seed)
    omega = rng.normal(size=(FEATURES, COMPONENTS)) / KERNEL_WIDTH
    phase = rng.uniform(0, 2 * np.pi, COMPONENTS)
    m = _partition_sums(labelled, lambda b: np.concatenate([[b.num_rows], _matrix(b).sum(0), (_matrix(b) ** 2).sum(0)]), 1 + 2 * FEATURES)
    n = max(1.0, m[0])
    mean = m[1 : 1 + FEATURES] / n
    scale = np.sqrt(np.maximum(m[1 + FEATURES :] / n - mean**2, 1e-6))
    model = Model(mean, scale, omega, phase, np.zeros(COMPONENTS + 1), np.zeros(0), np.zeros(0))
    if not m[0]:
        return model
    d = COMPONENTS + 1

    def normal(batch):
        z, y = model.features(_matrix(batch)), batch.column("label").to_numpy(zero_copy_only=False)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    s = _partition_sums(labelled, normal, d * d + d)
    gram = s[: d * d].reshape(d, d)
    model.weights = np.linalg.solve(gram + RIDGE * n * np.eye(d) / d, s[d * d :])

    def binned(batch):
        y = batch.column("label").to_numpy(zero_copy_only=False)
        k = np.clip(((model.raw(_matrix(batch)) + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, weights=y, minlength=BINS)])

    bins = _partition_sums(labelled, binned, 2 * BINS)
    seen = np.flatnonzero(bins[:BINS])
    model.edges = (seen + 0.5) * 2 / BINS - 0.5
    # One good and one bad row of weight spread over all bins keep scores off 0 and 1.
    rate = (bins[BINS:][seen] + 1.0 / len(seen)) / (bins[:BINS][seen] + 2.0 / len(seen))
    model.levels = np.clip(isotonic(rate, bins[:BINS][seen]), 0.0, 1.0)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_bucket: int = 1, buckets: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted, *carry) of every row of ``docs`` (doc_id, text, ...).

    Labels are (doc_id, quality); rows whose id bucket is ``held_out_bucket`` are never learnt from, nor are null ids or
    null labels; an id with several labels counts with their mean.  Null and empty texts are scored by their (zero)
    statistics.  A null id is not held out.
    """
    features = save(feature_table(docs, carry))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    known = known.where(id_bucket("doc_id", buckets) != held_out_bucket)
    labelled = save(features.join(known, "doc_id").select("x", "label"))
    model = fit(labelled)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(_matrix(batch))
        values = [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *batch.columns[2:]]
        return pa.RecordBatch.from_arrays(values, ["doc_id", "score", "predicted", *carry])

    scored = map_batches(features, run, "doc_id long, score double, predicted int" + "".join(f", {c} long" for c in carry))
    held = F.coalesce(id_bucket("doc_id", buckets) == held_out_bucket, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", *carry)


def op10_quality_classifier(spark, sf_dir) -> DataFrame:
    """The contract query over all documents."""
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
