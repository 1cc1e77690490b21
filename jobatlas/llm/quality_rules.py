"""Quality rules as a short-circuit cascade, ordered by measured rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.llm.common import map_batches, read_table, text_bytes
from jobatlas.llm.text_stats import TextStats

#: Rows of the sample on which cost and selectivity are estimated; the order changes speed, never a verdict.
SAMPLE_ROWS = 1000

Rule = Callable[[TextStats], bool]

#: A rule tells whether a text is rejected.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda s: s.n_words < 50,
    "repeated_windows": lambda s: 100 * s.n_repeat_words > 50 * s.n_words,
}
MORE_RULES: dict[str, Rule] = {
    "symbols": lambda s: 10 * s.n_symbols > 3 * s.n_words,
    "exclamations": lambda s: 10 * s.n_marks > 3 * s.n_words,
    "shouting": lambda s: s.n_upper > s.n_lower,
    "word_length": lambda s: s.word_chars < 2 * s.n_words or s.word_chars > 20 * s.n_words,
    "repeated_lines": lambda s: 2 * s.n_dup_lines > s.n_lines,
}
RULES = BASE_RULES | MORE_RULES
COUNTERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_estimates(docs: DataFrame, rules: dict[str, Rule], sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Share rejected and seconds a text of each rule, on a sample of about ``sample_rows`` rows (all if fewer)."""
    total = docs.count()
    sample = docs if total <= sample_rows else docs.sample(fraction=sample_rows / total, seed=7)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).to_pylist()
        out = []
        for name, rule in rules.items():
            began = time.perf_counter()
            rejected = sum(rule(TextStats(t)) for t in texts)
            out.append((name, len(texts), rejected, time.perf_counter() - began))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["name", "n", "rejected", "seconds"])

    rows = map_batches(sample.select(text_bytes().alias("body")), run, "name string, n long, rejected long, seconds double")
    sums = rows.groupBy("name").agg(F.sum("n").alias("n"), F.sum("rejected").alias("r"), F.sum("seconds").alias("s")).collect()
    return {x.name: (x.r / x.n, x.s / x.n) for x in sums}


def cascade_order(estimates: dict[str, tuple[float, float]], rules: dict[str, Rule]) -> list[str]:
    """Rules by rejection per cost, best first; rules without an estimate keep their place at the end."""
    return sorted(rules, key=lambda k: -estimates[k][0] / max(estimates[k][1], 1e-9) if k in estimates else 0.0)


def quality_verdicts(docs: DataFrame, rules: dict[str, Rule] = RULES, always: Sequence[str] = (), order: Sequence[str] | None = None) -> DataFrame:
    """Run the cascade over ``docs`` (doc_id, text, ...): (doc_id, the counters in ``always``, base_failed, kept).

    A text is judged by one rule after the other until one rejects it; later rules are not computed for it.  Counters
    named in ``always`` are computed for every row.  ``base_failed`` is the verdict of the base rules among them (false
    if none is).  Null text counts as empty and fails ``few_words``; repeated rows and null ids are judged row by row;
    an empty table gives an empty table.
    """
    order = list(order) if order is not None else cascade_order(rule_estimates(docs, rules), rules)
    base = [k for k in BASE_RULES if k in rules]
    rest = [k for k in order if k not in base] if always else order

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counters: list[list[int]] = [[] for _ in always]
        failed, kept = [], []
        for text in batch.column(1).to_pylist():
            stats = TextStats(text)
            for col, name in zip(counters, always, strict=True):
                col.append(getattr(stats, name))
            # With counters asked for, the base rules cost nothing more and come first.
            bad = any(rules[k](stats) for k in base) if always else False
            failed.append(bad)
            kept.append(not bad and not any(rules[k](stats) for k in rest))
        arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counters), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *always, "base_failed", "kept"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in always), "base_failed boolean, kept boolean"])
    return map_batches(docs.select("doc_id", text_bytes().alias("body")), run, schema)


def op1_quality_rules(spark, sf_dir) -> DataFrame:
    """The contract query over all documents."""
    return quality_verdicts(read_table(spark, sf_dir, "documents"), always=COUNTERS)


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT *, row_number() OVER () AS k, [ws[i] || chr(31) || ws[i + 1] || chr(31) || ws[i + 2] FOR i IN range(1, len(ws) - 1)] AS tri,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM w
), e AS (
  SELECT k, unnest(tri) AS g3, unnest(range(1, len(tri) + 1)) AS i FROM g
), d AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, g3) AS c FROM e
), h AS (
  SELECT k, count(DISTINCT i + o) AS n_repeat_words FROM d, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY k
), c AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
  FROM g LEFT JOIN h USING (k)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_marks > 3 * n_words OR n_upper > n_lower
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""
