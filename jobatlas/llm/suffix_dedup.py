"""Removal of repeated byte strings: sparse suffix ranks refined over growing and shrinking spans.

Every string of ``length`` bytes holds an *anchor*: the least hash of a ``GRAM``-byte string in it, which depends on its
bytes alone, so all copies choose the same one.  Only suffixes at anchors are ranked.  Spark groups (position, rank)
pairs; a position whose rank is unique drops out, one whose whole surroundings repeat is settled, and the ranks of the
rest are taken again over longer strings, for ever smaller ranges of starts, until each start of ``length`` bytes is
known to be unique or past the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.llm.common import map_batches, powers, prefix_hashes, read_table, release, save, span_hashes, text_bytes

#: Bytes of an anchor string.
GRAM = 60
#: Starts covered by one range, per round; each divides the one before, the last looks at single starts.
SPANS = (72, 24, 8, 1)


def _sliding(values: np.ndarray, width: int, low: bool) -> np.ndarray:
    """Least (or largest) of every ``width`` successive values, by doubling."""
    pick, out, have = (np.minimum if low else np.maximum), values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, prefix: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Positions that are the least hash of some string of ``length`` bytes, in texts laid end to end.

    ``ends`` are the places where texts end; no string crosses them.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, dtype=np.int64)
    grams = (prefix[GRAM:] - prefix[:-GRAM]) * powers("down", n - GRAM + 1)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    width = length - GRAM + 1
    least = np.zeros(n - length + 1 + 2 * (width - 1), dtype=np.uint64)
    least[width - 1 : len(least) - width + 1] = _sliding(grams, width, True)
    for end in ends:
        # Strings that would run over the end of their text do not count.
        least[max(0, end - length + 1) + width - 1 : end + width - 1] = 0
    return np.flatnonzero(_sliding(least, width, False) == grams)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column end to end, and where each value starts (one more than values)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = column.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def _pieces(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of successive values of about ``size`` bytes, so that work stays in the processor's cache."""
    out, first = [], 0
    for i in range(1, len(starts)):
        if starts[i] - starts[first] >= size or i == len(starts) - 1:
            out.append((first, i))
            first = i
    return out


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    reach = length - GRAM

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        data, starts = _joined(batch.column(1))
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for lo, hi in _pieces(starts, 1 << 17):
            own, at0 = data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
            prefix = prefix_hashes(own)
            at = anchors(own, prefix, at0[1:-1], length)
            doc = np.searchsorted(at0, at, "right") - 1
            left, right = np.maximum(at - reach, at0[doc]), np.minimum(at + length, at0[doc + 1])
            around = span_hashes(prefix, left, right) ^ ((at - left) * 1024 + (right - at)).astype(np.uint64)
            for col, x in zip(cols, (keys[lo + doc], at - at0[doc], span_hashes(prefix, at, at + GRAM).view(np.int64), around.view(np.int64)), strict=True):
                col.append(x)
        flat = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, dtype=np.int64) for c in cols]
        zero = np.zeros(len(flat[0]), dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(flat[1].astype(np.int32)), pa.array(zero), pa.array(flat[2]), pa.array(flat[3])], ["text_key", "at", "first", "inner", "outer"])

    return map_batches(docs, run, "text_key long, at int, first int, inner long, outer long")


def _bodies(docs: DataFrame, points: DataFrame) -> DataFrame:
    """(text_key, body) of the texts with open anchors, one row a text."""
    return docs.join(points.select("text_key").distinct(), "text_key", "left_semi").select("text_key", "body").dropDuplicates(["text_key"])


def _ranges(work: DataFrame, span: int, parent: int, length: int) -> DataFrame:
    """Ranks of every range of ``span`` starts below the open ones: (text_key, at, first, inner, outer).

    ``work`` has text_key, body and opened, a list of (at, first).  ``inner`` ranks the string that all starts of the
    range share, ``outer`` the one that holds them all; the latter is 0 where the text ends too early.  ``first`` counts
    bytes from the nearest start to the anchor.
    """
    reach = length - GRAM
    steps = np.arange(0, parent, span)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column("text_key").to_numpy(zero_copy_only=False)
        data, starts = _joined(batch.column("body"))
        opened = batch.column("opened")
        counts = opened.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        places, heads = (opened.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "first"))
        until = np.concatenate([[0], np.cumsum(counts)])
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for lo, hi in _pieces(starts, 1 << 18):
            prefix = prefix_hashes(data[starts[lo] : starts[hi]])
            row = np.repeat(np.arange(lo, hi), counts[lo:hi] * len(steps))
            at = np.repeat(places[until[lo] : until[hi]], len(steps))
            first = (heads[until[lo] : until[hi], None] + steps[None, :]).ravel()
            last, size = np.minimum(first + span - 1, reach), (starts[1:] - starts[:-1])[row]
            # A start lies so many bytes before the anchor; it is one if it is in the text and `length` bytes follow.
            keep = (first <= last) & (np.minimum(last, at) >= np.maximum(first, at + length - size))
            first, last, at, size, row = first[keep], last[keep], at[keep], size[keep], row[keep]
            # The place of the anchor in the string belongs to the rank.
            place, here = (first * 1024 + last).astype(np.uint64) * np.uint64(2), starts[row] - starts[lo] + at
            inner = span_hashes(prefix, here - first, here - last + length) ^ place
            whole = (last <= at) & (at - first + length <= size)
            outer = np.zeros(len(first), dtype=np.uint64)
            outer[whole] = span_hashes(prefix, (here - last)[whole], (here - first + length)[whole]) ^ place[whole]
            for col, x in zip(cols, (keys[row], at, first, inner.view(np.int64), outer.view(np.int64)), strict=True):
                col.append(x)
        flat = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, dtype=np.int64) for c in cols]
        arrays = [pa.array(x.astype(np.int32) if i in (1, 2) else x) for i, x in enumerate(flat)]
        return pa.RecordBatch.from_arrays(arrays, ["text_key", "at", "first", "inner", "outer"])

    return map_batches(work, run, "text_key long, at int, first int, inner long, outer long")


def _rerank(rows: DataFrame) -> DataFrame:
    """Positions whose inner rank repeats: (text_key, at, first, settled, open).

    Settled: the outer rank repeats as well.  Open: to be ranked over smaller ranges; of positions with one outer rank a
    single one stays open, as witness for the others, and none if no other outer rank has the inner one.  Most ranks are
    unique; they drop out first, on a count of the ranks alone.  Counts come from partial sums, so a hot rank is never
    held together.
    """
    again = rows.groupBy("inner").agg(F.count("*").alias("n")).where("n > 1").select("inner")
    rows = save(rows.join(again, "inner", "left_semi"))
    release(rows.sparkSession)
    groups = rows.groupBy("inner", "outer").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "at", "first")).alias("one"))
    inner = groups.groupBy("inner").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max(F.col("outer") == 0).alias("cut"))
    inner = inner.where("total > 1").select("inner", (F.expr("kinds > 1 or cut")).alias("more"))
    known = groups.join(inner, "inner").where("n > 1 or more").select("inner", "outer", "n", "one", "more")
    settled = (F.col("n") > 1) & (F.col("outer") != 0)
    stays = F.col("more") & (~settled | (F.struct("text_key", "at", "first") == F.col("one")))
    marked = rows.join(known, ["inner", "outer"]).select("text_key", "at", "first", settled.alias("settled"), stays.alias("open"))
    marked = save(marked.where("settled or open").distinct())
    release(rows.sparkSession, rows)
    return marked


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(text_key, spans) of texts with repeated strings: byte runs (lo, hi) they cover, in order, maybe overlapping.

    ``docs`` has text_key (hash of the content) and body (bytes); equal texts are several occurrences of one key.
    """
    spark, reach = docs.sparkSession, length - GRAM
    marked = _rerank(_anchor_rows(docs, length))
    spans = [marked.where("settled").select("text_key", (F.col("at") - reach).alias("lo"), (F.col("at") + length).alias("hi"))]
    bodies = save(_bodies(docs, marked.where("open")))
    release(spark)
    parent = reach + 1
    for span in SPANS:
        opened = marked.where("open").groupBy("text_key").agg(F.collect_list(F.struct("at", "first")).alias("opened"))
        work = save(bodies.join(opened, "text_key"))
        ranks = _ranges(work, span, parent, length)
        if span == 1:
            again = ranks.groupBy("inner").agg(F.count("*").alias("n")).where("n > 1").select("inner")
            marked = ranks.join(again, "inner", "left_semi").withColumn("settled", F.lit(True))
        else:
            marked, parent = _rerank(ranks), span
        lo = F.col("at") - F.least(F.col("first") + (span - 1), F.lit(reach))
        found = marked.where("settled").select("text_key", lo.alias("lo"), (F.col("at") - F.col("first") + length).alias("hi"))
        spans.append(save(found))
        release(spark, work)
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    return every.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def remove_repeated(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs`` (doc_id, text, ...).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the table, the same text
    included; strings are judged on the input.  Null text counts as empty; texts shorter than ``length`` stay whole.
    Repeated rows are repeats of each other and lose all; ids may be null, repeated or of equal text.
    """
    if length <= GRAM:
        raise ValueError(f"length must be more than {GRAM}")
    body = docs.select("doc_id", F.xxhash64(text_bytes()).alias("text_key"), text_bytes().alias("body"))
    spans = save(repeated_spans(body.select("text_key", "body"), length))
    release(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for text, pieces in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, end, runs = [], 0, 0
            for piece in pieces or ():
                lo, hi = max(0, piece["lo"]), min(len(text), piece["hi"])
                if lo > end or not runs:
                    kept.append(text[end:lo])
                    runs += 1
                end = max(end, hi)
            kept.append(text[end:])
            kept = b"".join(kept)
            for col, x in zip(out, (len(text), len(text) - len(kept), runs, kept), strict=True):
                col.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    met = body.join(spans, "text_key", "left").select("doc_id", "body", "spans")
    return map_batches(met, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark, sf_dir) -> DataFrame:
    """The contract query over all documents."""
    out = remove_repeated(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), w AS (
  SELECT k, unnest(range(0, length(h) // 2 - 199)) AS i, unnest([hash(substr(h, 2 * j + 1, 400)) FOR j IN range(0, length(h) // 2 - 199)]) AS m
  FROM d WHERE length(h) >= 400
), r AS (SELECT k, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)), g AS (
  SELECT k, i, CASE WHEN i > lag(i) OVER (PARTITION BY k ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM r
), a AS (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS run FROM g), u AS (
  SELECT k, min(i) AS lo, max(i) + 200 AS hi FROM a GROUP BY k, run
), q AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY k ORDER BY lo), 0) AS was FROM u), x AS (
  SELECT k, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * was + 1, 2 * (lo - was)), '' ORDER BY lo) AS pieces
  FROM q JOIN d USING (k) GROUP BY k
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(pieces || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN x USING (k)
"""
