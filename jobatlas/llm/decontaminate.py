"""Benchmark decontamination on a distributed positional inverted index.

The index is partitioned by documents: every row of the index table holds the postings of one block of documents, for
each term the ordered list of its positions.  A query window is answered in a block by intersecting the lists of its
terms, each shifted by the term's offset in the window, from the term that is rarest in the whole corpus on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.llm.common import map_batches, read_table, save, text_bytes

#: Words of a window, words of an index block, free positions between documents, query items matched in one pass.
WIDTH, BLOCK_WORDS, GAP, ITEMS_PER_PASS = 10, 500_000, 64, 2_000
#: A-Z become a-z; every other ASCII byte that is no letter or digit parts words; other bytes belong to words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a text."""
    return text.translate(_TABLE).split()


class Shard:
    """Postings of one block."""

    def __init__(self, terms: bytes, starts: np.ndarray, positions: np.ndarray) -> None:
        self.number = {t: i for i, t in enumerate(terms.split())}
        self.starts, self.positions = starts, positions

    def postings(self, term: bytes) -> np.ndarray:
        i = self.number.get(term)
        return self.positions[:0] if i is None else self.positions[self.starts[i] : self.starts[i + 1]]

    def phrase(self, terms: list[bytes], order: list[int]) -> np.ndarray:
        """Positions where the phrase begins; ``order`` lists its offsets, rarest term first."""
        at = self.postings(terms[order[0]]) - order[0]
        for offset in order[1:]:
            if not len(at):
                break
            own = self.postings(terms[offset])
            if not len(own):
                return own
            seek = at + offset
            at = at[own[np.minimum(np.searchsorted(own, seek), len(own) - 1)] == seek]
        return at

    def near(self, terms: list[bytes], order: list[int], slop: int) -> np.ndarray:
        """Positions of the rarest term that have every other term within ``len(terms) + slop`` words."""
        at, reach = self.postings(terms[order[0]]), len(terms) + slop
        for offset in order[1:]:
            own = self.postings(terms[offset])
            at = at[np.searchsorted(own, at + reach, "right") > np.searchsorted(own, at - reach)] if len(at) else at
        return at


def _block(name: str, ids: list, texts: list[list[bytes]]) -> dict:
    number: dict[bytes, int] = {}
    flat = [w for t in texts for w in t]
    term = np.fromiter((number.setdefault(w, len(number)) for w in flat), dtype=np.int32, count=len(flat))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    firsts = np.cumsum(sizes) - sizes + np.arange(len(texts)) * GAP
    position = (np.arange(len(flat)) + np.repeat(np.arange(len(texts)) * GAP, sizes)).astype(np.int32)
    order = np.argsort(term, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(number)))]).astype(np.int32)
    return {
        "block": name, "terms": b" ".join(number), "starts": starts.tobytes(), "positions": position[order].tobytes(),
        "doc_ids": ids, "firsts": firsts.tolist(), "sizes": sizes.tolist(),
    }


_INDEX = pa.schema([
    ("block", pa.string()), ("terms", pa.binary()), ("starts", pa.binary()), ("positions", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
])
_INDEX_SQL = "block string, terms binary, starts binary, positions binary, doc_ids array<long>, firsts array<long>, sizes array<long>"


def build_index(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Index table of ``docs`` (doc_id, text, ...), written to the shared folder: one row per block of documents.

    A block ends with the document that fills it, so a very long document only makes its own block larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, done = [], [], 0, 0
        task = TaskContext.get().partitionId()

        def flush():
            return pa.RecordBatch.from_pylist([_block(f"{task}-{done}", ids, texts)], schema=_INDEX)

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words(body.as_py())
                ids.append(key)
                texts.append(own)
                size += len(own) + 8
                if size >= block_words:
                    yield flush()
                    ids, texts, size, done = [], [], 0, done + 1
        if ids:
            yield flush()

    return save(docs.select("doc_id", text_bytes().alias("body")).mapInArrow(run, _INDEX_SQL))


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[int, Shard]]:
    for i in range(batch.num_rows):
        terms, starts, positions = (batch.column(c)[i].as_py() for c in ("terms", "starts", "positions"))
        yield i, Shard(terms, np.frombuffer(starts, dtype=np.int32), np.frombuffer(positions, dtype=np.int32))


def query_windows(items: list[tuple[str, bytes]], width: int = WIDTH) -> dict[tuple[bytes, ...], list[str]]:
    """Distinct windows of the items, each with the items it comes from; an item of fewer words is one window."""
    out: dict[tuple[bytes, ...], list[str]] = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - width + 1) if own else 0):
            names = out.setdefault(tuple(own[i : i + width]), [])
            if item not in names:
                names.append(item)
    return out


def _matches(index: DataFrame, items: list[tuple[str, bytes]], width: int, slop: int | None) -> DataFrame:
    """(block, place, spans, items, near) of documents with matches of these items."""
    windows = query_windows(items, width)
    terms = sorted({t for w in windows for t in w})

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(len(terms), dtype=np.int64)
        for _, shard in _shards(batch):
            total += np.array([len(shard.postings(t)) for t in terms], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms))), pa.array(total)], ["term", "n"])

    sums = map_batches(index.select("terms", "starts", "positions"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    often = {terms[r.term]: r.n for r in sums.collect()}
    plan = [(list(w), sorted(range(len(w)), key=lambda i: (often.get(w[i], 0), i)), names) for w, names in windows.items()]
    plan = [p for p in plan if all(often.get(t, 0) for t in p[0])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[dict] = []
        for row, shard in _shards(batch):
            firsts = np.array(batch.column("firsts")[row].as_py(), dtype=np.int64)
            found: dict[int, dict] = {}

            def entry(place: int, row: int = row, found: dict = found) -> dict:
                return found.setdefault(place, {"block": batch.column("block")[row].as_py(), "place": place, "spans": [], "items": set(), "near": set()})

            for phrase, order, names in plan:
                for at in shard.phrase(phrase, order).tolist():
                    place = int(np.searchsorted(firsts, at, "right")) - 1
                    own = entry(place)
                    own["spans"].append((at - int(firsts[place]), at - int(firsts[place]) + len(phrase)))
                    own["items"].update(names)
                if slop is not None:
                    for at in shard.near(phrase, order, slop).tolist():
                        entry(int(np.searchsorted(firsts, at, "right")) - 1)["near"].update(names)
            for own in found.values():
                merged: list[list[int]] = []
                for lo, hi in sorted(own["spans"]):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                out.append(own | {"spans": [{"lo": lo, "hi": hi} for lo, hi in merged], "items": sorted(own["items"]), "near": sorted(own["near"])})
        kind = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
        schema = pa.schema([("block", pa.string()), ("place", pa.int64()), ("spans", pa.list_(kind)), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
        return pa.RecordBatch.from_pylist(out, schema=schema)

    fields = "block string, place long, spans array<struct<lo: long, hi: long>>, items array<string>, near array<string>"
    return map_batches(index.select("block", "terms", "starts", "positions", "firsts"), run, fields)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int | None = None) -> DataFrame:
    """(doc_id, n_words, spans, items, near) of every row of ``docs`` (doc_id, text, ...).

    ``spans`` are the word ranges [lo, hi) inside occurrences of windows of ``benchmark`` (item_id, text), overlapping
    ones merged; ``items`` the ids, as text, of items with an occurring window; ``near`` those of items with all words
    of a window close together, in any order, if ``slop`` (extra words, at most GAP - width) is given.  The items pass
    in blocks of ITEMS_PER_PASS, so what a task holds of them is bounded.  Null texts have no words; null item ids are
    the empty id; repeated items count once; an empty benchmark or corpus gives no matches.
    """
    if slop is not None and not 0 <= slop <= GAP - 2 * width:
        raise ValueError("slop out of range")
    index = build_index(docs)
    parts, items = [], []
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), text_bytes().alias("t")).toLocalIterator():
        items.append((r.i, bytes(r.t)))
        if len(items) == ITEMS_PER_PASS:
            parts.append(save(_matches(index, items, width, slop)))
            items = []
    if items or not parts:
        parts.append(_matches(index, items, width, slop))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    gather = lambda c: F.flatten(F.collect_list(c))
    found = found.groupBy("block", "place").agg(
        F.array_sort(gather("spans")).alias("spans"), F.array_sort(F.array_distinct(gather("items"))).alias("items"),
        F.array_sort(F.array_distinct(gather("near"))).alias("near"),
    )
    step = F.aggregate(
        "spans", F.expr("cast(array() as array<struct<lo: bigint, hi: bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["hi"] >= x["lo"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), F.greatest(F.element_at(acc, -1)["hi"], x["hi"]).alias("hi")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    found = found.withColumn("spans", step if len(parts) > 1 else F.col("spans"))
    rows = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("place", "x"))
    rows = rows.select("block", F.col("place").cast("long").alias("place"), F.col("x.doc_ids").alias("doc_id"), F.col("x.sizes").alias("n_words"))
    none = F.expr("cast(array() as array<string>)")
    return rows.join(found, ["block", "place"], "left").select(
        "doc_id", "n_words", F.when(F.size("spans") > 0, F.col("spans")).alias("spans"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near")
    )


def op6_decontaminate(spark, sf_dir) -> DataFrame:
    """The contract query over all documents and benchmark items."""
    found = benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"]), F.lit(0).cast("long"))
    out = found.withColumn("n_hit", n_hit)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), q AS (
  SELECT DISTINCT item_id, len(p) AS m, array_to_string(p, ' ') AS p
  FROM (SELECT item_id, unnest([ws[i : i + 9] FOR i IN range(1, greatest(2, len(ws) - 8))]) AS p FROM b WHERE len(ws) > 0)
), m AS (SELECT DISTINCT m FROM q), e AS (
  SELECT k, m, unnest(range(1, len(ws) - m + 2)) AS i, unnest([array_to_string(ws[j : j + m - 1], ' ') FOR j IN range(1, len(ws) - m + 2)]) AS p
  FROM d, m WHERE len(ws) >= m
), h AS (SELECT e.k, e.i, q.m, q.item_id FROM e JOIN q ON e.p = q.p AND e.m = q.m), c AS (
  SELECT k, count(DISTINCT w) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS w FROM h) GROUP BY k
), t AS (SELECT k, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS names FROM h GROUP BY k)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""
