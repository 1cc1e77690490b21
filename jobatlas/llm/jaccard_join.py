"""Exact Jaccard join of word shingle sets, and its classes.

Index lists are keyed by size class, position and content of a *part* of a set: the hashed universe is cut into so many
parts that two sets above the threshold agree in at least one.  A probe of part j reads the block of position j alone
and skips the others (index skipping).  Sets that a list joins to its first set take over that set's answers: they are
compared with others only where the class of those is still open (answer skipping).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobatlas.llm.common import lists, mix, ordered_hash, read_table, release, save, text_bytes, word_hashes
from jobatlas.llm.word_batches import slices
from jobatlas.operators.graph import component_stars

#: Sets whose sizes lie in one class share a number of parts.
CLASS_RATIO = 1.5
#: Parts beyond the least number, so that agreement in empty parts alone is rare.
SPARE_PARTS = 1
#: Slices in which the index lists pass; one slice's shuffle may still stand while the next is written.
SLICES = 4
#: Places of a set's parity sketch, of the wide one, and the sizes that have a wide one.
BITS, WIDE_BITS, WIDE_FROM = 512, 16384, 1000
EMPTY = np.uint64(0xA5A5A5A5A5A5A5A5)


def shingles(text: bytes, width: int = 3) -> np.ndarray:
    """Distinct hashes of ``width`` successive words; the whole sequence if there are fewer, none without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    return np.unique(ordered_hash([words[i : len(words) - width + 1 + i] for i in range(width)]))


def class_limits(size: int, percent: int = 90) -> list[tuple[int, int, int]]:
    """Classes (number, least, most size) that a set of ``size`` must be listed in, for the given similarity."""
    low, k, out = 1, 0, []
    least = -(-percent * size // 100)
    while low <= size:
        most = max(low + 1, int(low * CLASS_RATIO)) - 1
        if most >= least:
            out.append((k, low, most))
        low, k = most + 1, k + 1
    return out


def part_keys(elements: np.ndarray, percent: int = 90) -> np.ndarray:
    """Keys of the index lists of a set: one per size class and non-empty part.

    With x the smaller size and t the similarity, linked sets differ in at most d = x (1 - t) / t elements, so in as
    many parts.  A class has 1 + SPARE_PARTS parts more than d is for its largest size.  A set lists its empty parts
    too where these alone might agree.
    """
    n, out = len(elements), []
    differ = n * (100 - percent) // percent
    spread, content = mix(elements ^ np.uint64(0x5851F42D4C957F2D)), mix(elements ^ np.uint64(0x14057B7EF767814F))
    for k, _, most in class_limits(n, percent):
        parts = most * (100 - percent) // percent + 1 + SPARE_PARTS
        part = (spread % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        own, first = np.unique(part[order], return_index=True)
        sums = np.add.reduceat(content[order], first)
        if parts - len(own) >= parts - differ:
            gone = np.setdiff1d(np.arange(parts), own)
            own, sums = np.concatenate([own, gone]), np.concatenate([sums, np.full(len(gone), EMPTY)])
        out.append(mix(sums ^ mix(own.astype(np.uint64) + np.uint64(k << 40))))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def parity_bits(elements: np.ndarray, places: int = BITS) -> np.ndarray:
    """Parity of the elements in each of so many places; sets of difference d differ in at most d of them."""
    spread = (mix(elements ^ np.uint64(0x27D4EB2F165667C5)) % np.uint64(places)).astype(np.int64)
    return np.packbits((np.bincount(spread, minlength=places) & 1).astype(np.uint8)).view(np.int64)


def _map_slices(rows: DataFrame, function, schema: str) -> DataFrame:
    """Apply ``function`` to slices of a few megabytes of text, so that a worker never holds the sets of a whole batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "body"):
                yield function(part)

    return rows.mapInArrow(run, schema)


def set_table(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_id, bits, wide, keys): size, identity, sketches and index keys of every set.

    Sets of WIDE_FROM elements or more have a wide sketch besides, which lists do not carry; for others it is empty.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = np.zeros(0, dtype=np.int64)
        sets = [shingles(t, width) for t in batch.column(2).to_pylist()]
        ids = [int(mix(s.sum(keepdims=True, dtype=np.uint64) ^ np.uint64(len(s)))[0].astype(np.int64)) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()),
                lists([parity_bits(s) for s in sets], pa.int64()),
                lists([parity_bits(s, WIDE_BITS) if len(s) >= WIDE_FROM else none for s in sets], pa.int64()), lists([part_keys(s, percent).view(np.int64) for s in sets], pa.int64()),
            ],
            ["doc_id", "text_key", "n_shingles", "set_id", "bits", "wide", "keys"],
        )

    rows = docs.select("doc_id", F.xxhash64(text_bytes()).alias("text_key"), text_bytes().alias("body"))
    return _map_slices(rows, run, "doc_id long, text_key long, n_shingles long, set_id long, bits array<long>, wide array<long>, keys array<long>")


def _elements(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(set_id, elements) of the wanted (set_id, doc_id, text_key), from one document each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), lists([x.view(np.int64) for x in sets], pa.int64())], ["set_id", "elements"])

    rows = docs.select("doc_id", F.xxhash64(text_bytes()).alias("text_key"), text_bytes().alias("body")).alias("d")
    w = wanted.alias("w")
    met = rows.join(w, (F.col("d.text_key") == F.col("w.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    return _map_slices(met.select("w.set_id", "d.body"), run, "set_id long, elements array<long>").dropDuplicates(["set_id"])


def _sets(table: DataFrame) -> DataFrame:
    """Saved rows of ``table``, one of each different set, with the document that its elements are read from again."""
    return save(table.where("set_id is not null").withColumnRenamed("n_shingles", "n").dropDuplicates(["set_id"]))


def _linked(docs: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The saved pairs (a, b) whose sets reach the threshold; the sets are read again for the ids in ``pairs`` alone."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    elements = save(_elements(docs, sets.join(ids, "set_id").select("set_id", "doc_id", "text_key"), width))
    release(docs.sparkSession)
    a = elements.select(F.col("set_id").alias("a"), F.col("elements").alias("ea"))
    b = elements.select(F.col("set_id").alias("b"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    met = pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("ea") + F.size("eb") - both))
    links = save(met.select("a", "b"))
    release(docs.sparkSession, elements)
    return links


def _close(percent: int):
    """Condition on two sets that every linked pair meets: by size, and by the difference of their sketches.

    With t the similarity, (1 + t) times the difference of linked sets is at most (1 - t) times the sum of their sizes.
    """
    sketch = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("hbits", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    sized = F.least("n", "hn") * 100 >= F.greatest("n", "hn") * percent
    return sized & ((100 + percent) * sketch <= (100 - percent) * (F.col("n") + F.col("hn")))


def _widely_close(percent: int, a: str, b: str, total):
    """The same on the wide sketches, where both sets have one."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    small = F.coalesce(F.size(a), F.lit(0)) * F.coalesce(F.size(b), F.lit(0)) <= 0
    return small | ((100 + percent) * apart <= (100 - percent) * total)


def _narrowed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Saved (a, b) of the pairs (a, b, n) that the wide sketches of large sets allow as well."""
    wide = sets.where(F.col("n") >= WIDE_FROM)
    if not wide.isEmpty():
        a = wide.select(F.col("set_id").alias("a"), F.col("wide").alias("wa"))
        b = wide.select(F.col("set_id").alias("b"), F.col("wide").alias("wb"))
        pairs = pairs.join(a, "a", "left").join(b, "b", "left").where(_widely_close(percent, "wa", "wb", F.col("n")))
    return save(pairs.select("a", "b"))


def _members(sets: DataFrame) -> list[DataFrame]:
    """Saved (key, set_id, least, other) of the lists that more than one set is in; keys pass in slices, which bounds the disk in use.

    ``least`` is the smallest set of the list, ``other`` one that differs from list to list.
    """
    parts, own = [], Window.partitionBy("key")
    least, mixed = F.min("set_id").over(own), F.min(F.col("set_id").bitwiseXOR(F.col("key"))).over(own)
    for k in range(SLICES):
        entries = sets.select("set_id", F.explode(F.expr(f"filter(keys, x -> pmod(x, {SLICES}) = {k})")).alias("key"))
        # One shuffle serves both the heads of a list and its members.
        headed = entries.select("key", "set_id", least.alias("least"), F.max("set_id").over(own).alias("most"), mixed.alias("mixed"))
        parts.append(save(headed.where("least != most").select("key", "set_id", "least", F.col("mixed").bitwiseXOR(F.col("key")).alias("other"))))
        release(sets.sparkSession)
    return parts


def _head_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Saved (a, b, n) of close pairs of a set and a head of one of its lists.

    Every set meets the smallest of its list.  It meets the other head, too, unless both already are close to one same
    set, which holds for most of a large class; what that leaves out is met when all sets of open lists are compared.
    """
    heads = F.explode(F.array(F.struct(F.col("least").alias("h"), F.lit(True).alias("first")), F.struct(F.col("other").alias("h"), F.lit(False).alias("first"))))
    met = members.select("set_id", heads.alias("x")).select("set_id", "x.h", "x.first").where("set_id != h")
    pairs = met.groupBy(F.least("set_id", "h").alias("a"), F.greatest("set_id", "h").alias("b")).agg(F.max("first").alias("first"))
    own = sets.select(F.col("set_id").alias("a"), "n", "bits")
    head = sets.select(F.col("set_id").alias("b"), F.col("n").alias("hn"), F.col("bits").alias("hbits"))
    close = save(pairs.join(own, "a").join(head, "b").where(_close(percent)).select("a", "b", (F.col("n") + F.col("hn")).alias("n"), "first"))
    release(sets.sparkSession)
    both = close.where("first").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    least = both.groupBy(F.col("x.a").alias("id")).agg(F.least(F.min("x.b"), F.col("x.a")).alias("label"))
    la, lb = least.select(F.col("id").alias("a"), F.col("label").alias("la")), least.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    named = close.where("not first").join(la, "a", "left").join(lb, "b", "left")
    apart = named.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "n")
    pairs = _narrowed(close.where("first").select("a", "b", "n").unionByName(apart), sets, percent)
    release(sets.sparkSession, close)
    return pairs


def _open(members: DataFrame, classes: DataFrame | None) -> DataFrame:
    """(key, set_id, class) of the lists whose sets are not all in one class."""
    if classes is None:
        return members.select("key", "set_id", F.col("set_id").alias("class"))
    rows = members.join(classes, members.set_id == classes.id, "left").select("key", "set_id", F.coalesce("component", "set_id").alias("class"))
    mixed = rows.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("key")
    return rows.join(mixed, "key")


def _open_pairs(members: DataFrame, classes: DataFrame | None, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, n), repeated ones included, of all close pairs of different classes in the open lists, and the saved table it reads."""
    # Once classes are known, few lists are open; there the wide sketches are tested before a pair is made.
    wide = ["wide"] if classes is not None else []
    rows = save(_open(members, classes).join(sets.select("set_id", "n", "bits", *wide), "set_id"))
    names = (("set_id", "h"), ("n", "hn"), ("class", "hc"), ("bits", "hbits"), *((c, f"h{c}") for c in wide))
    once = F.col("set_id") < F.col("h")
    if wide:
        once = once & _widely_close(percent, "wide", "hwide", F.col("n") + F.col("hn"))
    # Both sides are the same rows, renamed after the join only, so that they share one shuffle.
    both = rows.alias("x").join(rows.alias("y"), F.col("x.key") == F.col("y.key"))
    both = both.select(*(F.col(f"x.{c}") for c, _ in names), *(F.col(f"y.{c}").alias(h) for c, h in names))
    met = both.where(once & (F.col("class") != F.col("hc")) & _close(percent))
    return met.select(F.col("set_id").alias("a"), F.col("h").alias("b"), (F.col("n") + F.col("hn")).alias("n")), rows


def _classed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, class) of every row of ``docs``; rows without a set have no class.

    A step costs the tasks of its shuffles however few rows it has.  So classes are formed twice only: from links with
    the heads of lists, and from the pairs of all sets in lists that are open then.
    """
    spark = docs.sparkSession
    table = save(set_table(docs, width, percent))
    sets = _sets(table)
    slim = save(table.select("doc_id", "text_key", "n_shingles", "set_id"))
    release(spark, table)
    members = _members(sets)
    shared = reduce(DataFrame.unionByName, members)
    tested = _head_pairs(shared, sets, percent)
    links = _linked(docs, sets, tested, width, percent)
    classes = component_stars(links)
    met, rows = _open_pairs(shared, classes, sets, percent)
    pairs = save(met.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
    release(spark, rows, tested, *members)
    if not pairs.isEmpty():
        known = classes.select(F.col("id").alias("a"), F.col("component").alias("b"))
        classes = component_stars(known.unionByName(_linked(docs, sets, pairs, width, percent)))
    release(spark, sets, pairs)
    named = slim.join(classes, slim.set_id == classes.id, "left")
    return named.select("doc_id", "text_key", "n_shingles", F.coalesce("component", "set_id").alias("class"))


def jaccard_classes(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text, ...): classes of linked sets.

    Sets of ``width``-word shingles are linked at a similarity of ``percent`` or more.  A component is named by its
    smallest doc_id.  Null and empty texts have no set and link with nothing; a null doc_id is never a name unless all
    ids of a class are null.  Equal sets are one set; repeated rows stay.
    """
    named = _classed(docs, width, percent)
    names = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("name"))
    out = named.where("class is not null").join(names, "class").select("doc_id", "n_shingles", F.col("name").alias("component_id"))
    alone = named.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def jaccard_keepers(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, text_key, copies): the row to keep of each class, and every row without a set.

    That is the row of the smallest id, of a null id only if the class has no other, of the smallest key among equal
    ids; ``copies`` counts its repetitions in ``docs`` (1 without a set: those link with nothing).
    """
    named = _classed(docs, width, percent)
    rows = named.where("class is not null").groupBy("class", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    kept = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "copies")).alias("one"))
    alone = named.where("class is null").select("doc_id", "text_key", F.lit(1).cast("long").alias("copies")).distinct()
    return kept.select("one.doc_id", "one.text_key", "one.copies").unionByName(alone)


def _pairs(docs: DataFrame, table: DataFrame, width: int, percent: int) -> DataFrame:
    """Saved (a, b), a < b: every two different sets of the saved ``table`` that reach the threshold.

    All sets of a list meet, whatever their classes; sizes and sketches bound their difference, then they are verified.
    """
    sets = _sets(table)
    members, parts = _members(sets), []
    for m in members:
        met, rows = _open_pairs(m, None, sets, percent)
        parts.append(save(met.distinct()))
        release(docs.sparkSession, rows)
    pairs = _narrowed(reduce(DataFrame.unionByName, parts).distinct(), sets, percent)
    release(docs.sparkSession, *members, *parts)
    return _linked(docs, sets, pairs, width, percent)


def jaccard_pairs(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(a, b), a < b: ids of every two different sets of ``docs`` with a similarity of ``percent`` or more.

    Unlike the classes, the pairs are all links, also those within a class; their number may grow with its square.
    Ids of sets are those of ``set_table``.
    """
    return _pairs(docs, save(set_table(docs, width, percent)), width, percent)


def jaccard_links(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, n_links) of every row of ``docs``: how many other rows have an equal or linked set.

    Rows without a set have no links.
    """
    table = save(set_table(docs, width, percent))
    pairs = _pairs(docs, table, width, percent)
    rows = table.where("set_id is not null").groupBy("set_id").agg(F.count("*").alias("rows"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(rows, F.col("b") == F.col("set_id")).groupBy(F.col("a").alias("id")).agg(F.sum("rows").alias("others"))
    links = rows.join(met, F.col("set_id") == F.col("id"), "left").select("set_id", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return table.join(links, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def op2_jaccard_join(spark, sf_dir) -> DataFrame:
    """The contract query over all documents."""
    return jaccard_classes(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT k, g FROM (
    SELECT k, unnest(CASE WHEN len(ws) >= 3 THEN [array_to_string(ws[i : i + 2], ' ') FOR i IN range(1, len(ws) - 1)]
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d
  )
), n AS (SELECT k, count(*) AS n FROM s GROUP BY k), p AS (
  SELECT a.k AS x, b.k AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.k = x JOIN n b ON b.k = y WHERE 100 * i >= 90 * (a.n + b.n - i)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (
  SELECT k AS a, k AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b
), c AS (SELECT r.a AS k, min(d.doc_id) AS component_id FROM r JOIN d ON d.k = r.b GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d JOIN c USING (k) LEFT JOIN n USING (k)
"""
