"""Merkle manifest of a dataset: one tree per source, one over the sources, and a proof for every document."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobatlas.llm.common import id_bucket, read_table, release, save

#: Children of an inner node.
FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of the running number within a partition in ``monotonically_increasing_id``.
_LOCAL_BITS = 33


def digest(text: Column) -> Column:
    """Lower-case hex sha256 of a string."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as its byte count, a colon and its value, or ``-`` where it is null."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def siblings(proof: Column) -> Column:
    """Digests beside the path, level by level upwards, from left to right."""
    return F.array_join(F.transform(proof, lambda s: F.array_join(F.filter(s.kids, lambda _, i: i != s.idx), "")), "")


def folded(leaf: Column, proof: Column) -> Column:
    """Root that follows from a leaf and its siblings."""

    def step(below: Column, s: Column) -> Column:
        return digest(F.array_join(F.transform(s.kids, lambda kid, i: F.when(i == s.idx, below).otherwise(kid)), ""))

    return F.aggregate(proof, leaf, step)


def _levels(count: int, fanout: int) -> int:
    """Levels above ``count`` nodes until one remains."""
    levels = 0
    while count > 1:
        count, levels = -(-count // fanout), levels + 1
    return levels


def _in_order(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their source's number ``s``, its size ``n`` and their place ``pos`` in it; and (s, n) per source.

    Leaves are sorted over range partitions.  Places follow from numbers within a partition and the few counts per
    partition and source, so a large source is spread over many tasks.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf")]
    ordered = save(leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("number", F.monotonically_increasing_id()))
    part = F.shiftright("number", _LOCAL_BITS)
    counts = save(ordered.groupBy("source", part.alias("part")).agg(F.count("*").alias("m"), F.min("number").alias("first")))
    # Numbers ascend with the sources, so the partition where a source begins tells how many come before it.
    starts = counts.groupBy("source").agg(F.min("first").alias("begin"), F.sum("m").alias("n")).withColumn("part", F.shiftright("begin", _LOCAL_BITS))
    begun = starts.groupBy("part").agg(F.count("*").alias("k"))
    earlier = F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part").orderBy("begin")) - 1
    sources = save(starts.join(begun.select("part", earlier.alias("earlier")), "part").select("source", "n", (F.col("earlier") + within).alias("s")))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("source", "part", "first", before.alias("before")).alias("c")
    places = places.join(sources.alias("s"), F.expr("c.source <=> s.source")).select("c.source", "part", "first", "before", "s", "n")
    rows = ordered.withColumn("part", part).alias("l").join(places.alias("p"), F.expr("l.part = p.part and l.source <=> p.source"))
    return rows.select("doc_id", "leaf", "found", "s", "n", (F.col("before") + F.col("number") - F.col("first")).alias("pos")), sources.select("s", "n")


def _run(column: str, fanout: int) -> Column:
    return F.floor(F.col(column) / fanout).cast("long")


def _climb(nodes: DataFrame, levels: int, top: bool, fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """(the last node of each tree, the written runs of each level) above ``nodes`` (tree, pos, count, key, digest)."""
    roots, runs = nodes.where("count = 1"), []
    for level in range(1, levels + 1):
        kid = F.struct("pos", "digest", "key")
        group = nodes.where("count > 1").groupBy("tree", _run("pos", fanout).alias("pos"), F.ceil(F.col("count") / fanout).cast("long").alias("count"))
        run = group.agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        run = run.withColumn("key", F.concat_ws("/", F.lit("top" if top else "source"), "tree", F.lit(str(level)), "pos"))
        runs.append(save(run.withColumn("digest", digest(F.array_join(F.col("kids.digest"), "")))))
        nodes = runs[-1].select("tree", "pos", "count", "key", "digest")
        roots = roots.unionByName(nodes.where("count = 1"))
    return roots, runs


def merkle_proofs(docs: DataFrame, found: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, found_leaf, subroot, root, proof) of every row of ``docs``.

    ``leaf`` is the digest of the row, ``found_leaf`` that of the row with the text ``found`` (what someone holds now; the
    row's own text if not given or null).  ``proof`` are the steps from the leaf to the root: the digests ``kids`` of a
    run, the own index ``idx`` among them, and whether the run is one of the tree over the sources (``top``).

    Leaves of a source are ordered by doc_id (nulls first, then by digest, so repeated and null ids have a place each);
    sources by their bytes, null first.  Inner nodes point to an ancestor and hold the steps up to it, at first their
    parent.  A round joins the table with itself: a node takes over the pointer of the one it points to and appends its
    steps, which doubles the distance, until all point to the root.  Leaves join last, with their run, so their
    proofs are never stored.  In a round of distance d at most ``fanout ** d`` nodes meet one key.

    Null, empty and long texts and null fields are hashed as they are; extra columns are ignored; an empty table gives
    no row.
    """
    spark = docs.sparkSession
    given = docs.select(*FIELDS, (F.col("text") if found is None else F.coalesce(found, F.col("text"))).alias("held"))
    same = F.col("held").eqNullSafe(F.col("text"))
    hashed = save(given.select(
        "doc_id", "source", leaf_digest(*map(F.col, FIELDS)).alias("leaf"),
        F.when(~same, leaf_digest(*map(F.col, FIELDS[:-1]), F.col("held"))).alias("found"),
    ))
    leaves, sources = _in_order(hashed)
    docs_of = F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", "found")))
    units = save(leaves.groupBy("s", "n", _run("pos", fanout).alias("pos")).agg(docs_of.alias("docs")).withColumn("key", F.concat_ws("/", F.lit("unit"), "s", "pos")))
    release(spark, hashed)
    own = F.when(F.col("n") == 1, F.get("docs.leaf", F.lit(0))).otherwise(digest(F.array_join("docs.leaf", "")))
    nodes = units.select(F.col("s").alias("tree"), "pos", F.ceil(F.col("n") / fanout).cast("long").alias("count"), "key", own.alias("digest"))
    size = sources.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.count("*").alias("s")).first()
    inner, outer = max(_levels(size.n, fanout) - 1, 0), _levels(size.s, fanout)
    subroots, runs = _climb(nodes, inner, False, fanout)
    subroots = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(size.s).alias("count"), "key", "digest")
    roots, top_runs = _climb(subroots, outer, True, fanout)

    steps = units.where("false").select("key", F.col("key").alias("ptr"), F.expr("array(named_struct('top', false, 'idx', 0, 'kids', array('')))").alias("steps"))
    for table, top in [(r, False) for r in runs] + [(r, True) for r in top_runs]:
        one = table.select(F.col("key").alias("ptr"), F.col("kids.digest").alias("kids"), F.posexplode("kids").alias("idx", "kid"))
        steps = steps.unionByName(one.select("kid.key", "ptr", F.array(F.struct(F.lit(top).alias("top"), "idx", "kids")).alias("steps")))
    root = roots.where("count = 1").first()
    steps, distance = save(steps), 1
    while distance < inner + outer:
        moving, up = steps.where(F.col("ptr") != root.key).alias("m"), steps.alias("u")
        joined = moving.join(up, F.expr("m.ptr = u.key")).select("m.key", "u.ptr", F.concat("m.steps", "u.steps").alias("steps"))
        further = save(steps.where(F.col("ptr") == root.key).unionByName(joined))
        release(spark, steps)
        steps, distance = further, 2 * distance

    leaf = F.explode("docs").alias("d")
    paths = units.join(steps.select("key", "steps"), "key", "left").select("n", "steps", F.col("docs.leaf").alias("kids"), leaf)
    step = F.struct(F.lit(False).alias("top"), (F.col("d.pos") % fanout).cast("int").alias("idx"), "kids")
    none = F.expr("cast(array() as array<struct<top: boolean, idx: int, kids: array<string>>>)")
    proof = F.concat(F.when(F.col("n") > 1, F.array(step)).otherwise(none), F.coalesce("steps", none))
    whole = F.lit(root.digest if root else None).cast("string")
    out = paths.select("d.doc_id", "d.leaf", F.coalesce("d.found", "d.leaf").alias("found_leaf"), proof.alias("proof"))
    crossing = F.get(F.filter("proof", lambda s: s.top), F.lit(0))
    subroot = F.coalesce(F.get(crossing["kids"], crossing["idx"]), whole)
    return out.select("doc_id", "leaf", "found_leaf", subroot.alias("subroot"), whole.alias("root"), "proof")


def op12_merkle_manifest(spark, sf_dir) -> DataFrame:
    """The contract query: every fifth id (by crc32) is found with its text in lower case."""
    docs = read_table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    proofs = merkle_proofs(docs, F.when(id_bucket("doc_id", 5) == 0, lowered))
    up = folded(F.col("found_leaf"), F.col("proof"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), up.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """Plain twin: runs of each level as lists, then one join per level and document; enough levels for 16 ** 7 rows."""
    field = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
    head = " || ".join(field.format(f) for f in FIELDS[:-1])
    text, lowered = field.format("text"), field.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    crc = (
        "xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), "
        "lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
    )
    out = [f"""WITH leaves AS (
  SELECT doc_id, source, sha256({head} || {text}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({head} || {lowered}) ELSE sha256({head} || {text}) END AS held
  FROM documents),
ranked AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM leaves),
a0 AS (SELECT s AS tree, pos, n, leaf AS h FROM ranked)"""]
    levels = 7

    def runs(name: str, level: int) -> str:
        return f""",
{name}r{level} AS (SELECT tree, pos // 16 AS pos, list(h ORDER BY pos) AS kids FROM {name}{level} WHERE n > 1 GROUP BY ALL),
{name}{level + 1} AS (
  SELECT tree, pos, (SELECT any_value((n + 15) // 16) FROM {name}{level} x WHERE x.tree = r.tree) AS n, sha256(array_to_string(kids, '')) AS h FROM {name}r{level} r
  UNION ALL SELECT tree, pos, n, h FROM {name}{level} WHERE n = 1)"""

    out += [runs("a", i) for i in range(levels)]
    out.append(f""",
b0 AS (SELECT 0 AS tree, tree AS pos, (SELECT count(*) FROM a{levels}) AS n, h FROM a{levels})""")
    out += [runs("b", i) for i in range(levels)]
    out.append(""",
f0 AS (SELECT doc_id, leaf, held AS acc, '' AS beside, s AS tree, s, pos FROM ranked)""")
    step = 0
    for name in "ab":
        for level in range(levels):
            tree, place = ("f.tree", "f.pos") if name == "a" else ("0", "f.s")
            own = f"({place} // {16**level}) % 16"
            out.append(f""",
f{step + 1} AS (
  SELECT f.doc_id, f.leaf, f.tree, f.s, f.pos,
    CASE WHEN r.kids IS NULL THEN f.acc ELSE sha256(array_to_string(r.kids[:{own}], '') || f.acc || array_to_string(r.kids[{own} + 2:], '')) END AS acc,
    CASE WHEN r.kids IS NULL THEN f.beside ELSE f.beside || array_to_string(r.kids[:{own}], '') || array_to_string(r.kids[{own} + 2:], '') END AS beside
  FROM f{step} f LEFT JOIN {name}r{level} r ON r.tree = {tree} AND r.pos = {place} // {16 ** (level + 1)})""")
            step += 1
    out.append(f"""
SELECT f.doc_id, f.leaf, x.h AS subroot, y.h AS root, sha256(f.beside) AS proof_sha256, f.acc AS folded_root, f.acc = y.h AS verified
FROM f{step} f JOIN a{levels} x ON x.tree = f.s CROSS JOIN b{levels} y""")
    return "".join(out)


OP12_SQL = _sql()
