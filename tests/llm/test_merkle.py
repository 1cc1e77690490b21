"""The Merkle manifest against a plain recursive version."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobatlas.llm import merkle
from jobatlas.llm.queries import QUERIES

FIELDS = "doc_id", "source", "lang", "n_chars", "text"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves, fanout):
    """(last node, siblings of each leaf from below, fold function of each leaf)."""
    paths, nodes, members = [[] for _ in leaves], leaves, [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        above, groups = [], []
        for lo in range(0, len(nodes), fanout):
            kids = nodes[lo : lo + fanout]
            for k in range(len(kids)):
                for i in members[lo + k]:
                    paths[i].append((k, kids))
            above.append(sha(*kids))
            groups.append([i for m in members[lo : lo + fanout] for i in m])
        nodes, members = above, groups
    return nodes[0], paths


def manifest(rows, fanout=16):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in sources:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        parts.append((own, *tree([leaf_of(r) for r in own], fanout)))
    root, upper = tree([p[1] for p in parts], fanout)
    out = []
    for (own, subroot, paths), above in zip(parts, upper, strict=True):
        for r, path in zip(own, paths, strict=True):
            steps = path + above
            held = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 or r[4] is None else (*r[:4], r[4].translate(lower))
            acc = leaf_of(held)
            for k, kids in steps:
                acc = sha(*kids[:k], acc, *kids[k + 1 :])
            proof = sha(*[d for k, kids in steps for i, d in enumerate(kids) if i != k])
            out.append((r[0], leaf_of(r), subroot, root, proof, acc, acc == root))
    return out


def found(docs, fanout=16):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered)
    proofs = merkle.merkle_proofs(docs, held, fanout)
    up = merkle.folded(F.col("found_leaf"), F.col("proof"))
    rows = proofs.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))), up).collect()
    return [(*r, r[5] == r[3]) for r in rows]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("fanout", [2, 16])
def test_messy_rows(docs, fanout):
    rows = [tuple(r[f] for f in FIELDS) for r in docs.collect()]
    assert ordered(found(docs, fanout)) == ordered(manifest(rows, fanout))


def test_query_over_the_whole_table(spark, small):
    rows = [tuple(r[f] for f in FIELDS) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in QUERIES["op12_merkle_manifest"](spark, small).collect()]
    assert ordered(got) == ordered(manifest(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_small_tables(spark, docs, no_docs):
    assert found(no_docs) == []
    one = docs.where("doc_id = 3")
    row = found(one)[0]
    assert row[1] == row[2] == row[3] == row[5] and row[4] == sha("")


def test_a_source_with_a_third_of_the_rows_and_many_lone_ones(spark):
    rows = [(i, None if i % 3 == 0 else f"s{i}", "en", 1, f"T{i}") for i in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert ordered(found(table)) == ordered(manifest(rows))
