"""Jaccard classes and removal of repeated byte strings, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from jobatlas.llm import jaccard_join, suffix_dedup
from jobatlas.operators import graph
from jobatlas.operators.graph import connected_components
from messy import prose, rows


def sets_of(texts, width=3):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def classes(ids, texts, width=3, percent=90):
    sets, up = sets_of(texts, width), list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            i = len(a & sets[y])
            if a and 100 * i >= percent * (len(a) + len(sets[y]) - i):
                up[top(x)] = top(y)
    names = {}
    for x, i in enumerate(ids):
        names.setdefault(top(x), []).append(i)
    low = {t: min((i for i in own if i is not None), default=None) for t, own in names.items()}
    return Counter((i, len(s), low[top(x)]) for x, (i, s) in enumerate(zip(ids, sets, strict=True)))


def check(spark, pairs, width=3, percent=90):
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs, width, percent).collect())
    assert got == classes([p[0] for p in pairs], [p[1] for p in pairs], width, percent)


def test_classes_of_awkward_rows(spark, no_docs):
    check(spark, [(r[0], r[1]) for r in rows()])
    assert jaccard_join.jaccard_classes(no_docs).count() == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_chains_of_small_edits(spark, width, percent):
    rng, pairs = random.Random(3), []
    for n in (9, 10, 12, 30, 80, 300):
        for base in range(2):
            words = prose(rng, n).split()
            for step in range(8):
                pairs.append((len(pairs), " ".join(words)))
                words[rng.randrange(n)] = f"w{n}x{base}x{step}"
            pairs.append((len(pairs), " ".join(words + ["one", "more"][: rng.randint(0, 2)])))
    rng.shuffle(pairs)
    check(spark, pairs, width, percent)


def test_links_within_a_class_are_all_returned(spark):
    rng, pairs = random.Random(4), [(r[0], r[1]) for r in rows()]
    for n in (12, 60, 300):
        words = prose(rng, n).split()
        for step in range(6):
            pairs += [(len(pairs), " ".join(words))] * (1 + step % 2)
            words[rng.randrange(n)] = f"w{n}x{step}"
    sets = sets_of([t for _, t in pairs], 5)
    alike = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    distinct = {frozenset(s) for s in sets if s}
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    found = jaccard_join.jaccard_pairs(docs, 5, 80).collect()
    assert len(found) == len(set(found)) == sum(alike(a, b) for a in distinct for b in distinct if a != b) // 2
    got = Counter((r.doc_id, r.n_shingles, r.n_links) for r in jaccard_join.jaccard_links(docs, 5, 80).collect())
    assert got == Counter((i, len(a), sum(alike(a, b) for b in sets) - bool(a)) for (i, _), a in zip(pairs, sets, strict=True))


def test_classes_take_few_steps(spark):
    rng, pairs = random.Random(5), []
    for n in (12, 60, 300):
        words = prose(rng, n).split()
        for step in range(40):
            copy = words[:]
            for place in rng.sample(range(n), 1 + n // 40):
                copy[place] = f"w{n}x{step}x{place}"
            pairs.append((len(pairs), " ".join(copy)))
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    spark.sparkContext.setJobGroup("classes", "classes")
    try:
        rows = jaccard_join.jaccard_classes(docs).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == classes([p[0] for p in pairs], [p[1] for p in pairs])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("classes"))
    assert jobs <= 60, jobs


def test_index_lists_take_one_shuffle_a_slice(spark, monkeypatch):
    rng, plans, write = random.Random(6), [], jaccard_join.save
    sets = [(i, [rng.randrange(-60, 60) for _ in range(12)] + [1000 + i, -1000 - i]) for i in range(-20, 20)]
    table = spark.createDataFrame([(i, sorted(set(keys))) for i, keys in sets], "set_id long, keys array<long>").repartition(3)
    monkeypatch.setattr(jaccard_join, "save", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    parts = jaccard_join._members(table)
    members = {}
    for i, keys in sets:
        for key in keys:
            members.setdefault(key, set()).add(i)
    rows = [r for part in parts for r in part.select("key", "set_id", "least", "other").collect()]
    assert Counter((r.key, r.set_id, r.least) for r in rows) == Counter((k, i, min(own)) for k, own in members.items() if len(own) > 1 for i in own)
    assert all(r.other == min(members[r.key], key=lambda i: i ^ r.key) for r in rows)
    assert len(plans) == len(parts) >= 4
    assert not any("Join" in plan for plan in plans)


@pytest.mark.parametrize("percent", [90, 80])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(1)
    for n in [*range(1, 60), 100, 250, 777]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
            gone = int(rng.integers(0, n // 4 + 1))
            more = int(rng.integers(0, n // 4 + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 62, more, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert np.intersect1d(jaccard_join.part_keys(a, percent), jaccard_join.part_keys(b, percent)).size


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (5, 5), (None, 1), (9, 8), (8, 7), (7, 6), (9, 6), (1, 2)], "a long, b long")
    assert {(r.id, r.component) for r in connected_components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 6), (9, 6)}
    assert connected_components(links.where("false")).count() == 0


def test_stars_are_written_as_they_are(spark, monkeypatch):
    links = spark.createDataFrame([(1, 4), (3, 1), (1, 2), (9, 8)], "a long, b long")
    rounds, small = [], graph._small_star
    monkeypatch.setattr(graph, "_small_star", lambda edges: rounds.append(1) or small(edges))
    assert {(r.id, r.component) for r in connected_components(links).collect()} == {(i, 1) for i in (1, 2, 3, 4)} | {(8, 8), (9, 8)}
    assert not rounds
    path = [(i, i + 1) for i in range(20)]
    assert {(r.id, r.component) for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()} == {(i, 0) for i in range(21)}


def removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        runs = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out.append((len(t), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 90])
def test_repeated_strings(spark, length):
    rng, pairs = random.Random(length), [(r[0], r[1]) for r in rows()]
    passage = prose(rng, 80)
    for i in range(12):
        cut = rng.randint(0, 200)
        pairs.append((100 + i, prose(rng, rng.randint(0, 40)) + passage[cut : cut + length - 3 + i] + prose(rng, 20)))
    pairs += [(200, "ab" * 300), (201, "é" * 150), (202, passage + passage)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeated(docs, length).collect())
    texts = [(t or "").encode() for _, t in pairs]
    assert got == Counter((i, *x) for (i, _), x in zip(pairs, removed(texts, length), strict=True))


def test_no_documents(no_docs):
    assert suffix_dedup.remove_repeated(no_docs).count() == 0
