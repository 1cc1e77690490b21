import random

import pyarrow as pa
import pytest
from jobatlas.operators import matching, spans

COLUMNS = ["key", "start", "end", "size", "taxonomy_order", "skill", "alias"]


def brute(rows):
    """Greedy choice per text over all its rows."""
    kept = []
    for key in {r[0] for r in rows}:
        own = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[3], r[1], r[4], r[2], r[5], r[6])):
            if all(r[1] >= o[2] or o[1] >= r[2] for o in own):
                own.append(r)
        kept += own
    return kept


def batches(rows, size):
    table = pa.Table.from_pylist([dict(zip(COLUMNS, r, strict=True)) for r in rows])
    return table.to_batches(max_chunksize=size)


@pytest.mark.parametrize("hold", [1, 7, 1 << 16])
def test_walk_over_any_batches_equals_brute_force(hold, monkeypatch):
    """Clusters and texts that end in the middle of a batch, a text that is one cluster, equal spans of two skills."""
    monkeypatch.setattr(spans, "ROWS", hold)
    rng = random.Random(hold)
    rows = []
    for key in range(60):
        for _ in range(rng.randint(1, 30)):
            start, size = rng.randint(0, 60) << 30, rng.randint(1, 4)
            order = rng.randint(0, 5)
            rows.append((key, start, start + (size << 30), size, order, f"s{order % 4}", f"a{size}"))
    rows += [(60, i << 32, (i + 2) << 32, 1 + i % 2, i % 3, f"s{i % 3}", "x") for i in range(300)]
    rows.sort(key=lambda r: r[:3])
    want = brute(rows)
    got = [tuple(r[c] for c in COLUMNS if c != "size") for b in spans.kept_rows(batches(rows, 11)) for r in b.to_pylist()]
    assert sorted(got) == sorted(r[:3] + r[4:] for r in want)
    lists = [(r["key"], r["skills"]) for b in spans.kept_skills(batches(rows, 11)) for r in b.to_pylist()]
    assert lists == [(k, [s for _, s in sorted({(r[4], r[5]) for r in want if r[0] == k})]) for k in range(61)]
    assert list(spans.kept_skills([])) == []


def test_mentions_are_sorted_once_and_not_collected_by_cluster(spark):
    names = spark.createDataFrame([("a b", [], 0), ("b", [], 1)], "name string, aliases array<string>, taxonomy_order int")
    texts = spark.createDataFrame([(1, "a b c"), (2, "c")], "id long, text string")
    tagged = matching.tag_skills(texts, matching.alias_table(names))
    assert [(r.id, r.skills) for r in tagged.collect()] == [(1, ["a b"])]
    assert "Window" not in tagged._jdf.queryExecution().optimizedPlan().toString()
    assert [r.skill for r in matching.resolve_overlaps(matching.alias_mentions(texts, matching.alias_table(names))).collect()] == ["a b"]


def test_an_alias_that_overlaps_itself_needs_no_second_cut_of_its_text(spark):
    """Equal aliases of two skills each keep their own; nothing but the texts with a negation is joined again."""
    names = spark.createDataFrame([("a a", [], 0), ("other", ["a a"], 1), ("a", [], 2)], "name string, aliases array<string>, taxonomy_order int")
    texts = spark.createDataFrame([(1, "a a a a a"), (2, "c a a, a a a"), (3, "not c a a a a")], "id long, text string")
    table = matching.alias_table(names)
    found = sorted((r.id, r.skill, r.start >> 32) for r in matching.alias_mentions(texts, table).where("alias = 'a a'").collect())
    at = {1: [1, 5], 2: [3, 7], 3: [5, 9]}
    assert found == [(i, s, p) for i in at for s in ("a a", "other") for p in at[i]]
    assert {r.id: r.skills for r in matching.tag_skills(texts, table).collect()} == {1: ["a a", "a"], 2: ["a a", "a"], 3: ["a a"]}
