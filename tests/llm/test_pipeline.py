"""Registered queries against their SQL twins, and the pipeline against brute force."""

import random
import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from jobatlas.llm.queries import ORACLES, QUERIES
from messy import prose, rows
from test_duplicates import classes, sets_of
from test_scans import matches


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    names = sorted(want.columns)
    rows = sorted(map(str, want.select(*names).fetchall()))
    got = QUERIES[name](spark, small)
    assert sorted(got.columns) == names
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == rows


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_stages_decide_as_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in step.collect()}
        step = spark.createDataFrame(stage(spark, step, small).collect(), step.schema)
        after = {r.doc_id: r.text for r in step.collect()}
        if name == "quality classifier":
            assert not bad & set(after) and len(good & set(after)) >= 0.95 * len(good)
        elif name == "near duplicates":
            own = sorted(before)
            assert set(after) == {i for i, _, c in classes(own, [before[i] for i in own], 5, 80) if i == c}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            assert set(after) == {i for i, t in before.items() if not matches(t, items)[1]}
        else:
            assert set(after) == set(before)
            changed = {i for i in after if after[i] != before[i]}
            assert changed == {i for i, t in before.items() if re.search(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}""", t)}
        assert step.columns == docs.columns
    packed = corpus_pipeline.STAGES[-1][1](spark, step, small)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(after)
    assert set(after) <= set(texts)


def test_run_equals_the_stages(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_stages_decide_each_row_of_the_messy_table(spark, docs, monkeypatch):
    shared, lone = rows()[6][1], " ".join(f"w{i}" for i in range(40))
    more = [(None, lone), (None, lone + " end"), (None, lone), (300, lone + " x"), (301, "k " * 30 + lone), (301, shared)]
    more += [(None, " ".join(f"v{i}" for i in range(40)) + " tail" * k) for k in (0, 1)] + [(400 + i, prose(random.Random(i), 60)) for i in range(40)] + [(500 + i, None) for i in range(40)]
    table = docs.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in more], docs.select(*corpus_pipeline.COLUMNS).schema))
    own = [(r[0], r[1]) for r in rows()] + more
    tables = {
        "labels": spark.createDataFrame([(400 + i, 1) for i in range(40)] + [(500 + i, 0) for i in range(40)], "doc_id long, quality int"),
        "benchmark": spark.createDataFrame([(1, " ".join(shared.split()[3:16]))], "item_id long, text string"),
    }
    monkeypatch.setattr(corpus_pipeline, "read_table", lambda spark, sf_dir, name: tables[name])
    got = {name: Counter((r[0], r[1]) for r in stage(spark, table, "").select(*corpus_pipeline.COLUMNS[:2]).collect()) for name, stage in corpus_pipeline.STAGES[:-1]}

    kept = got["quality classifier"]
    assert kept[6, shared] == 2 and kept[None, shared] == 1 and not kept[0, None] and not kept[None, None]
    items = [(1, tables["benchmark"].first().text)]
    assert got["decontamination"] == Counter(p for p in own if not matches(p[1], items)[1])
    assert got["decontamination"][None, None] == 1 and not got["decontamination"][None, shared]
    sets, classed = sets_of([t for _, t in own], 5), {}
    up = list(range(len(own)))
    for x, a in enumerate(sets):
        for y in range(x):
            if a and 100 * len(a & sets[y]) >= 80 * len(a | sets[y]):
                up = [up[x] if u == up[y] else u for u in up]
    for x, top in enumerate(up):
        classed.setdefault(top, []).append(own[x])
    kept = got["near duplicates"]
    assert sum(kept.values()) == len(classed)
    for group in classed.values():
        low = min((i for i, _ in group if i is not None), default=None)
        assert any(kept[i, t] for i, t in group if i == low)
    assert kept[6, shared] == 1 and not kept[None, shared] and sum(n for (i, t), n in kept.items() if i is None and t) == 1
    assert Counter(i for i, _ in got["secret redaction"].elements()) == Counter(i for i, _ in own)
    packed = corpus_pipeline.packing(spark, table, "").select("doc_id").distinct().collect()
    assert {r.doc_id for r in packed} == {i for i, _ in own}
