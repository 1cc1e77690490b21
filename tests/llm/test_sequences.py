"""Packing, token counts, archives and the pipeline."""

import base64
import gzip
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from jobatlas.llm import packing, token_counts, warc
from messy import rows
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(packing.default_vocabulary())


def test_ids_equal_those_of_the_tokenizer(whole, spark, small):
    own = packing.WordTokenizer(packing.default_vocabulary())
    texts = [r[1] or "" for r in rows()] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(60).collect()]
    texts += ["I'll don't IT'S '", "á ́b ÅÅ İΣ σ", "x y z\x1cq\x85r", "µª² ½3 ﬁ \U0001f600"]
    for t in texts:
        assert np.frombuffer(own.ids(t.encode()), dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_a_batch_of_texts_has_the_ids_of_each(whole):
    """Each distinct piece is looked up once, however many words hold it; also without words, and with one."""
    own = packing.WordTokenizer(packing.default_vocabulary())
    texts = [r[1] or "" for r in rows()] + ["I'll don't IT'S ' !!'s x's", "á ́b ÅÅ İΣ σ <|x", "ß ÀÖ÷ \x7f 12a", "Word word, WORD!! word. (word) wörd"]
    for some in (texts, ["", "  "], ["one"], ["σ"], []):
        flat, ends = own.batch(pa.array([t.encode() for t in some], pa.binary()), np.array([7], dtype="<u4").tobytes())
        got = [a.view("<u4").tolist() for a in np.split(flat, ends[:-1])] if some else []
        assert got == [[*whole.encode(t, add_special_tokens=False).ids, 7] for t in some]
    asked = []
    own._pieces = lambda pieces: asked.extend(pieces) or packing.WordTokenizer._pieces(own, pieces)
    own.batch(pa.array([b"Word word, WORD!! word. (word) x", b"word, x!! (word)"], pa.binary()), b"")
    assert sorted(asked) == sorted({"word", ",", "!!", ".", "(", ")", "x"})


def test_every_piece_has_a_place(docs, no_docs, whole):
    got = packing.pack(docs, capacity=256).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    want = defaultdict(list)
    for r in rows():
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, lo in enumerate(range(0, len(ids), 256)):
            own = ids[lo : lo + 256]
            want[r[0]].append((k, lo, len(own), zlib.crc32(own.tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(no_docs).count() == 0


def test_best_two_fit_uses_all_and_packs_tightly():
    rng = random.Random(2)
    for _ in range(20):
        counts = Counter(min(100, int(rng.expovariate(0.05)) + 1) for _ in range(rng.randint(1, 400)))
        plan = packing.best_two_fit(dict(counts), 100)
        used = Counter()
        for often, own in plan:
            assert sum(x * k for x, k in own) <= 100
            used.update({x: k * often for x, k in own})
        assert used == counts
        total = sum(x * n for x, n in counts.items())
        assert sum(o for o, _ in plan) <= -(-total // 100) * 1.1 + 1
    assert sum(o for o, _ in packing.best_two_fit({60: 1, 10: 1, 25: 1, 14: 1, 30: 0}, 100)) == 2


def test_the_replacement_step_fits_more_tightly():
    # 50 + 30 leaves 20; without 30 the gap of 50 takes 29 + 21 exactly.
    plan = packing.best_two_fit({50: 1, 30: 1, 29: 1, 21: 1}, 100)
    assert [(50, 1), (29, 1), (21, 1)] in [own for _, own in plan]


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_token_counts_are_those_of_the_texts(docs, no_docs, whole, block, monkeypatch):
    monkeypatch.setattr(token_counts, "MANIFEST_DOCS", 4)
    manifest = token_counts.write_token_files(docs)
    files = manifest.groupBy("file").agg({"tokens": "sum"}).toDF("file", "tokens")
    found = Counter(r.n_tokens for r in token_counts.scan_separators(files, block).collect())
    size = lambda t: len(whole.encode(t or "", add_special_tokens=False).ids)
    assert found == Counter(size(r[1]) for r in rows())
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs).collect()) == Counter((r[0], size(r[1])) for r in rows())
    assert token_counts.token_counts(no_docs).count() == 0


PAGES = [
    (3, "http://a", "<p>x</p>", 1), (1, "http://b", "<p>x</p>", 1), (2, None, None, 1), (4, "u", "", 1), (5, "r\r\nn", "é" * 5000, 1), (1, "again", "<p>x</p>", 1),
    (None, "null", "<p>x</p>", 1), (None, "only null", "nobody", 1), (7, "h", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", 1), (8, "big", "y" * 3_000_000, 1),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, revisit int").repartition(3)
    archives = warc.write_archives(pages)
    got = warc.read_archives(archives).collect()
    assert all(r.digest_ok for r in got)
    low = {}
    for i, _, html, _ in PAGES:
        if i is not None:
            low[html or ""] = min(low.get(html or "", i), i)
    want = Counter()
    for i, _, html, _ in PAGES:
        body = (html or "").encode()
        first = low.get(html or "")
        again = first is not None and first != i
        want[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    texts = Counter((html or "").encode() for i, _, html, _ in PAGES if low.get(html or "") in (None, i))
    assert Counter(bytes(r.payload) for r in got if r.record_type == "response") == texts
    for r in archives.collect():
        plain = gzip.decompress(open(r.archive.removeprefix("file:"), "rb").read())
        assert plain.count(b"WARC-Record-ID") == r.records and os.path.getsize(r.archive.removeprefix("file:")) == r.bytes
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_small_payloads_respond_themselves(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "longer"), (4, "d", "longer")], "page_id long, url string, html string")
    assert {r.page_id: r.revisit for r in warc.mark_revisits(pages, 3).collect()} == {1: False, 2: False, 3: False, 4: True}


def test_broken_archives_are_refused():
    import io

    member = warc.record(1, "u", b"abc", None, False)
    assert [b for _, b in warc.records(io.BytesIO(member * 2))][0].endswith(b"abc")
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(member[:-9])))
