"""The BPE automaton against the public library and against the merges applied one by one."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from jobatlas.llm import bpe_automaton as bpe
from jobatlas.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def ids_of(packed):
    return np.frombuffer(bytes(packed), dtype="<u4").tolist()


def test_codes_and_decodes_every_row(spark, docs, library):
    rows = bpe.encode_decode(docs).collect()
    given = docs.select("doc_id", "text").collect()
    assert len(rows) == len(given)
    want = []
    for row in given:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        want.append((row.doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, tuple(ids_of(r.ids)), r.decoded) for r in rows), key=key) == sorted(want, key=key)
    again = bpe.decode_ids(bpe.encode_decode(docs)).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.decoded) for r in again if r.doc_id is not None) == sorted((r.doc_id is not None, r.doc_id, r.decoded) for r in rows if r.doc_id is not None)


def test_query_over_the_whole_table(spark, small, library):
    rows = {r.doc_id: r for r in QUERIES["op13_bpe_codec"](spark, small).collect()}
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(table)
    for doc in table:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        row = rows[doc.doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table_gives_none(no_docs):
    assert bpe.encode_decode(no_docs).collect() == []


def test_odd_words_equal_the_library(library):
    rng = random.Random(3)
    coder = bpe.WordCoder(bpe.default_vocabulary())
    words = ["<|endoftext|>x<|startoftext|>", "<|endoftext|<|endoftext|>", "İstanbul", "ΣΑΣ", "éa b", "日本½", "a" * 3000, "don'T'LL", "x</w>y", "\x1c\x1d", "\U0001f600!"]
    words += ["".join(rng.choice("inthearéOü'9!<|>") for _ in range(rng.randint(1, 16))) for _ in range(3000)]
    for word in words:
        assert ids_of(coder._word(word)) == library.encode(word, add_special_tokens=False).ids, word


def merged(word, merges):
    """The merges applied in order, each at all its places from the left."""
    out = list(word)
    for a, b in merges:
        i = 0
        while i + 1 < len(out):
            if out[i] == a and out[i + 1] == b:
                out[i : i + 2] = [a + b]
            i += 1
    return out


def test_automaton_of_random_merges():
    """Small alphabets make all the awkward cases: repeated letters, long runs, tables that are cleared."""
    rng = random.Random(11)
    for _ in range(60):
        known, merges = list("abc"), []
        while len(merges) < 12:
            a, b = rng.choice(known), rng.choice(known)
            if a + b not in known:
                known.append(a + b)
                merges.append((a, b))
        names = {t: i for i, t in enumerate(known)}
        automaton = bpe.MergeAutomaton(names, merges)
        table = bpe.CharacterTable(automaton, "")
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            got = table.encode(word)
            assert [known[t] for t in got] == merged(word, merges), (word, merges)
            assert all(automaton.follows(x, y) for x, y in zip(got, got[1:], strict=False))


def test_states_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    coder = bpe.WordCoder(bpe.default_vocabulary())
    for word in ("internationalisation", "understanding", "overthrown", "hinterland", "sentences", "thermometer") * 3:
        coder.words.clear(), coder.pieces.clear()
        assert ids_of(coder._word(word)) == library.encode(word, add_special_tokens=False).ids
    assert len(coder.table.states) < 100


def test_a_token_made_twice_is_refused():
    with pytest.raises(ValueError, match="two merges"):
        bpe.MergeAutomaton({t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc"])}, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])
