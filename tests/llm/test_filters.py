"""Quality rules, quality classifier, language identification."""

import re
import zlib

import numpy as np
from jobatlas.llm import language_id, quality_classifier, quality_rules
from messy import rows
from pyspark.sql import functions as F


def counters(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_counters_and_base_verdict_match_brute_force(docs):
    got = quality_rules.quality_verdicts(docs, always=quality_rules.COUNTERS).collect()
    want = sorted((r[0] is None, r[0] or 0, *counters(r[1])) for r in rows() if len(r[1] or "") < 4000)
    have = sorted((r.doc_id is None, r.doc_id or 0, *(r[c] for c in quality_rules.COUNTERS)) for r in got if r.n_words < 900)
    assert have == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_order_changes_no_verdict(docs, no_docs):
    names = list(quality_rules.RULES)
    runs = [sorted((r.doc_id or -1, r.kept) for r in quality_rules.quality_verdicts(docs, order=o).collect()) for o in (names, names[::-1])]
    assert runs[0] == runs[1] == sorted((r.doc_id or -1, r.kept) for r in quality_rules.quality_verdicts(docs, always=("n_words",)).collect())
    assert quality_rules.quality_verdicts(no_docs).count() == 0


def test_cascade_order_prefers_rejection_per_cost():
    rules = dict.fromkeys("abc", lambda s: True)
    assert quality_rules.cascade_order({"a": (0.1, 1.0), "b": (0.5, 1.0), "c": (0.5, 0.1)}, rules) == ["c", "b", "a"]


def test_classifier_on_held_out_rows_and_awkward_rows(spark, small, docs, no_docs):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = quality_classifier.quality_scores(spark.read.parquet(f"{small}/documents.parquet"), labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.9
    odd = quality_classifier.quality_scores(docs, labels).collect()
    assert len(odd) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert quality_classifier.quality_scores(no_docs, labels).count() == 0
    none = quality_classifier.quality_scores(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_labels_of_held_out_rows_have_no_effect(spark, small):
    documents, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality_classifier.quality_scores(documents, x).collect()) for x in (labels, turned))
    assert a == b


def test_isotonic_is_the_best_monotone_fit():
    assert np.allclose(quality_classifier.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)), [1, 2.5, 2.5, 4])


def test_automaton_finds_longest_matches():
    text = "abracadabra"
    automaton = language_id.SuffixAutomaton(text)
    for probe in ("abra", "cadcad", "xyz", "", "abrabra", "raca"):
        count, i = 0, 0
        while i < len(probe):
            k = max((k for k in range(1, len(probe) - i + 1) if probe[i : i + k] in text), default=1)
            i, count = i + k, count + 1
        assert automaton.phrases(probe) == count


def test_language_on_held_out_rows(spark, small, docs, no_docs):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    got = language_id.identify_languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    odd = language_id.identify_languages(docs).collect()
    assert len(odd) == len(rows()) and all(0 <= r.score <= 1 for r in odd)
    blank = {r[0] for r in rows() if not re.search(r"[^\W\d_]", r[1] or "") and r[0] is not None}
    assert blank == {r.doc_id for r in odd if r.lang_pred == "und" and r.doc_id is not None}
    assert language_id.identify_languages(no_docs).count() == 0


def test_numbers_like_letters_are_no_letters(spark):
    texts = ["² ½ ① Ⅷ", "12 _ 34", "", None, "the end ²"]
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(i, "the quick words of a plain text", "en") for i in range(10, 40)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify_languages(table).collect()}
    assert [got[i] for i in range(5)] == ["und", "und", "und", "und", "en"]


def test_runs_parsed_by_tables_count_as_the_automata_do(monkeypatch):
    """Rare characters without a column, unknown ones, long runs, capitals that grow or look around them, broken bytes."""
    rng = np.random.default_rng(4)
    learnt = {k: " " + " ".join("".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(300)) + " " for k, letters in {"x": "abcé", "y": "bcdσς", "z": "a中文字б"}.items()}
    automata = {k: language_id.SuffixAutomaton(t) for k, t in learnt.items()}
    texts = [r[1] or "" for r in rows()] + ["ΑΣ ΑΣΒ Σ", "İstanbul a̧b", "ab" * 90, "abc中d 字 бab", "a_b1c ²d", "éÉ, abc!! ABC\x1cdc\x85b"]
    texts += ["".join(rng.choice(list("abcdéσ中q ,"), 200)) for _ in range(30)]
    raw = [t.encode() for t in texts] + [b"ab\xff\xe4 c\xe4\xb8 ab"]
    for cells in (1 << 25, 3000, 1):
        monkeypatch.setattr(language_id, "TABLE_CELLS", cells)
        got = language_id.Parser(automata)._totals(language_id.pa.array(raw, language_id.pa.binary()))
        for t, own in zip(raw, got.tolist(), strict=True):
            runs = [w for part in t.split() for w in language_id._RUNS.findall(part.decode("utf-8", "replace").lower())]
            assert own == [sum(a.phrases(f" {w} ") for w in runs) for a in automata.values()], t
