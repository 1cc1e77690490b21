"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobatlas.llm.common import id_bucket, map_batches, read_table, text_bytes
from jobatlas.llm.word_batches import Words, slices

#: Labelled rows sampled per language, and the distinct words kept of them, the most frequent first.
SAMPLE_ROWS, SAMPLE_WORDS = 400, 6000
#: Cells of the transition tables of all languages, longest run parsed by them, and bytes of text parsed at a time.
TABLE_CELLS, LONG_WORD, SLICE_BYTES = 1 << 25, 64, 16 << 20
#: Runs of letters by their category: word characters but digits, the underscore, and letter and other numbers.
_NUMBERS = "".join(chr(c) for c in range(0xB2, 0x1FC00) if unicodedata.category(chr(c)) in ("No", "Nl"))
_RUNS = re.compile(rf"[^\W\d_{re.escape(_NUMBERS)}]+")


@cache
def _letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.int8)
    for m in _RUNS.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        out[m.start() : m.end()] = 1
    return out


class SuffixAutomaton:
    """Recognises every substring of one text; transitions in one table keyed by state and character."""

    def __init__(self, text: str) -> None:
        self.size = len(text)
        step: list[dict[str, int]] = [{}]
        link, reach, last = [-1], [0], 0
        for ch in text:
            new = len(step)
            step.append({})
            link.append(0)
            reach.append(reach[last] + 1)
            p = last
            while p != -1 and ch not in step[p]:
                step[p][ch] = new
                p = link[p]
            if p != -1:
                q = step[p][ch]
                if reach[q] == reach[p] + 1:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    reach.append(reach[p] + 1)
                    link.append(link[q])
                    while p != -1 and step[p].get(ch) == q:
                        step[p][ch] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.step = {(s << 21) | ord(ch): to for s, row in enumerate(step) for ch, to in row.items()}

    def phrases(self, text: str) -> int:
        """Phrases of the cross-parse: each is the longest match at its start, or one unknown character."""
        get, count, i, n = self.step.get, 0, 0, len(text)
        while i < n:
            state, start = 0, i
            while i < n:
                to = get((state << 21) | ord(text[i]))
                if to is None:
                    break
                state = to
                i += 1
            if i == start:
                i += 1
            count += 1
        return count


def _letters(batch: pa.RecordBatch, at: int) -> list[list[str]]:
    return [_RUNS.findall(t.decode("utf-8", "replace").lower()) for t in batch.column(at).to_pylist()]


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS) -> dict[str, SuffixAutomaton]:
    """One automaton per language of ``labelled`` (doc_id, text, lang), from a bounded sample of its rows.

    The sample is chosen by a hash of id and text; rows without language or text teach nothing.
    """
    rows = labelled.where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_rows / n))))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / F.lit(1e6)
    sample = rows.where(draw < share[F.col("lang")]).select("lang", text_bytes().alias("body"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [(lang, w) for lang, ws in zip(batch.column(0).to_pylist(), _letters(batch, 1), strict=True) for w in ws]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["lang", "word"])

    words = map_batches(sample, run, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    kept = words.withColumn("place", place).where(F.col("place") <= sample_words).collect()
    text: dict[str, list[tuple[int, str]]] = {lang: [] for lang in counts}
    for r in kept:
        text[r.lang].append((r.place, r.word))
    return {lang: SuffixAutomaton(" " + " ".join(w for _, w in sorted(ws)) + " ") for lang, ws in sorted(text.items())}


class Table:
    """The cross-parse of one automaton as an array: what each state does with each of its most frequent characters.

    An entry is the row of the next state times four plus the phrases that end there.  A word with a character that has
    no column is left to the automaton itself.
    """

    def __init__(self, automaton: SuffixAutomaton, cells: int = TABLE_CELLS) -> None:
        self.automaton = automaton
        steps = np.fromiter(automaton.step.keys(), np.int64, len(automaton.step))
        to = np.fromiter(automaton.step.values(), np.int64, len(automaton.step))
        state, char = steps >> 21, steps & ((1 << 21) - 1)
        n = int(to.max(initial=0)) + 1
        known, often = np.unique(char, return_counts=True)
        columns = np.sort(known[np.argsort(-often, kind="stable")[: max(1, min(len(known), cells // n - 1))]])
        #: Column of each character: unknown ones share the last, known ones without a column have none (-1).
        self.width = len(columns) + 1
        self.column = np.full(1 << 21, self.width - 1, dtype=np.int16 if self.width < 1 << 15 else np.int32)
        self.column[known] = -1
        self.column[columns] = np.arange(len(columns))
        step = np.full((n, self.width), -1, dtype=np.int64)
        some = self.column[char] >= 0
        step[state[some], self.column[char[some]]] = to[some]
        # Where a phrase ends, the character is tried again from the start; unknown there, it is a phrase of its own.
        ends = (np.arange(n) > 0).astype(np.int64)[:, None]
        again = np.where(step[0] >= 0, step[0] * (4 * self.width), 1)
        self.move = np.where(step >= 0, step * (4 * self.width), again[None, :] + ends).astype(np.int64 if n * self.width >= 1 << 29 else np.int32).ravel()

    def phrases(self, words: list[str], codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each word with a space on either side; ``codes`` at ``starts`` are its ``sizes`` characters."""
        column = self.column[codes]
        space = int(self.column[32])
        odd = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(column < 0, out=odd[1:])
        plain = (odd[starts + sizes] == odd[starts]) & (space >= 0) & (sizes <= LONG_WORD)
        out = np.zeros(len(words), dtype=np.int64)
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self.automaton.phrases(f" {words[i]} ")
        rest = np.flatnonzero(plain)
        rest = rest[np.argsort(-sizes[rest], kind="stable")]
        first, left = starts[rest], sizes[rest]
        at = self.move[np.full(len(rest), max(space, 0))]
        count, row = at & 3, at >> 2
        for k in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -k))
            at = self.move[row[:n] + column[first[:n] + k]]
            count[:n] += at & 3
            row[:n] = at >> 2
        at = self.move[row + max(space, 0)]
        # A phrase is open at the end unless the last character was unknown.
        out[rest] = count + (at & 3) + (at >> 2 > 0)
        return out


class Parser:
    """Counts the phrases of texts for every language at once; each distinct run of letters of a batch is parsed once.

    The parse starts anew at each run, written with a space on either side, so that its counts are the same wherever it
    stands.  Rare and very long runs are left to the automata.
    """

    def __init__(self, automata: dict[str, SuffixAutomaton]) -> None:
        self.names = list(automata)
        self.weight = np.array([math.log2(max(2, a.size)) for a in automata.values()])
        self.tables = [Table(a, TABLE_CELLS // len(automata)) for a in automata.values()]

    def _totals(self, texts: pa.Array) -> np.ndarray:
        """Phrases of each text (rows) for each language (columns)."""
        words = Words(texts)
        lines = words.lines().lower()
        codes = np.frombuffer(lines.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = np.zeros(len(codes) + 2, dtype=np.int8)
        letter[1:-1] = _letter_table()[codes]
        edge = np.diff(letter)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        runs = pa.array([lines[lo:hi] for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)], pa.large_string()).dictionary_encode()
        number = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.unique(number, return_index=True)[1]
        distinct = runs.dictionary.to_pylist()
        word = np.searchsorted(np.flatnonzero(codes == 10), starts)
        out = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        for k, table in enumerate(self.tables):
            each = table.phrases(distinct, codes, starts[first], (ends - starts)[first])
            counts = np.bincount(word, weights=each[number], minlength=len(words.dictionary)).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(counts[words.index])])[words.ends]
            out[:, k] = np.diff(sums, prepend=0)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n = len(texts)
        if not self.names:
            return ["und"] * n, np.zeros(n)
        totals = self._totals(texts)
        costs = totals * self.weight
        best = costs.argmin(axis=1)
        low = costs[np.arange(n), best]
        rest = np.partition(costs, 1, axis=1)[:, 1] if len(self.names) > 1 else 2 * low
        some = totals.any(axis=1)
        score = np.where(some, 1.0 - low / np.where(some, rest, 1.0), 0.0)
        return [self.names[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)], score


_parsers: dict[str, Parser] = {}


def _parser(name: str, automata: dict[str, SuffixAutomaton]) -> Parser:
    """The worker's parser of one model; tasks of one worker share what it remembers."""
    if name not in _parsers:
        _parsers.clear()
        _parsers[name] = Parser(automata)
    return _parsers[name]


def identify_languages(docs: DataFrame, held_out_bucket: int = 2, buckets: int = 4) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang, ...).

    Learns from rows of the other id buckets.  The language with the fewest phrases, each weighted with the bits that
    name a place in that language's text, wins; ties go to the first name.  ``score`` is the share by which it needs
    less than the next one.  Null texts and texts without a letter are ``und`` with score 0; so is all if nothing
    could be learnt.  A null id is neither held out nor learnt from.
    """
    bucket = id_bucket("doc_id", buckets)
    automata = learn(docs.where(bucket != held_out_bucket))
    name = uuid.uuid4().hex

    def run(batches):
        parser = _parser(name, automata)
        for batch in batches:
            for part in slices(batch, "body", SLICE_BYTES):
                names, score = parser.predict(part.column("body"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(bucket == held_out_bucket, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, text_bytes().alias("body")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark, sf_dir) -> DataFrame:
    """The contract query over all documents."""
    return identify_languages(read_table(spark, sf_dir, "documents"))
