"""Best-two-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobatlas.llm.common import Memo, read_table, save, text_bytes
from jobatlas.llm.word_batches import Words, binary_column, slices, taken

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0
#: Words in these characters alone are cut and lower-cased without the tokenizer's own normalizer.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: Pieces of such words, which stand in lines; the end of a line is a piece of its own.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+|\n")
#: What sends a word to the tokenizer's own normalizer.
_ODD = re.compile(r"<\||[^!-~À-ÖØ-öø-ÿ\n]")
#: Bytes of text tokenized at a time, and pieces remembered from one batch to the next.
TEXT_BYTES, KNOWN_PIECES = 8 << 20, 200_000


class WordTokenizer:
    """Token ids of whole texts as little-endian bytes; words and their pieces are encoded once and remembered.

    The vocabulary's normalizer and splitter never look across ASCII white space, so a text's ids are those of its
    words one after the other.  Words outside the plain characters, or with the form of a special token, go through
    the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.visible = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.visible_lines = {b: c for b, c in self.visible.items() if b != 10}
        self.known: dict[str, bytes] = {}
        self.pieces, self.words = Memo(self._piece, 100_000), Memo(self._word, 100_000)

    def _piece(self, piece: str) -> bytes:
        text = piece.encode().decode("latin-1").translate(self.visible)
        return np.array([t.id for t in self.model.tokenize(text)], dtype="<u4").tobytes()

    def _word(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces without white space, all not remembered ones at once."""
        found = list(map(self.known.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            shown = "\n".join([pieces[i] for i in new]).encode().decode("latin-1").translate(self.visible_lines).split("\n")
            tokens = [[t.id for t in self.model.tokenize(p)] for p in shown]
            flat = np.fromiter(chain.from_iterable(tokens), "<u4").tobytes()
            if len(self.known) + len(new) > KNOWN_PIECES:
                self.known.clear()
            at = 0
            for i, own in zip(new, tokens, strict=True):
                to = at + 4 * len(own)
                found[i] = flat[at:to]
                at = to
            self.known.update((pieces[i], found[i]) for i in new[:KNOWN_PIECES])
        return found

    def batch(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids, ends per text) of a column of texts, ``end`` after each; a distinct piece is looked up once."""
        words = Words(texts)
        n, lines = len(words.dictionary), words.lines()
        breaks = np.flatnonzero(np.frombuffer(lines.encode("utf-32-le"), dtype="<u4") == 10)
        own = np.unique(np.searchsorted(breaks, [m.start() for m in _ODD.finditer(lines)])).astype(np.int64)
        others = []
        if len(own):
            each = lines.split("\n")
            for i in own.tolist():
                others.append(self.words[each[i]])
                each[i] = ""
            lines = "\n".join(each)
        pieces = pa.array(_PIECES.findall(lines.lower()), pa.large_string()).dictionary_encode()
        known = pieces.dictionary.to_pylist()
        index = pieces.indices.to_numpy(zero_copy_only=False)
        stop = known.index("\n") if n > 1 else len(known)
        values = self._pieces([p for p in known if p != "\n"])
        if n > 1:
            values.insert(stop, b"")
        stops = np.append(np.flatnonzero(index == stop), len(index))[:n]
        each = binary_column(*taken(pa.array(values, pa.large_binary()), index, stops), pa.large_binary())
        place = np.arange(n)
        place[own] = n + np.arange(len(own))
        words.index = place[words.index]
        return words.spread(pa.concat_arrays([each, pa.array(others, pa.large_binary())]), end)

    def ids(self, text: bytes) -> bytes:
        """Ids of one text."""
        return b"".join(self.words[w.decode("utf-8", "replace")] for w in text.split())


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer; tasks of one worker share what it remembers."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def default_vocabulary() -> str:
    """Place of the vocabulary file."""
    return public_tokenizers.path("word_bpe_49k.json")


def piece_table(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text, ...), with their place among the equally long ones of a task."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        tokenizer = word_tokenizer(path)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "body", TEXT_BYTES):
                flat, ends = tokenizer.batch(part.column("body"), end)
                ends //= 4
                sizes = np.diff(ends, prepend=0)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                place = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = place * capacity
                length = np.minimum(sizes[row] - start, capacity)
                low = (ends - sizes)[row] + start
                buffer = memoryview(flat)
                crcs = [zlib.crc32(buffer[lo : lo + n]) for lo, n in zip((4 * low).tolist(), (4 * length).tolist(), strict=True)]
                # Number among the equally long pieces of this task.
                order = np.argsort(length, kind="stable")
                run_starts = np.searchsorted(length[order], length[order])
                among = np.empty(len(row), dtype=np.int64)
                among[order] = np.arange(len(row)) - run_starts + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(place, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(among)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
    return save(docs.select("doc_id", text_bytes().alias("body")).mapInArrow(run, schema))


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how often, [(length, copies), ...]) that use up ``counts`` (length to number).

    A bin is filled with the longest that fit.  Then its shortest document makes room for the two unpacked ones that
    fill the widened gap best, if they fill it better.  A bin is used as often as the counts allow.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    sizes = np.arange(capacity + 1)
    while left.any():
        free = left.copy()
        fits = np.maximum.accumulate(np.where(free > 0, sizes, 0))
        gap, own = capacity, defaultdict(int)
        while gap > 0:
            best = int(fits[gap])
            while best and not free[best]:
                best = int(fits[best - 1])
            if not best:
                break
            k = min(int(free[best]), gap // best)
            own[best] += k
            free[best] -= k
            gap -= k * best
        if gap and len(own):
            low = min(own)
            room = gap + low
            free[low] += 1
            fits = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            a = np.flatnonzero(free[: room + 1])
            b = fits[np.minimum(room - a, a)]
            # The same length twice needs two of it.
            single = (b == a) & (free[a] < 2)
            b = np.where(single, fits[np.maximum(b - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if len(total) and total.max() > low:
                i = int(total.argmax())
                own[low] -= 1
                own[int(a[i])] += 1
                own[int(b[i])] += 1
        bin_ = [(x, k) for x, k in sorted(own.items(), reverse=True) if k]
        often = min(int(left[x]) // k for x, k in bin_)
        for x, k in bin_:
            left[x] -= often * k
        out.append((often, bin_))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (doc_id, text, ...).

    Documents end with END; longer ones are cut into pieces of ``capacity``.  Only the number of pieces of each length,
    at most ``capacity`` figures, reaches the driver; the plan made of it is as small, and every piece finds its place
    in it by its rank among equals.  A null or empty text is one END; null and repeated ids are packed row by row; an
    empty table gives no piece.
    """
    pieces = piece_table(docs, capacity, vocabulary)
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    per_task = per_task.withColumn("before", F.coalesce(before, F.lit(0))).select("length", "task", "before")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, used, sequence = [], defaultdict(int), 0
    for often, bin_ in best_two_fit(counts, capacity):
        offset = 0
        for length, k in bin_:
            rows.append((length << 44 | used[length], used[length], sequence, offset, k))
            used[length] += often * k
            offset += length * k
        sequence += often
    keys, first, base, offsets, copies = (np.array(c, dtype=np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 5

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            q = rank - first[at]
            where = (base[at] + q // copies[at], offsets[at] + q % copies[at] * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x) for x in where)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(per_task, ["length", "task"]).withColumn("rank", F.col("before") + F.col("place"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)


def op4_best_fit_packing(spark, sf_dir) -> DataFrame:
    """The contract query over all documents."""
    return pack(read_table(spark, sf_dir, "documents"))
