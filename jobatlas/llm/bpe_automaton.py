"""BPE encoding and decoding with a deterministic automaton compiled out of the merges."""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.llm.common import Memo, read_table, text_bytes
from jobatlas.llm.word_batches import Words, binary_column, slices, taken

#: States of the character table kept at a time; words and pieces remembered at a time.
STATES, REMEMBERED = 100_000, 120_000
_NEVER = 1 << 62
#: Words in these characters alone are lower-cased and split without the vocabulary's own normalizer.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class MergeAutomaton:
    """Automaton over tokens that accepts exactly the sequences which the merges produce.

    It starts with one state and an arc for every single character.  Merges follow in order; the gadget of merge
    (u, v) works where an arc u leads to a state with an arc v.  Every arc u then leads to a copy of that state without
    v; every state with an arc u gets an arc uv to the state after v.  All arcs of one token lead to one state, so a
    state is named by its token, and a copy is written as "the state after v, as of this merge" (``copied``) with the
    arcs that were cut from it since (``cut``).  Whether an arc exists (``follows``) is read off these two tables.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.copied: dict[int, tuple[int, int]] = {}
        self.grown: dict[int, tuple[int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}
        made = {a + b for a, b in merges}
        #: Tokens that can occur, by their characters: single ones and results of merges that fire.
        self.tokens = {t: i for t, i in vocabulary.items() if t not in made}
        for time, (a, b) in enumerate(merges, 1):
            if a not in self.tokens or b not in self.tokens:
                continue
            self._gadget(self.tokens[a], self.tokens[b], vocabulary[a + b], time, a + b)

    def _gadget(self, u: int, v: int, uv: int, time: int, name: str) -> None:
        if name in self.tokens:
            raise ValueError(f"two merges make the token {name!r}")
        if not self.follows(u, v):
            return
        self.tokens[name] = uv
        self.copied[uv], self.grown[uv] = (v, time), (u, time)
        self.cut[u, v] = time

    def follows(self, before: int, token: int) -> bool:
        """Whether the state after ``before`` has an arc ``token``.

        It was cut itself, or the arc that it grew out of had been cut when it was made; cuts count up to the time of
        the copy that a state goes back to.
        """
        cut, copied, grown = self.cut, self.copied, self.grown
        state, until = before, _NEVER
        while True:
            arc, made = token, _NEVER
            while True:
                time = cut.get((state, arc))
                if time is not None and time < until and time <= made:
                    return False
                if arc not in grown:
                    break
                arc, made = grown[arc]
            if state not in copied:
                return True
            state, until = copied[state]


class _State:
    __slots__ = ("arcs", "last", "tips", "window")

    def __init__(self, window: str, tips: tuple[int, ...]) -> None:
        self.window, self.tips, self.last, self.arcs = window, tips, tips[-1], {}


class CharacterTable:
    """Deterministic table over characters: a state knows the last token of the text read so far.

    Every prefix has one correct sequence of tokens.  A state holds the longest end of what was read that a token may
    still begin with, and the last token at each place of it; the next character then decides the next last token.
    States and transitions are made when first met and looked up from then on.
    """

    def __init__(self, automaton: MergeAutomaton, suffix: str = "</w>") -> None:
        self.automaton, self.suffix = automaton, suffix
        self.inner, self.final = {}, {}
        self.length: dict[int, int] = {}
        for name, token in automaton.tokens.items():
            ends = bool(suffix) and name.endswith(suffix) and name != suffix
            (self.final if ends else self.inner)[name[: -len(suffix)] if ends else name] = token
            self.length[token] = len(name) - len(suffix) * ends
        if not suffix:
            self.final = self.inner
        self.starts = {name[:k] for table in (self.inner, self.final) for name in table for k in range(len(name))}
        self._clear()

    def _clear(self) -> None:
        self.root = _State("", (-1,))
        self.states: dict[tuple, _State] = {("", (-1,)): self.root}
        self.ends: dict[tuple[int, str], int] = {}

    def _last(self, state: _State, read: str, tokens: dict[str, int]) -> int:
        for k in range(len(read)):
            token = tokens.get(read[k:])
            if token is not None and (state.tips[k] < 0 or self.automaton.follows(state.tips[k], token)):
                return token
        raise ValueError(f"no token for {read[-1]!r}")

    def _step(self, state: _State, character: str) -> _State:
        read = state.window + character
        tips = (*state.tips, self._last(state, read, self.inner))
        skip = next(k for k in range(len(read) + 1) if read[k:] in self.starts)
        key = (read[skip:], tips[skip:])
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = _State(*key)
        state.arcs[character] = target
        return target

    def encode(self, piece: str) -> list[int]:
        """Tokens of one pre-split word (not empty)."""
        if len(self.states) > STATES:
            self._clear()
        state, lasts = self.root, []
        for character in piece[:-1]:
            state = state.arcs.get(character) or self._step(state, character)
            lasts.append(state.last)
        final = (piece[-1], "end")
        token = state.arcs.get(final)
        if token is None:
            token = state.arcs[final] = self._last(state, state.window + piece[-1], self.final)
        out, at = [token], len(piece) - self.length[token]
        while at:
            token = lasts[at - 1]
            out.append(token)
            at -= self.length[token]
        out.reverse()
        return out


class WordCoder:
    """Token ids of words as little-endian bytes, and the arc labels of ids.

    The vocabulary's normalizer and splitter never look across ASCII white space, so a text's ids are those of its
    words one after the other.  Words with characters beyond the plain ones are normalized and split by the public
    library; the merges are always those of the table.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model = parts["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.table = CharacterTable(MergeAutomaton(model["vocab"], merges), model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.visible = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        names = dict(model["vocab"]) | self.special
        labels = [""] * (max(names.values()) + 1)
        for name, token in names.items():
            labels[token] = name
        #: Label of every id with the space that stands between labels.
        self.labels = pa.array([(x + " ").encode() for x in labels], pa.large_binary())
        self.pieces, self.words = Memo(self._piece, REMEMBERED), Memo(self._word, REMEMBERED)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._packed(self.table.encode(piece.encode().decode("latin-1").translate(self.visible)))

    def _word(self, word: str) -> bytes:
        if "<|" not in word and _PLAIN.fullmatch(word):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))
        ids: list[int] = []
        for i, part in enumerate(self.at_special.split(word)):
            if i % 2:
                ids.append(self.special[part])
            elif part:
                for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    ids.extend(self.table.encode(piece))
        return self._packed(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as bytes, where each text's end)."""
        return Words(texts).gather(self.words.__getitem__)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(labels as bytes, a space after each; where each text's end) of ids whose texts end at ``ends``."""
        return taken(self.labels, ids.astype(np.int64), ends)


_coders: dict[str, WordCoder] = {}


def word_coder(path: str) -> WordCoder:
    """The worker's coder; tasks of one worker share its table."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def default_vocabulary() -> str:
    """Place of the vocabulary file."""
    return public_tokenizers.path("word_bpe_49k.json")


def _decoded(coder: WordCoder, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Text column: labels joined by single spaces."""
    flat, stops = coder.decode(ids, ends)
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    inner = np.ones(len(flat), dtype=bool)
    inner[stops[stops > starts] - 1] = False
    return binary_column(flat[inner], np.cumsum(stops - starts - (stops > starts)), pa.string())


def encode_decode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs`` (doc_id, text, ...).

    ``ids`` are little-endian unsigned 32-bit integers, as the vocabulary's own encoder gives them without special
    tokens added; strings of special tokens in a text become their ids.  ``decoded`` are the labels of the ids joined
    by spaces.  A null or empty text, or one of white space, has no ids and an empty ``decoded``; texts of any length
    are coded whole; rows with null or repeated ids are coded one by one; extra columns are ignored; an empty table
    gives an empty one.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        coder = word_coder(path)
        for batch in batches:
            for part in slices(batch, "body"):
                flat, ends = coder.encode(part.column("body"))
                decoded = _decoded(coder, flat.view("<u4"), ends // 4)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), binary_column(flat, ends), decoded], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", text_bytes().alias("body")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def decode_ids(coded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, decoded) of a table (doc_id, ids) as ``encode_decode`` gives it; null ids count as none."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        coder = word_coder(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                column = [x or b"" for x in part.column("ids").to_pylist()]
                ends = np.cumsum([len(x) // 4 for x in column])
                decoded = _decoded(coder, np.frombuffer(b"".join(column), dtype="<u4"), ends)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), decoded], ["doc_id", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def op13_bpe_codec(spark, sf_dir) -> DataFrame:
    """The contract query over all documents."""
    coded = encode_decode(read_table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
