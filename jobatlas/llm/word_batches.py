"""Whole texts as sequences of words, batch by batch: each distinct word is looked up once, all else is array work."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch`` with about ``size`` bytes of ``column`` each, in order."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


class Words:
    """Words (between ASCII white space) of a column of texts: ``index`` into ``distinct``, ``ends`` per text."""

    def __init__(self, texts: pa.Array) -> None:
        strings = pc.cast(texts, pa.large_string(), safe=False).fill_null("")
        words = pc.ascii_split_whitespace(strings)
        flat = words.flatten().dictionary_encode()
        filled = pc.utf8_length(flat.dictionary).to_numpy(zero_copy_only=False) > 0
        index = flat.indices.to_numpy(zero_copy_only=False)
        keep = filled[index] if len(index) else np.zeros(0, dtype=bool)
        counts = np.concatenate([[0], np.cumsum(keep)])
        offsets = words.offsets.to_numpy(zero_copy_only=False)
        self.ends = counts[offsets[1:] - offsets[0]]
        self.index = index[keep]
        self.dictionary: pa.Array = flat.dictionary

    @cached_property
    def distinct(self) -> list[str]:
        return self.dictionary.to_pylist()

    def lines(self) -> str:
        """The distinct words, a line each."""
        size, data = self.dictionary.buffers()[1:]
        offsets = np.frombuffer(size, dtype=np.int64)[self.dictionary.offset :][: len(self.dictionary) + 1]
        if data is None or len(offsets) < 2:
            return "\n" * max(0, len(self.dictionary) - 1)
        flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
        return np.insert(flat, offsets[1:-1] - offsets[0], 10).tobytes().decode("utf-8", "replace")

    def gather(self, value: Callable[[str], bytes], end: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ends per text): the values of a text's words one after the other, ``end`` after each text."""
        return self.spread(pa.array([value(w) if w else b"" for w in self.distinct], pa.large_binary()), end)

    def spread(self, values: pa.Array, end: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As ``gather`` with the values of the distinct words."""
        index, ends = self.index, self.ends
        if end is not None:
            index = np.insert(index, ends, len(values))
            values = pa.concat_arrays([values, pa.array([end], pa.large_binary())])
            ends = ends + np.arange(1, len(ends) + 1)
        return taken(values, index, ends)


def taken(values: pa.Array, index: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``values`` at ``index`` in one buffer, and where the parts that end at ``ends`` of the index end in it."""
    out = values.take(pa.array(index, pa.int64()))
    offsets = np.frombuffer(out.buffers()[1], dtype=np.int64)[: len(out) + 1]
    data = out.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return flat, offsets[ends]


def binary_column(flat: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Arrow column of the parts of ``flat`` that end at ``ends``."""
    kind = kind or pa.binary()
    offsets = np.concatenate([[0], ends]).astype(np.int64 if kind == pa.large_binary() else np.int32)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
