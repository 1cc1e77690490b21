"""Counters of one text, each computed when first asked for; counts are over the whole text."""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np

_SYMBOLS = re.compile(rb"[#*$%&|<>]")


class TextStats:
    """Integer counters of a text given as UTF-8 bytes. Words lie between ASCII white space."""

    def __init__(self, text: bytes) -> None:
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: bytes that do not continue a character."""
        data = np.frombuffer(b"".join(self.words), dtype=np.uint8)
        return int(len(data) - np.count_nonzero((data & 0xC0) == 0x80))

    @cached_property
    def n_symbols(self) -> int:
        return len(_SYMBOLS.findall(self.text))

    @cached_property
    def n_marks(self) -> int:
        return self.text.count(b"!")

    @cached_property
    def _letters(self) -> tuple[int, int, int]:
        counts = np.bincount(np.frombuffer(self.text, dtype=np.uint8), minlength=256)
        return int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())

    @cached_property
    def n_upper(self) -> int:
        return self._letters[0]

    @cached_property
    def n_lower(self) -> int:
        return self._letters[1]

    @cached_property
    def n_digits(self) -> int:
        return self._letters[2]

    @cached_property
    def _lines(self) -> tuple[int, int]:
        own = [x for x in self.text.split(b"\n") if not (x.isspace() or not x)]
        return len(own), len(set(own))

    @cached_property
    def n_lines(self) -> int:
        return self._lines[0]

    @cached_property
    def n_dup_lines(self) -> int:
        return self._lines[0] - self._lines[1]

    @cached_property
    def _word_ids(self) -> np.ndarray:
        ids: dict[bytes, int] = {}
        return np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), dtype=np.int64, count=self.n_words)

    @cached_property
    def n_distinct(self) -> int:
        return int(self._word_ids.max()) + 1 if self.n_words else 0

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows found twice or more, the first time included."""
        ids = self._word_ids
        if len(ids) < 4:
            return 0
        _, pairs = np.unique(ids[:-2] * self.n_distinct + ids[1:-1], return_inverse=True)
        _, window, count = np.unique(pairs * self.n_distinct + ids[2:], return_inverse=True, return_counts=True)
        hit = np.zeros(len(ids) + 3, dtype=np.int64)
        at = np.flatnonzero(count[window] > 1)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + 3, -1)
        return int(np.count_nonzero(np.cumsum(hit[: len(ids)]) > 0))
