"""Greedy choice among overlapping spans: rows come sorted by text and place and are settled run by run."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows settled at a time, more only while a single cluster of touching spans is longer.
ROWS = 1 << 16


def _run(values: pa.ChunkedArray) -> np.ndarray:
    """Number of each row's value in order of appearance, nulls alike."""
    coded = pc.dictionary_encode(values, null_encoding="encode").combine_chunks()
    return (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _rank(values: pa.ChunkedArray) -> np.ndarray:
    """Dense rank of each value, nulls first."""
    number = _run(values)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
    return pc.rank(values.take(pa.array(first)), null_placement="at_start", tiebreaker="dense").to_numpy()[number]


def _places(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends as numbers that order as (text, place) does."""
    start, end = (rows.column(c).to_numpy() for c in ("start", "end"))
    known, at = np.unique(np.concatenate([start, end]), return_inverse=True)
    base = _run(rows.column(0)) * len(known)
    return base + at[: len(start)], base + at[len(start) :]


def _borders(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows that begin a cluster, which no earlier span reaches into."""
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = start[1:] >= np.maximum.accumulate(end)[:-1]
    return np.flatnonzero(fresh)


def _kept(rows: pa.Table, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans kept longest first, then by start, taxonomy order, end and names; a span covers the rows it begins before."""
    n = len(start)
    alone = np.zeros(n, dtype=bool)
    borders = _borders(start, end)
    alone[borders[np.diff(borders, append=n) == 1]] = True
    rest = np.flatnonzero(~alone)
    names = [_rank(rows.column(c))[rest] for c in ("alias", "skill") if c in rows.column_names]
    order = rest[np.lexsort((*names, end[rest], _rank(rows.column("taxonomy_order"))[rest], start[rest], -rows.column("size").to_numpy()[rest]))]
    low, high = np.searchsorted(start, start[order]), np.searchsorted(start, end[order])
    taken, kept = bytearray(n), bytearray(alone.tobytes())
    for i, lo, hi in zip(order.tolist(), low.tolist(), high.tolist(), strict=True):
        if taken.find(1, lo, hi) < 0:
            taken[lo:hi] = b"\1" * (hi - lo)
            kept[i] = 1
    return np.frombuffer(kept, dtype=bool)


def _clusters(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows of whole clusters with their places, less those that begin inside an earlier kept one of the same alias.

    Rows are ``key, start, end, ...``, sorted by these, and are held until the cluster they are in has ended.  ``again``
    is the alias where it can begin again before it has ended.
    """
    held, n, enough = [], 0, ROWS
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < enough:
            continue
        rows = pa.Table.from_batches(held)
        start, end = _places(rows)
        cut = int(_borders(start, end)[-1])
        if cut:
            yield _apart(rows.slice(0, cut), start[:cut], end[:cut])
        held = rows.slice(cut).combine_chunks().to_batches()
        n -= cut
        enough = max(ROWS, 2 * n)
    if held:
        rows = pa.Table.from_batches(held)
        yield _apart(rows, *_places(rows))


def _apart(rows: pa.Table, start: np.ndarray, end: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    if "again" not in rows.column_names or rows.column("again").null_count == len(rows):
        return rows, start, end
    at = np.flatnonzero(pc.is_valid(rows.column("again")).to_numpy())
    some = rows.take(pa.array(at))
    alias = _run(some.column("again")) * len(at) + _run(some.column("skill"))
    order = np.lexsort((start[at], alias))
    keep, of, until = np.ones(len(rows), dtype=bool), -1, 0
    for i, a, lo, hi in zip(at[order].tolist(), alias[order].tolist(), start[at][order].tolist(), end[at][order].tolist(), strict=True):
        if a == of and lo < until:
            keep[i] = False
        else:
            of, until = a, hi
    return rows.filter(pa.array(keep)), start[keep], end[keep]


def apart_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those that begin inside an earlier kept one of the same alias, as in a scan from left to right."""
    for rows, _, _ in _clusters(batches):
        yield from rows.drop_columns(["again"]).to_batches()


def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Kept rows of ``key, start, end, size, taxonomy_order, skill`` (and ``alias``, ``again``)."""
    for rows, start, end in _clusters(batches):
        yield rows.filter(pa.array(_kept(rows, start, end)))


def kept_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``settle`` as batches without ``size``."""
    for rows in settle(batches):
        yield from rows.drop_columns(["size"]).to_batches()


def kept_skills(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, skills``: distinct skills of each text's kept rows, by taxonomy order and name; one text's are held at a time."""
    held = None
    for rows in settle(batches):
        rows = rows.select([0, rows.column_names.index("taxonomy_order"), rows.column_names.index("skill")])
        held, done = _distinct(rows if held is None else pa.concat_tables([held, rows]))
        if done is not None:
            yield done
    if held is not None and held.num_rows:
        yield _lists(held, np.zeros(1, dtype=np.int64))


def _distinct(rows: pa.Table) -> tuple[pa.Table, pa.RecordBatch | None]:
    """Distinct rows of the last text, and the lists of the others."""
    text, order, skill = _run(rows.column(0)), _rank(rows.column(1)), _rank(rows.column(2))
    by = np.lexsort((skill, order, text))
    text, order, skill = text[by], order[by], skill[by]
    fresh = np.ones(len(by), dtype=bool)
    fresh[1:] = (np.diff(text) != 0) | (np.diff(order) != 0) | (np.diff(skill) != 0)
    rows, text = rows.take(pa.array(by[fresh])), text[fresh]
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    if not len(starts):
        return rows, None
    last = int(starts[-1])
    return rows.slice(last), _lists(rows.slice(0, last), starts[:-1]) if last else None


def _lists(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    offsets = pa.array(np.append(starts, rows.num_rows), pa.int32())
    skills = pa.ListArray.from_arrays(offsets, rows.column(2).combine_chunks() if rows.column(2).num_chunks != 1 else rows.column(2).chunk(0))
    keys = rows.column(0).take(pa.array(starts))
    return pa.RecordBatch.from_arrays([keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys, skills], [rows.column_names[0], "skills"])
