"""Vectorised text kernels that run inside Arrow-batched Python tasks.

A "word" is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All of
these delimiters are single ASCII bytes, so working on UTF-8 bytes gives the
same words as working on characters.  ASCII letters are lower-cased, other
characters stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_BYTE_LOWER = _BYTE[_LOWER]


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _UNPOWER = _powers(_BASE), _powers(_INVERSE)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about ``limit`` bytes of text, so memory doesn't depend on the batch size."""
    for batch in batches:
        data, offsets = buffer(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def words(data: np.ndarray, offsets: np.ndarray, hashes: bool = True, lower: bool = True, delimiters: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Start, end and hash of each word, and the index of each row's first word (one more than rows).

    The hash is a polynomial of byte values modulo 2^64, from running sums kept
    block by block, so a word may be of any length.  ``delimiters`` marks the
    byte values that end a word.
    """
    n = len(data)
    inside = ~delimiters[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = np.unique(offsets[(offsets > 0) & (offsets < n)])
    begin[cuts] |= inside[cuts]
    end[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    rows = np.searchsorted(starts, offsets)
    if not hashes:
        return starts, ends, None, rows
    value = _BYTE_LOWER if lower else _BYTE
    before, after = np.empty(len(starts), U64), np.empty(len(starts), U64)
    carry, scale = U64(0), 1
    with np.errstate(over="ignore"):
        for a in range(0, n, _BLOCK):
            b = min(n, a + _BLOCK)
            run = value[data[a:b]]
            run *= _POWER[: b - a]
            if scale != 1:
                run *= U64(scale)
            sums = np.empty(b - a + 1, U64)
            sums[0] = carry
            np.cumsum(run, out=sums[1:])
            sums[1:] += carry
            i, j = np.searchsorted(starts, [a, b])
            before[i:j] = sums[starts[i:j] - a]
            i, j = np.searchsorted(ends, [a, b], "right")
            after[i:j] = sums[ends[i:j] - a]
            carry, scale = sums[-1], scale * pow(_BASE, b - a, 1 << 64) & _MASK
        value = after - before
        value *= _UNPOWER[starts % _BLOCK]
        blocks = starts // _BLOCK
        if len(blocks) and blocks[-1]:
            step = pow(_INVERSE, _BLOCK, 1 << 64)
            scales = np.full(int(blocks[-1]) + 1, step, U64)
            scales[0] = 1
            value *= np.multiply.accumulate(scales)[blocks]
    return starts, ends, mix(value), rows


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII letters in lower case."""
    return _LOWER[data]


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words within a row, and each row's first one.

    A row with fewer words, but at least one, has the whole sequence as its one shingle.
    """
    n, count = len(hashes), np.diff(rows)
    with np.errstate(over="ignore"):
        if n >= k:
            run = hashes[: n - k + 1].copy()
            for i in range(1, k):
                run = run * U64(_BASE) + hashes[i : n - k + 1 + i]
            run = mix(run)
        else:
            run = np.zeros(0, U64)
        per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
        out = np.concatenate([[0], np.cumsum(per)])
        whole = np.zeros(out[-1], U64)
        long = np.flatnonzero(count >= k)
        if len(long):
            at = ranges(out[long], per[long])
            whole[at] = run[ranges(rows[:-1][long], per[long])]
        for r in np.flatnonzero((count > 0) & (count < k)):
            value = U64(count[r])
            for h in hashes[rows[r] : rows[r + 1]]:
                value = value * U64(_BASE) + h
            whole[out[r]] = mix(np.array([value]))[0]
    return whole, out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of start, start + 1, ... of each count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = counts > 0
    starts, counts = np.asarray(starts)[keep], np.asarray(counts)[keep]
    at = np.cumsum(counts)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(out)


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    values = values.copy()
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[rows[:-1][np.diff(rows) > 0]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[rows]
