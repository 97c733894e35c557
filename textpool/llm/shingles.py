"""Word shingles of whole texts as 64-bit hashes, computed on the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
SLAB = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A value per byte; A-Z have those of a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]
_PLACE = mix(np.arange(1001, 1001 + SIZE, dtype=np.uint64)) | np.uint64(1)
_SHORT = mix(np.arange(2001, 2001 + SIZE, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _pieces(offsets: np.ndarray, data: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, start, end) of about SLAB bytes; a longer text is cut where a word ends."""
    own, total = [], 0
    for i in range(len(offsets) - 1):
        a, end = int(offsets[i]), int(offsets[i + 1])
        while a < end:
            b = end
            if end - a > SLAB:
                b = a + SLAB
                while b < end and not _SPACE[data[b]]:
                    b += 1
            own.append((i, a, b))
            total += b - a
            a = b
            if total >= SLAB:
                yield own
                own, total = [], 0
    if own:
        yield own


def _words(data: np.ndarray, own: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word of the pieces, which lie one after another in ``data``."""
    base, end = own[0][1], own[-1][2]
    part = data[base:end]
    word = ~_SPACE[part]
    cuts = np.array([a - base for _, a, _ in own])
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    starts[cuts] = word[cuts]
    ends = np.zeros(len(part) + 1, bool)
    ends[1:] = word
    ends[1:-1] &= ~word[1:]
    ends[cuts[1:]] = word[cuts[1:] - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE[part] * _powers(_ODD, len(part)), out=total[1:])
    h = mix((total[e] - total[s]) * _powers(_ODD_INVERSE, len(part))[s])
    texts = np.array([i for i, *_ in own])
    return h, texts[np.searchsorted(cuts, s, side="right") - 1]


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slabs ``(first, last, hashes, rows)``: the distinct shingle hashes of rows first..last-1, sorted by row, then hash.

    Words are runs of anything but space and bytes 09-0D, A-Z lower-cased. A
    text of fewer than SIZE words has its whole sequence as one shingle; a
    text without words, or null, has none.
    """
    column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    done = 0
    for own in _pieces(offsets, data):
        h, row = _words(data, own)
        last = own[-1][0]
        closed = own[-1][2] == offsets[last + 1]
        held.append((h, row))
        if closed:
            h, row = (np.concatenate(x) for x in zip(*held, strict=True))
            yield (done, last + 1, *_distinct(*_shingles(h, row)))
            held, done = [], last + 1
    if done < len(column):
        yield done, len(column), np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _shingles(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(h) - SIZE + 1
    out, rows = [], []
    if n > 0:
        value = h[:n] * _PLACE[0]
        for j in range(1, SIZE):
            value += h[j:j + n] * _PLACE[j]
        whole = row[:n] == row[SIZE - 1:]
        out.append(mix(value[whole]))
        rows.append(row[:n][whole])
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(row)])
    for k in range(1, SIZE):
        at = first[count == k]
        if len(at):
            value = np.full(len(at), _SHORT[k], np.uint64)
            for j in range(k):
                value += h[at + j] * _PLACE[j]
            out.append(mix(value))
            rows.append(row[at])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], row[new]
