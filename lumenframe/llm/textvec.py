"""Vectorised word hashing over Arrow string columns.

Texts are handled as UTF-8 bytes in chunks of about a megabyte, so memory does
not follow the size of an Arrow batch. Words are ``[^\\x20\\x09-\\x0D]+`` after
lower-casing A-Z. A null text is the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15


class _Powers(dict):
    """A cache that each process fills for itself."""

    def __reduce__(self):
        return _Powers, ()


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the input is left as it is."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _geometric(name: str, ratio: int, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        size = max(n, CHUNK_BYTES)
        held = np.full(size, ratio, np.uint64)
        held[0] = 1
        np.cumprod(held, out=held)
        if size <= 4 * CHUNK_BYTES:
            _powers[name] = held
    return held[:n]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them and their end)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never run over the end of a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~space[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    begin = offsets[:-1][np.diff(offsets) > 0]
    first[begin] = solid[begin]
    finish = offsets[1:][np.diff(offsets) > 0] - 1
    last[finish] = solid[finish]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _geometric("up", _BASE, n), out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * _geometric("down", pow(_BASE, -1, 1 << 64), n)[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    starts, ends, rows = word_bounds(data, offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends), rows


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words within a row; a row of 1 to k-1 words gives one hash of the whole."""
    n = len(hashes) - k + 1
    out, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        acc = hashes[:n].copy()
        for j in range(1, k):
            acc = mix(acc * np.uint64(_BASE) + hashes[j : j + n])
        whole = rows[:n] == rows[k - 1 : k - 1 + n]
        out, where = acc[whole], rows[:n][whole]
    if len(rows):
        owner, begin, count = np.unique(rows, return_index=True, return_counts=True)
        few = np.flatnonzero(count < k)
        if len(few):
            extra = np.zeros(len(few), np.uint64)
            for x, i in enumerate(few):
                acc = mix(np.array([k + int(count[i])], np.uint64))
                for h in hashes[begin[i] : begin[i] + count[i]]:
                    acc = mix(acc * np.uint64(_BASE) + h)
                extra[x] = acc[0]
            out, where = np.concatenate([out, extra]), np.concatenate([where, owner[few]])
            order = np.argsort(where, kind="stable")
            out, where = out[order], where[order]
    return out, where
