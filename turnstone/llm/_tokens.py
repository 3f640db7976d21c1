"""Word hashes of whole texts, computed by vector operations on their UTF-8 bytes.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. A word's
hash is a polynomial over random byte values modulo 2^64, read off prefix sums, then
mixed. Texts are worked on in slices of bounded size, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time.
SLICE = 1 << 18

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Tables:
    """Byte classes and values, powers of the base and their inverses; made once a process."""

    def __init__(self) -> None:
        self.word = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
        values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        values[65:91] = values[97:123]
        self.value = values
        self.powers = self.inverse = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * SLICE)
            inv = pow(_BASE, -1, 1 << 64)
            for name, base in (("powers", _BASE), ("inverse", inv)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_tables: list[_Tables] = []


def _span(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data``, and the number of words before each start; words end at starts."""
    if not _tables:
        _tables.append(_Tables())
    t = _tables[0]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    t.upto(n + 1)
    inside = t.word[data]
    fresh = np.ones(n, bool)
    fresh[1:] = ~inside[:-1]
    cut = starts[(starts > 0) & (starts < n)]
    fresh[cut] = True
    first = np.flatnonzero(inside & fresh)
    stop = np.ones(n, bool)
    stop[:-1] = ~inside[1:]
    stop[cut - 1] = True
    last = np.flatnonzero(inside & stop)
    with np.errstate(over="ignore"):
        total = np.cumsum(t.value[data] * t.powers[:n], dtype=np.uint64)
        h = total[last]
        h[1:] -= total[first[1:] - 1]
        if len(first) and first[0] > 0:
            h[0] -= total[first[0] - 1]
        h = mix64(h * t.inverse[first] + np.uint64(1))
    return h, np.searchsorted(first, starts)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Slices of a long text that end where no word goes on."""
    if not _tables:
        _tables.append(_Tables())
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data):
            gap = np.flatnonzero(~_tables[0].word[data[end : end + SLICE]])
            end += int(gap[0]) if len(gap) else min(SLICE, len(data) - end)
            if len(gap):
                break
        yield data[at:end]
        at = end


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the words, offsets of the rows' words) for groups of whole texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        span = data[offsets[row] : offsets[end]]
        if end == row + 1 and len(span) > SLICE:
            h = np.concatenate([_span(p, np.zeros(1, np.int64))[0] for p in _pieces(span)])
            yield row, h, np.array([0, len(h)])
        else:
            h, at = _span(span, offsets[row:end] - offsets[row])
            yield row, h, np.append(at, len(h))
        row = end


def shingles(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, and the rows' offsets; a text of fewer words but some is one shingle."""
    n = np.diff(offsets)
    made = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(made)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    row = np.repeat(np.arange(len(n)), made)
    at = offsets[row] + np.arange(out[-1]) - out[row]
    left = np.minimum(n[row], k)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    with np.errstate(over="ignore"):
        s = np.zeros(len(at), np.uint64)
        for j in range(k):
            s = s * np.uint64(_BASE) + np.where(j < left, padded[at + j], np.uint64(0))
        return mix64(s + left.astype(np.uint64)), out
