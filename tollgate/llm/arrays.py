"""Helpers that run inside tasks: texts of an Arrow column as one byte array, word hashes, and groups of sorted rows.

A text is never decoded for this: white space and A-Z are single bytes in UTF-8, so words and their lower case can be
found on bytes. Word hashes are 64 bits wide and come from prefix sums of a polynomial, so a batch takes a few array
passes whatever its number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The text bytes handled at once; the arrays made from them take some 40 times as much.
SLICE_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[ord("A"):ord("Z") + 1] = _BYTES[ord("a"):ord("z") + 1]


def _power(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins (one more entry than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``limit`` bytes together; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word ``[^\\x20\\x09-\\x0D]+``, and the number of its text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans get equal hashes wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTES)[data] * _power(_BASE, len(data)), out=sums[1:])
    spans = (sums[end] - sums[begin]) * _power(_INVERSE, len(data) + 1)[begin]
    return mix(spans + (end - begin).astype(np.uint64))


def spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans that begin at ``begin`` and have ``sizes`` places, one span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def distinct_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first span of each distinct content, and which of them each span equals. Spans with equal hashes are compared byte
    by byte, so that nothing rests on the hashes."""
    _, first, which = np.unique(hash_spans(data, begin, end, fold=False), return_index=True, return_inverse=True)
    sizes, apart = end - begin, begin[first][which] - begin
    at = spread(begin, sizes)
    if (sizes[first][which] != sizes).any() or (data[np.minimum(at + np.repeat(apart, sizes), len(data) - 1)] != data[at]).any():
        whole, place = data.tobytes(), {}
        which = np.array([place.setdefault(whole[a:b], len(place)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
        first = np.unique(which, return_index=True)[1]
    return first, which


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and the number of words in each text."""
    begin, end, text = find_words(data, offsets)
    return hash_spans(data, begin, end), np.bincount(text, minlength=len(offsets) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, length: int = 5) -> list[np.ndarray]:
    """The sorted distinct word-shingle hashes of each text; a text with fewer words is one shingle, none is empty."""
    words, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    weights = mix(np.arange(1, length + 1, dtype=np.uint64)) | np.uint64(1)
    runs = np.zeros(len(words), np.uint64)
    for k in range(length):
        runs[:len(words) - k] += words[k:] * weights[k]
    runs = mix(runs)
    sets = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= length:
            sets.append(np.unique(runs[end - n:end - length + 1]))
        elif n:
            part = words[end - n:end] * weights[:n]
            sets.append(mix(np.array([part.sum(dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal ``keys`` in a partition sorted by them. Only one group and one batch are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if held:
            before = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys]
            change[0] = any(c[0] != b for c, b in zip(columns, before, strict=True))
        at = 0
        for cut in np.flatnonzero(change).tolist():
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
