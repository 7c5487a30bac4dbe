"""Vectorised text primitives that the operators of this subpackage run inside Arrow tasks.

A task handles a record batch in slices of bounded size, so one very long text costs its own
length in memory and nothing more.  Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only;
both the separators and A-Z are single bytes in UTF-8, so the work is done on raw bytes.

Hashes are 64 bits: every byte has a fixed random value, a word is the polynomial of its bytes
modulo 2**64, and a final mixer spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256).astype(np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call in this worker."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if len(got) > 4 * SLICE_BYTES:
            return got[:n]
        _powers[base] = got
    return got[:n]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about SLICE_BYTES of text; a longer text stands alone."""
    if batch.num_rows == 0:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield batch.slice(first, last - first)
        first = last


def raw(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a newline after each text, and the bounds of the texts (n + 1; each text ends before its newline)."""
    empty, newline = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
    joined = pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(empty), empty, newline)
    joined = pa.concat_arrays([joined]) if joined.offset else joined
    offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = joined.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), offsets - offsets[0]


class Words:
    """Words of a run of texts: start and end bytes, 64-bit hash, and the text each belongs to."""

    def __init__(self, texts: pa.Array, lower: bool = True) -> None:
        self.data, self.bounds = raw(texts, lower)
        gap = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.n = np.diff(np.searchsorted(self.start, self.bounds))  # words of each text
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        self._sums = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            total = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * powers(_BASE, len(self.data)), out=total[1:])
            self._sums = total
        return self._sums

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes start..end of each span, alike wherever the span lies."""
        shift = powers(_INVERSE, len(self.data) + 1)
        return mix((self.sums[end] - self.sums[start]) * shift[start] + (end - start).astype(np.uint64))

    @property
    def hashes(self) -> np.ndarray:
        return self.hash_spans(self.start, self.end)

    def shingles(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of every run of k words inside one text; a shorter text with words gives one of all its words."""
        h = self.hashes if hashes is None else hashes
        value, text = runs(h, self.text, k)
        short = np.flatnonzero((self.n > 0) & (self.n < k))
        if len(short):
            more = np.array([fold(h[self.first[i] : self.first[i + 1]]) for i in short], dtype=np.uint64)
            value, text = np.concatenate((value, more)), np.concatenate((text, short))
        return value, text


def fold(h: np.ndarray) -> np.uint64:
    """One hash of a sequence of word hashes, as runs() gives it."""
    out = np.zeros(1, dtype=np.uint64)
    for i in range(len(h)):
        out = mix(out * np.uint64(_BASE) + h[i : i + 1], 1)
    return out[0]


def runs(h: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of k words that lies inside one text."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(m, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(_BASE) + h[i : i + m], 1)
    inside = text[:m] == text[k - 1 :]
    return out[inside], text[:m][inside]


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column: the values dealt out in runs of counts."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


_CORE = np.zeros(256, dtype=bool)
_CORE[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


class Cores(Words):
    """Words without the ASCII punctuation at their ends; words of punctuation alone are left out.

    ``capital`` marks a first letter in upper case (ASCII or Latin-1), ``opens`` a word at the start of a
    text or line or after . ! ? or :, ``number`` a word of digits, points and commas only.
    """

    def __init__(self, texts: pa.Array) -> None:
        super().__init__(texts, lower=False)
        size = len(self.data)
        core = _CORE[self.data]
        at = np.arange(size + 1)
        after = np.minimum.accumulate(np.where(np.append(core, True), at, size)[::-1])[::-1]
        before = np.maximum.accumulate(np.where(np.append(core, False), at, -1))
        start, end = after[self.start], before[np.maximum(self.end - 1, 0)] + 1
        full = start < self.end
        last = self.data[np.maximum(self.end - 1, 0)]
        newline = np.concatenate(([0], np.cumsum(self.data == 10)))
        opens = np.ones(len(start), dtype=bool)
        if len(start) > 1:
            stop = np.isin(last[:-1], np.frombuffer(b".!?:", np.uint8))
            opens[1:] = stop | (newline[self.start[1:]] > newline[self.start[:-1]])
        self.opens, self.start, self.end, self.text = opens[full], start[full], end[full], self.text[full]
        head = self.data[self.start] if len(self.start) else np.zeros(0, np.uint8)
        second = self.data[np.minimum(self.start + 1, size - 1)] if len(self.start) else head
        self.capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        digits = np.concatenate(([0], np.cumsum(_DIGIT[self.data])))
        letters = np.concatenate(([0], np.cumsum(core & ~_DIGIT[self.data])))
        self.number = (digits[self.end] > digits[self.start]) & (letters[self.end] == letters[self.start])
        self.data = _LOWER[self.data]
        self.n = np.bincount(self.text, minlength=len(self.n))
        self.first = np.concatenate(([0], np.cumsum(self.n)))
