"""Vectorised tokenising and hashing of Arrow string columns.

The kernels work on the UTF-8 buffer of a whole batch at once, with numpy, and
never build Python strings for words.  UTF-8 keeps every byte of a non-ASCII
character at 0x80 or above, so the ASCII word classes used by the operators
give the same words on bytes as on code points.

Hashes are 64-bit, depend on nothing but the text, and are therefore the same
on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one call of a kernel works on (a longer text is one call).
CHUNK_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) over uint64."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


_BASE = int(_stream(11, 1)[0]) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = _stream(1 << 20, 256)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
#: Odd multipliers, one for each place of a word in a shingle.
PLACE = _stream(1 << 30, 64) | U64(1)
#: Of a second, independent hash.
_OTHER_BASE = int(_stream(13, 1)[0]) | 1
_OTHER_BYTE = _stream(1 << 21, 256)
_OTHER_BYTE[65:91] = _OTHER_BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), U64(base), dtype=U64)
        steps[0] = U64(1)
        with np.errstate(over="ignore"):
            _powers[base] = np.cumprod(steps, dtype=U64)
    return _powers[base]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _power(_BASE, n), _power(_BASE_INV, n)


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: Digits, letters and every byte of a non-ASCII character.
WORD = byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Everything but ASCII white space.
NON_SPACE = ~byte_class(bytes([0x20, *range(0x09, 0x0E)]))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if offs and len(column) else np.zeros(len(column) + 1, dtype=np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    offsets = offsets.astype(np.int64)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most so many bytes each (or of one document)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


class Words:
    """The words of some documents: byte ranges, hashes and where each document begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD, lower: bool = True) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = table[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | cut[1:-1]
            last[:-1] &= ~inside[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Word index at which each document begins; one more at the end.
        self.doc_first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.doc_first)
        up, down = _tables(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=U64)
            np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:n], out=sums[1:])
            self.hashes = mix64((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U64))

    def second_hashes(self) -> np.ndarray:
        """Hashes of the words, A-Z lower-cased, that say nothing of the first ones."""
        n = len(self.data)
        up, down = _power(_OTHER_BASE, n + 1), _power(pow(_OTHER_BASE, -1, 1 << 64), n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=U64)
            np.cumsum(_OTHER_BYTE[self.data] * up[:n], out=sums[1:])
            return mix64((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U64))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside one document, and the word index each begins at."""
        h = self.hashes
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            total = h[:n] * PLACE[0]
            for j in range(1, k):
                total += h[j : j + n] * PLACE[j]
        ends = np.repeat(self.doc_first[1:], self.counts)[:n]
        at = np.flatnonzero(np.arange(n) + k <= ends)
        return mix64(total[at] + U64(k)), at

    def shingle_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct k-word shingle hashes of every document, ascending, and n + 1 offsets.

        A document with fewer than k words, but not none, has its whole word sequence as its one shingle.
        """
        hashes, at = self.shingles(k)
        docs = self.doc_of()[at]
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        if len(short):
            extra = np.empty(len(short), dtype=U64)
            with np.errstate(over="ignore"):
                for i, d in enumerate(short):
                    own = self.hashes[self.doc_first[d] : self.doc_first[d + 1]]
                    extra[i] = (own * PLACE[: len(own)]).sum(dtype=U64) + U64(len(own))
            hashes, docs = np.concatenate([hashes, mix64(extra)]), np.concatenate([docs, short])
        order = np.lexsort((hashes, docs))
        hashes, docs = hashes[order], docs[order]
        if len(hashes):
            keep = np.ones(len(hashes), dtype=bool)
            keep[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
            hashes, docs = hashes[keep], docs[keep]
        return hashes, np.searchsorted(docs, np.arange(len(self.counts) + 1))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    up, down = _tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def sequence_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs items[start:end] of 64-bit hashes, in order."""
    up, down = _tables(len(items) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(items) + 1, dtype=U64)
        np.cumsum(items * up[: len(items)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte; one more at the end."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
