"""Array kernels over Arrow text batches, used inside tasks.

A batch of texts is one byte buffer plus row offsets.  Words, word hashes and
hashes of runs of words all come out of whole-buffer array operations, so the
cost per byte does not depend on how texts are cut into rows.  Hashes are 64
bit polynomial prefix sums, finished with a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BYTE_BASE = U64(0x9E3779B97F4A7C15)
WORD_BASE = U64(0xD1342543DE82EF95)
#: Rows are handed to the kernels in slices of about so many bytes.
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


LETTER = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Bytes that are neither a space nor one of the controls 9 to 13.
NOT_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, lower-case letters and every byte of a non-ASCII character.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        out = []
        for b in (base, U64(pow(int(base), -1, 1 << 64))):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        have = _powers[int(base)] = (out[0], out[1])
    return have


class Prefix:
    """Hashes of any range of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, base: np.uint64):
        n = len(symbols)
        up, self.down = powers(base, n)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(symbols * up[:n], dtype=U64, out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and n + 1 row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Every batch, cut between rows into parts of about ``most`` text bytes."""
    for batch in batches:
        data, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(off, off[row] + most, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row), data[off[row] : off[end]], off[row : end + 1] - off[row]
            row = end


#: Bytes of a long row whose hashes are made at once.
SEGMENT_BYTES = 4 << 20


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = SEGMENT_BYTES) -> np.ndarray:
    """Hashes of ascending runs of bytes, made stretch by stretch: what a long
    text needs for each byte is held for one stretch only."""
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + most, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        out[i:j] = Prefix(LETTER[data[a:b]], BYTE_BASE).ranges(start[i:j] - a, end[i:j] - a)
        i = j
    return out


class Words:
    """The words of a slice: where they start and end, their row and hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, inside: np.ndarray, split: np.ndarray | None = None, fold: bool = True):
        """``split``: bytes at which a new word starts in any case; ``fold``:
        take A-Z as a-z."""
        self.data = low = LOWER[data] if fold else data
        self.off, n = off, len(low)
        if n == 0:
            self.start = self.end = self.row = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U64)
        else:
            m = inside[low]
            before, after = np.zeros(n, bool), np.zeros(n, bool)
            before[1:], after[:-1] = m[:-1], m[1:]
            edge = off[(off > 0) & (off < n)]
            before[edge] = False
            after[edge - 1] = False
            if split is not None:
                before &= ~split
                after[:-1] &= ~split[1:]
            self.start = np.flatnonzero(m & ~before)
            self.end = np.flatnonzero(m & ~after) + 1
            self.row = np.searchsorted(off, self.start, side="right") - 1
            self.hash = hash_runs(low, self.start, self.end)
        #: The first word of every row, and the number of all words last.
        self.first = np.searchsorted(self.row, np.arange(len(off)), side="left")
        self.count = np.diff(self.first)
        self._prefix: Prefix | None = None

    @property
    def prefix(self) -> Prefix:
        if self._prefix is None:
            self._prefix = Prefix(self.hash, WORD_BASE)
        return self._prefix

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words, and hashes, of all runs of k words inside one row."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.arange(n - k + 1)
        at = at[self.row[at] == self.row[at + k - 1]]
        return at, self.prefix.ranges(at, at + k)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every range, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def binary_rows(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary Arrow column: row i holds the bytes of its share of ``flat``."""
    off = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=off[1:])
    off *= flat.dtype.itemsize
    kind = pa.int32() if off[-1] < 2**31 else pa.int64()
    if kind == pa.int32():
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(flat.tobytes())])


class HashIndex:
    """Positions of 64-bit keys in a fixed sorted set; -1 for all others."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, U64(0))
        self.n = len(keys)
        bits = max(8, min(22, int(max(self.n, 1)).bit_length() + 3))
        self.shift = U64(64 - bits)
        bucket = (keys >> self.shift).astype(np.int64)
        counts = np.bincount(bucket, minlength=1 << bits)
        self.first = (np.cumsum(counts) - counts).astype(np.int32)
        self.longest = int(counts.max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        at = self.first[(h >> self.shift).astype(np.int64)]
        for _ in range(self.longest):
            hit = self.keys[np.minimum(at, self.n)] == h
            hit &= at < self.n
            out[hit] = at[hit]
            at = at + 1
        return out


class Tally:
    """Counts by 64-bit key, kept small between flushes."""

    def __init__(self, most: int = 4_000_000):
        self.most, self.held = most, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> bool:
        """True when it is time to take what was counted."""
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n))
        self.held += len(k)
        if self.held > self.most:
            self.parts = [self.take()]
            self.held = len(self.parts[0][0])
            if self.held > self.most // 2:
                return True
        return False

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        k = np.concatenate([p[0] for p in self.parts])
        n = np.concatenate([p[1] for p in self.parts])
        self.parts, self.held = [], 0
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        return k[first], np.add.reduceat(n, first) if len(k) else n
