"""Words, window hashes and compact arrays over Arrow batches of texts, as numpy passes without per-word Python.

A text is its UTF-8 bytes. Hashes are 64-bit polynomials over random byte (or word) values, taken from prefix sums
modulo 2**64 and then mixed: every window of a length costs the same two array passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
SLICE_BYTES = 1 << 20  # text handled at once; a longer document makes a longer slice


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(BASE)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = _splitmix(256, 17)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _word_table(*gaps: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in gaps:
        table[low : high + 1] = False
    return table


#: Bytes of a word: all but blanks, and letters, digits and everything beyond ASCII (for lower-cased text).
PLAIN = _word_table((0x20, 0x20), (0x09, 0x0D))
ALNUM = _word_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each, kept for the next call."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            step = np.full(size, base, U64)
            step[0] = 1
            _POWERS[name] = np.cumprod(step, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(29))  # a new array, changed in place from here on
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(29)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values))
    sums = np.empty(len(values) + 1, U64)
    sums[0] = 0
    np.multiply(values, up[: len(values)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return sums


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of each span [start, end)."""
    _, down = powers(len(sums))
    h = sums[end]
    h -= sums[start]
    h *= down[start]
    return mix(h)


class Slice:
    """Some whole documents of a batch: bytes, offsets, and their place in the batch."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and for each document the number of words before it (one more entry than documents)."""
        inside = table[self.data]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = self.offsets[1:] > self.offsets[:-1]
        before[self.offsets[:-1][full]] = False
        after[self.offsets[1:][full] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return spans(prefix_sums(BYTE_VALUES[self.data]), starts, ends)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole documents of a string or binary column, about `most` bytes at a time; null counts as empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    before = 0
    for chunk in chunks:
        if not pa.types.is_large_binary(chunk.type):
            chunk = chunk.cast(pa.binary()).cast(pa.large_binary())
        if chunk.null_count:
            chunk = chunk.fill_null(b"")
        n = len(chunk)
        buffers = chunk.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[chunk.offset : chunk.offset + n + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
            part = data[offsets[first] : offsets[last]]
            yield Slice(before + first, LOWER[part] if lower else part, offsets[first : last + 1] - offsets[first])
            first = last
        before += n


def word_windows(hashes: np.ndarray, bounds: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of one document, and the index of its first word.

    With `short`, a document of fewer words (but not none) has one window: all of them.
    """
    sums = prefix_sums(hashes)
    counts = np.diff(bounds)
    n = np.maximum(counts - k + 1, 0)
    if short:
        n = np.where((counts > 0) & (counts < k), 1, n)
    shift = bounds[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else np.zeros(0, np.int64)
    start = np.arange(n.sum()) + np.repeat(shift, n)
    end = start + k
    if short:
        end = np.minimum(end, np.repeat(bounds[1:], n))
    return spans(sums, start, end), start


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each item, the document it lies in, given the numbers of items before each document."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + count - 1."""
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - counts), counts)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a window of `length` that begins at one of `starts`."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Compact bytes of an array: differences if ascending, byte planes, zstd."""
    if ascending and len(values):
        values = np.concatenate((values[:1], np.diff(values)))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T if len(values) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)
    return np.cumsum(values, dtype=kind) if ascending else values
