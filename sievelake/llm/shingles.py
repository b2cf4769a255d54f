"""Words and word n-grams of Arrow text columns as 64-bit hashes, a batch at a time in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Key of the word hash.
KEY = 0x5EED0F511E7E
#: Space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser over 64 bits; different salts give independent hashes."""
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A keyed value for each byte at each of the first places of a word.
_PLACES = 64
_TABLE = mix(np.arange(_PLACES * 256, dtype=_U), KEY)


def _sums(body: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word from the words' bytes, which stand without gaps: the sum of a value for each byte at its place."""
    out = np.empty(len(ends) - 1, _U)
    at = 0
    while at < len(out):  # in runs, so that little stands beside the text itself
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20), "right")) - 1)
        part, sizes = body[ends[at] : ends[upto]], np.diff(ends[at : upto + 1])
        place = np.arange(len(part)) - np.repeat(ends[at:upto] - ends[at], sizes)
        far = np.flatnonzero(place >= _PLACES)
        index = place * 256 + part
        index[far] = 0
        values = _TABLE[index]
        if len(far):
            values[far] = mix(place[far].astype(_U) * _U(256) + part[far], KEY)
        out[at:upto] = mix(np.add.reduceat(values, ends[at:upto] - ends[at]), 7) + sizes.astype(_U)
        at = upto
    return out


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets of each text's words) of a string column; null texts have none."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
    if not len(data):
        return np.zeros(0, _U), np.zeros(n + 1, np.int64)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    before = np.r_[False, solid[:-1]]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    start = np.flatnonzero(solid & ~before)
    after = np.r_[solid[1:], False]
    after[inner - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    return _sums(data[solid], ends), np.searchsorted(start, offsets).astype(np.int64)


def inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """For each word of a batch of texts, whether n words from it on stand in one text."""
    return np.repeat(offsets[1:], np.diff(offsets)) - np.arange(offsets[-1]) >= n


def ngrams(words: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    """Hashes of the n-grams of one text's word hashes; none if it has fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    total = np.zeros(m, _U)
    for j in range(n):
        total += words[j : j + m] * _U((2 * j + 3) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF | 1)
        total = (total << _U(13)) | (total >> _U(51))
    return mix(total, salt)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; the whole sequence as one if there are fewer words."""
    if not len(words):
        return np.zeros(0, _U)
    return np.unique(ngrams(words, min(n, len(words)), n if len(words) >= n else 1000 + len(words)))


def digest128(raw: bytes) -> tuple[int, int]:
    """128 bits of a cryptographic hash, as two signed numbers."""
    d = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def raw_texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], key: int, size: int = 64) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of at most ``size`` rows that are alike in their first ``key`` columns, of rows that come sorted by them;
    with each, whether it begins a new key."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(key)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            here = tuple(c[a] for c in columns)
            for i in range(a, b, size):
                yield here != last, batch.slice(i, min(size, b - i))
                last = here
