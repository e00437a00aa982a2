"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: Longest word, in bytes, that the running sum hashes; sums modulo 2^64 are only weak for words of a thousand and more.
LONG_WORD = 64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * CHUNK)
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        down[0] = 1
        _powers.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word of the texts data[offsets[i]:offsets[i+1]], in order.

    A word's hash is a sum of its bytes' values times powers of an odd base, so differences of one running sum
    give all words of a piece at once. Pieces end at white space; their size bounds the memory.
    """
    n = len(data)
    space = _SPACE[data]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[0] = after[-1] = True
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power(hi - lo + 1)
        run = np.empty(hi - lo + 1, np.uint64)
        run[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=run[1:])
        hashes[i:j] = (run[ends[i:j] - lo] - run[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        word = data[starts[k] : ends[k]].tobytes().translate(_LOWER)
        hashes[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "big")
    return np.searchsorted(offsets, starts, "right") - 1, mix(hashes)


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, laid end to end, and the texts' bounds in them.

    A text of fewer than ``width`` words has its whole sequence as one shingle; without words it has none.
    """
    count = len(offsets) - 1
    if len(data) == 0:
        return np.empty(0, np.uint64), np.zeros(count + 1, np.int64)
    doc, word = words(data, offsets)
    bounds = np.searchsorted(doc, np.arange(count + 1))
    parts, sizes = [], np.zeros(count, np.int64)
    full = None
    if len(word) >= width:
        full = sum((word[k : len(word) - width + 1 + k] * _PLACE[k] for k in range(width)), np.uint64(width))
        full = mix(full)
    for d in range(count):
        a, b = int(bounds[d]), int(bounds[d + 1])
        if b - a >= width:
            own = np.sort(full[a : b - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = mix(np.array([sum(int(word[a + k]) * int(_PLACE[k]) for k in range(b - a)) + (b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64))
        else:
            continue
        parts.append(own)
        sizes[d] = len(own)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, data, offsets) of runs of texts of about ``size`` bytes; null is empty."""
    texts = pa.array(texts.cast(pa.large_binary()).fill_null(b"")) if texts.null_count else texts.cast(pa.large_binary())
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
