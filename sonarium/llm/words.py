"""Word and shingle hashes of whole texts, computed for a batch of texts at a time in numpy.

A word is a run of bytes outside ``0x20`` and ``0x09-0x0D`` after A-Z are lower-cased, so words of UTF-8 texts are the
matches of ``[^\\x20\\x09-\\x0D]+``. Every word gets a 64-bit hash of its bytes; a shingle's hash is taken from its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240501))
_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_POSITION = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n+1 offsets into them; a null text is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class WordHasher:
    """Hashes the words of consecutive pieces of bytes; powers are kept between calls."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def piece(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word; ``cuts`` are positions where a word ends even without white space."""
        n = len(raw)
        if len(self.up) < n:
            self.up, self.down = _powers(_P, n), _powers(_P_INVERSE, n)
        inside = ~_SPACE[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[raw] * self.up[:n], out=total[1:])
        return starts, mix((total[ends + 1] - total[starts]) * self.down[starts])


def word_hashes(column: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch and the n+1 offsets of each text's words.

    Works through the bytes in pieces of about ``CHUNK`` cut at white space, so memory follows the number of words.
    """
    raw, offsets = text_buffers(column)
    found: list[np.ndarray] = []
    places: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw) and not _SPACE[raw[end - 1]]:
            ahead = np.flatnonzero(_SPACE[raw[end : end + CHUNK]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + CHUNK, len(raw))
        low, high = np.searchsorted(offsets, [at, end])
        starts, hashes = hasher.piece(raw[at:end], offsets[low:high] - at)
        found.append(hashes)
        places.append(starts + at)
        at = end
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    where = np.concatenate(places) if places else np.zeros(0, np.int64)
    return words, np.searchsorted(where, offsets)


def shingle_sets(column: pa.Array, width: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; fewer words than ``width`` make one shingle, none make none."""
    words, offsets = word_hashes(column, hasher)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : n - width + 1 + k] * _POSITION[k]
    rolled = mix(rolled)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            short = words[a:b] * _POSITION[: b - a]
            short[0] ^= _POSITION[width + (b - a)]
            yield mix(short.sum(dtype=np.uint64, keepdims=True))
        else:
            yield np.zeros(0, np.uint64)


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``most`` bytes together, one text at least."""
    _, offsets = text_buffers(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, len(column))
        at = end
