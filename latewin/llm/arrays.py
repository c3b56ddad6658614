"""Words and shingles of many texts as flat numpy arrays.

A word's hash is a polynomial over its bytes, read off prefix sums modulo 2**64,
so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
#: Bytes hashed at once; longer texts are cut at white space.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[_LOWER]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(max(n, CHUNK + 1024), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a byte string, A-Z lower-cased."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_SPACE[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * up[: len(raw)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64)), starts


def _long_text(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not _IS_SPACE[data[end]]:
            end += 1
        parts.append(_hash_words(data[at:end])[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of every text, in order."""
    group, size = [], 0

    def flush():
        if not group:
            return
        ends = np.cumsum([len(texts[i]) + 1 for i in group])
        hashes, starts = _hash_words(b"\n".join(texts[i] for i in group))
        cuts = np.searchsorted(starts, ends)
        low = 0
        for i, high in zip(group, cuts.tolist(), strict=True):
            yield i, hashes[low:high]
            low = high

    for i, text in enumerate(texts):
        if len(text) > CHUNK:
            yield from flush()
            group, size = [], 0
            yield i, _long_text(text)
            continue
        if size + len(text) > CHUNK:
            yield from flush()
            group, size = [], 0
        group.append(i)
        size += len(text) + 1
    yield from flush()


_ROLE = mix(np.arange(1, SHINGLE + 2, dtype=np.uint64)) | np.uint64(1)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Distinct hashes, ascending, of the five-word shingles of one text.

    Fewer words are one shingle as a whole, no words none.
    """
    m = len(words)
    if m == 0:
        return words
    if m < SHINGLE:
        whole = (words * _ROLE[:m]).sum(dtype=np.uint64, keepdims=True)
        return mix(whole + _ROLE[SHINGLE:] * np.array([m], dtype=np.uint64))
    total = words[: m - SHINGLE + 1] * _ROLE[0]
    for j in range(1, SHINGLE):
        total = total + words[j : m - SHINGLE + 1 + j] * _ROLE[j]
    return np.unique(mix(total))
