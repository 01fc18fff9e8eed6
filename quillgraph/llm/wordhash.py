"""Vectorised hashes of words and word runs over the UTF-8 bytes of many texts.

A word's hash mixes its bytes eight at a time into a state that begins with its
length, all words of the buffer together; a long word has a digest of its bytes
instead. A run's hash chains the hashes of its words. Words are split by the six
ASCII white-space bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once.
CHUNK = 400_000
#: Bytes of a word from which on it is hashed alone.
LONG = 256
_BASE = 0x9E3779B97F4A7C15 | 1
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _hashed(joined: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    lanes = np.ndarray((len(joined),), "<u8", joined + bytes(8), 0, (1,))  # the eight bytes from each place on
    state = mix(sizes.astype(np.uint64), 17)
    live, at, left = np.arange(len(starts)), starts, sizes
    if len(long := np.flatnonzero(sizes >= LONG)):
        for i, a, n in zip(long.tolist(), starts[long].tolist(), sizes[long].tolist(), strict=True):
            state[i] = int.from_bytes(hashlib.blake2b(joined[a : a + n], digest_size=8).digest(), "little")
        live = np.flatnonzero(sizes < LONG)
        at, left = starts[live], sizes[live]
    salt = 19
    while len(live):
        own = lanes[at] & _MASKS[np.minimum(left, 8)]
        state[live] = mix(state[live] ^ own * _ODD, salt)
        more = left > 8
        live, at, left, salt = live[more], at[more] + 8, left[more] - 8, salt + 2
    return state


def words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, words per text, start byte, end byte) of ``b" ".join(texts)``."""
    joined = b" ".join(texts) + b" "
    if lower:
        joined = joined.translate(_UPPER)
    buf = np.frombuffer(joined, np.uint8)
    space = _SPACE[buf]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    if len(ends) > len(starts):  # the very first byte is no edge
        ends = ends[len(ends) - len(starts) :]
    hashes = _hashed(joined, starts, ends - starts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 1) - sizes - 1
    at = np.searchsorted(starts, np.append(first, len(buf)))
    return hashes, np.diff(at), starts, ends


def runs(hashes: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    """Hash of the ``n`` words from each place on; the last n - 1 places are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = mix(hashes[:m], salt)
    for k in range(1, n):
        out = mix(out + hashes[k : k + m], salt)
    return out


def chunked(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first, end) of slices of about CHUNK bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
