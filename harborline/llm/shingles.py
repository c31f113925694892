"""Hashed word shingles of whole texts, computed over groups of texts with array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
GROUP_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2 ** 64
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i below ``count``."""
    if not _powers or len(_powers["up"]) < count:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(count, BASE), np.full(count, inverse)
        up[0] = down[0] = 1
        _powers.update(up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"][:count], _powers["down"][:count]


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """Whole texts as UTF-8 in groups of about ``limit`` bytes; null is empty."""
    group, size = [], 0
    for text in column:
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        group.append(data)
        size += len(data)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def shingle_sets(group: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes.

    Words are runs of non-space bytes with A-Z in lower case. A text with fewer words than a shingle has its whole
    sequence as the only one; a text without words has none.
    """
    data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
    offsets = np.cumsum([0, *(len(text) + 1 for text in group)])
    space = IS_SPACE[data]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        change = np.concatenate([[0], change])
    start, end = change[0::2], change[1::2]  # the last byte is a space, so every word ends
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LOWER[data] + np.uint64(1)) * up[:-1])])
    word = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.searchsorted(start, offsets)
    run = word.copy()
    for j in range(1, words):
        run[: len(run) - j] = mixed(run[: len(run) - j] * np.uint64(0x9FB21C651E98DF25) + word[j:]) if len(run) > j else run[: len(run) - j]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = mixed(whole * np.uint64(0x9FB21C651E98DF25) + word[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
