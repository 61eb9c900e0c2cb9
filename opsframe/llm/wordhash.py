"""Hashes of all words of many texts at once.

A word's hash is a polynomial of its bytes, taken from running sums over the whole chunk; so the cost
is a few array operations a byte, and there is no dictionary of words to keep.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Bytes of a chunk; a longer text is a chunk of its own.
CHUNK = 1 << 18
_R = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept for chunks of usual size; a longer text gets tables of its own, which go with it."""
    return _usual() if size <= CHUNK + 2 else _made(size)


@lru_cache(maxsize=1)
def _usual() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _made(CHUNK + 2)


def _made(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R)) | np.uint64(1)
    space = np.zeros((2, 256), dtype=bool)
    space[0, [0x20, *range(0x09, 0x0E)]] = True
    space[1, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

    def powers(r: int) -> np.ndarray:
        out = np.full(size, r, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return values, space, powers(_R), powers(pow(_R, -1, 1 << 64))


def _chunks(raws: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, r in enumerate(raws):
        if i > at and size + len(r) + 1 > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(r) + 1
    if at < len(raws):
        yield at, len(raws)


def word_hashes(texts: Sequence[str | None], letters: bool = False) -> list[np.ndarray]:
    """For each text the hashes of its words, A-Z lower-cased: runs of bytes other than 0x20 and 0x09-0x0D, or with
    `letters` of a-z, 0-9 and all beyond ASCII. None has none."""
    raws = [t.encode().lower() if t else b"" for t in texts]
    out: list[np.ndarray] = []
    for lo, hi in _chunks(raws):
        sizes = np.array([len(r) + 1 for r in raws[lo:hi]])
        raw = np.frombuffer(b" ".join([b"", *raws[lo:hi], b""]), dtype=np.uint8)
        n = len(raw)
        values, space, up, down = _tables(n)
        blank = space[int(letters)][raw]
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        # a word's first byte is at start + 1, its last one at end
        start, end = edge[::2], edge[1::2]
        sums = np.cumsum(values[raw] * up[:n])
        h = mix((sums[end] - sums[start]) * down[start + 1] ^ (end - start).astype(np.uint64))
        ends = np.searchsorted(start, np.cumsum(sizes))
        out += np.split(h, ends[:-1])
    return out
