"""Word shingles of whole texts as 64-bit keys.

A word's key is a polynomial of its bytes modulo 2**64, taken for all words at once from
running sums over the text, and then mixed; a shingle's key mixes those of its words.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Powers:
    """Powers of the step and of its inverse, as many as the longest text so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            back = pow(_STEP, -1, 1 << 64)
            up, down = np.full(size, np.uint64(_STEP)), np.full(size, np.uint64(back))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def word_keys(text: str | None) -> np.ndarray:
    """A key for each word between ASCII blanks, with A-Z lowered."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    blank = np.ones(len(raw) + 2, np.int8)
    blank[1:-1] = _BLANK[raw]
    change = np.diff(blank)
    start, end = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    up, down = _POWERS.upto(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=run[1:])
    keys = (run[end] - run[start]) * down[start]
    keys ^= keys >> np.uint64(32)
    return keys * _MIX


def shingle_keys(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct keys of the runs of ``size`` words; of a shorter text, one key for all its words; none without words."""
    keys = word_keys(text)
    if not len(keys):
        return keys
    width = min(size, len(keys))
    out = np.full(len(keys) - width + 1, np.uint64(width))
    for k in range(width):
        out = (out ^ keys[k : len(keys) - width + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_key(keys: np.ndarray) -> int | None:
    """A signed 64-bit key of a whole set; null for the empty set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(keys.tobytes())))) if len(keys) else None
