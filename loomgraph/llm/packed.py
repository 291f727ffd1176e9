"""Many texts as one byte array: words and their hashes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers (the finaliser of a splittable generator)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers_cached(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, dtype=np.uint64)
    up = np.concatenate([one, np.cumprod(np.full(n, _P, dtype=np.uint64))])
    down = np.concatenate([one, np.cumprod(np.full(n, _PINV, dtype=np.uint64))])
    return up, down


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_cached(max(2 * CHUNK, 1 << (n - 1).bit_length() if n > 1 else 1))


def chunks(texts) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, last + 1, encoded texts) with about CHUNK bytes each; null texts are empty."""
    first, size, out = 0, 0, []
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "replace") if isinstance(t, str) else b""
        if out and size + len(b) > CHUNK:
            yield first, i, out
            first, size, out = i, 0, []
        out.append(b)
        size += len(b) + 1
    if out:
        yield first, first + len(out), out


class Packed:
    """Texts joined by line ends, with word bounds and a hash of any byte range."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.lens + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        self.low = LOWER[self.raw] if lower else self.raw
        w = IS_WORD[self.raw]
        edge = np.flatnonzero(w[1:] != w[:-1]) + 1
        if len(w) and w[0]:
            edge = np.concatenate([[0], edge])
        self.w0, self.w1 = edge[0::2], edge[1::2]  # the last byte is no word byte, so bounds come in pairs
        up, self._down = _powers(len(self.raw) + 1)
        self._sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[: len(self.low)], dtype=np.uint64)])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.w0, self.w1)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Number of the text that holds each byte position."""
        return np.searchsorted(self.starts, at, side="right") - 1
