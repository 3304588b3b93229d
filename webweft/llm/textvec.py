"""Whole batches of texts as numpy arrays: word positions, word hashes and n-gram hashes without a loop per word.

A word is a run of bytes over 32, so ASCII white space and control characters part words.
"""

from __future__ import annotations

from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[i for i in range(33, 128) if not chr(i).isalnum()]] = 32


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _table(base: np.uint64, n: int) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    return _powers(int(base), size)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of n texts: data (UTF-8 bytes), offsets (n+1, of texts), starts, ends (of words), ptr (n+1, first word of each text), hashes."""

    def __init__(self, texts: pa.Array, plain: bool = False):
        """plain: ASCII punctuation parts words too."""
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        if plain:
            self.data = _PLAIN[self.data]
        self.offsets = offsets - offsets[0]
        size = len(self.data)
        ink = self.data > 32
        first, last = ink.copy(), ink.copy()
        edges = self.offsets[:-1][self.offsets[:-1] < size]
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        first[edges] = ink[edges]
        last[edges[edges > 0] - 1] = ink[edges[edges > 0] - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.starts, self.offsets)
        if len(self.starts):
            v = (self.data.astype(np.uint64) + np.uint64(1)) * _table(_P, size)
            v[~ink] = 0
            self.hashes = mix(np.add.reduceat(v, self.starts) * _table(_P_INV, size)[self.starts])
        else:
            self.hashes = np.zeros(0, np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words in a row within a text, and where each text's hashes begin (n+1). Shorter texts have none."""
        w, count = self.hashes, np.diff(self.ptr)
        if len(w) < n:
            return np.zeros(0, np.uint64), np.zeros(len(self.ptr), np.int64)
        h = w[: len(w) - n + 1].copy()
        for k in range(1, n):
            h = h * _P + w[k : len(w) - n + 1 + k]
        has = np.maximum(count - n + 1, 0)
        keep = np.zeros(len(w) + 1, np.int32)
        np.add.at(keep, self.ptr[:-1][has > 0], 1)
        np.add.at(keep, (self.ptr[:-1] + has)[has > 0], -1)
        return mix(h[np.cumsum(keep[: len(h)]) > 0]), np.concatenate([[0], np.cumsum(has)])

    def pieces(self, size: int = 16, step: int = 13) -> Words:
        """The same texts with every word of more than `size` bytes cut into overlapping pieces: no byte is left out,
        and every `size - step` bytes in a row lie whole in a piece."""
        length = self.ends - self.starts
        many = 1 + np.maximum(0, -(-(length - size) // step))
        if not len(many) or many.max() == 1:
            return self
        owner = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        out = copy(self)
        out.starts = self.starts[owner] + nth * step
        out.ends = np.minimum(out.starts + size, self.ends[owner])
        out.ptr = np.concatenate([[0], np.cumsum(many)])[self.ptr]
        v = (self.data.astype(np.uint64) + np.uint64(1)) * _table(_P, len(self.data))
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
        cut = (before[out.ends] - before[out.starts]) * _table(_P_INV, len(self.data))[out.starts]
        out.hashes = np.where(many[owner] > 1, mix(cut), self.hashes[owner])
        return out
