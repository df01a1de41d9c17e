"""Hashes of words and of runs of words for a whole Arrow batch at a time, in numpy.

Words are [^\\x20\\x09-\\x0D]+ of the UTF-8 bytes. A word's hash is a polynomial over its bytes, from
running sums, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            for name, by in (("up", BASE), ("down", _INVERSE)):
                x = np.full(n + 1, by, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up, cls.down


class Words:
    """The words of some texts one after the other: hash, start and end byte; first holds each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        self.data = _LOWER[data] if lower else data
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets[offsets <= n]] = True
        space = _SPACE[data]
        before = np.concatenate([[True], space[:-1]]) if n else space
        after = np.concatenate([space[1:], [True]]) if n else space
        self.start = np.flatnonzero(~space & (before | edge[:n]))
        self.end = np.flatnonzero(~space & (after | edge[1:])) + 1
        up, down = _Powers.to(n)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=run[1:])
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((run[self.end] - run[self.start]) * down[self.start] + size * np.uint64(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.start, offsets)

    def runs(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on (over the ends of texts too; see whole())."""
        n = max(0, len(self.hash) - k + 1)
        out = np.full(n, np.uint64(k))
        for i in range(k):
            out = mix(out * np.uint64(0xA0761D6478BD642F) + self.hash[i : i + n])
        return out


def chunks(column: pa.Array, lower: bool = False, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) for runs of rows of about ``chunk`` bytes; a longer text is alone. Null is empty."""
    binary = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1] if len(binary) else np.zeros(1, np.int64)
    data = np.frombuffer(binary.buffers()[2], np.uint8) if len(binary) and binary.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(binary):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, side="right")) - 1)
        end = min(end, len(binary))
        yield at, end, Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], lower)
        at = end
