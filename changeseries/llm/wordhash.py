"""Vectorized hashes of words and word windows over many texts at once.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``. Hashes are 64 bits and
depend on the bytes alone, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

import functools

import numpy as np

SEED_1 = np.uint64(0x9E3779B97F4A7C15)
SEED_2 = np.uint64(0xC2B2AE3D27D4EB4F)
BASE = 0xD6E8FEB86659FD93
STEP = np.uint64(0xA0761D6478BD642F)
KEPT_POWERS = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def mixed(values: np.ndarray, seed: np.uint64 = SEED_1) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = values ^ seed
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of ``BASE`` and of its inverse modulo 2**64, grown on demand.

    The first ``KEPT_POWERS`` are computed once in a process, not in every task; more belong to the object.
    """

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size <= KEPT_POWERS:
            return _kept_powers()
        if len(self.up) < size:
            self.up, self.down = _powers(size)
        return self.up, self.down


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    factors = np.array([BASE, pow(BASE, -1, 1 << 64)], np.uint64)[:, None].repeat(size, axis=1)
    factors[:, 0] = 1
    up, down = np.cumprod(factors, axis=1, dtype=np.uint64)
    return up, down


@functools.cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(KEPT_POWERS)


class Words:
    """The words of some texts.

    ``starts, ends`` are byte places in ``buffer``, the texts joined by line feeds;
    ``bounds[i]:bounds[i + 1]`` are the words of text ``i``; ``hashes`` are 64-bit.
    """

    def __init__(self, texts: list[bytes], powers: Powers, lower: bool = False):
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.buffer = LOWERED[self.buffer]
        space = SPACE[self.buffer]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        after = np.cumsum(lengths + 1)
        self.bounds = np.concatenate(([0], np.searchsorted(self.starts, after)))
        self.hashes = self._hashes(powers)

    def _hashes(self, powers: Powers) -> np.ndarray:
        up, down = powers.get(len(self.buffer))
        sums = np.zeros(len(self.buffer) + 1, np.uint64)
        np.cumsum((self.buffer.astype(np.uint64) + np.uint64(1)) * up[: len(self.buffer)], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def left(self) -> np.ndarray:
        """How many words of its text begin at or after each word."""
        return np.repeat(self.bounds[1:], self.counts()) - np.arange(len(self.starts))


def window_hashes(hashes: np.ndarray, size: int, seed: np.uint64 = SEED_1) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ``size - 1`` places wrap and mean nothing."""
    out = np.zeros(len(hashes), np.uint64)
    padded = np.concatenate((hashes, hashes[: size - 1] if len(hashes) >= size else np.zeros(size, np.uint64)))
    for offset in range(size):
        out = out * STEP + padded[offset : offset + len(hashes)]
    return mixed(out, seed)


def runs_of_texts(texts: list, limit: int):
    """Slices ``(from, to)`` of the list whose texts have about ``limit`` bytes together."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
