"""Vectorised 64-bit hashes of substrings and words, used inside Arrow batches."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        size = 1 << (n - 1).bit_length()
        _UP, _DOWN = _powers(_BASE, size), _powers(_INVERSE, size)
    return _UP[:n], _DOWN[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of h over the word; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any substrings of a buffer, from one running sum over it."""

    def __init__(self, data: np.ndarray):
        up, self.down = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """The hash of every window of ``size`` bytes."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima of blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


#: Lower-cases A-Z and turns the six ASCII white-space bytes into a space.
_PLAIN = bytes(ord(chr(b).lower()) if b < 128 else b for b in range(256)).translate(bytes(32 if 9 <= b <= 13 else b for b in range(256)))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of the texts, in order: hash and number of the text."""
    data = np.frombuffer(b" " + b" ".join(t.translate(_PLAIN) for t in texts) + b" ", dtype=np.uint8)
    gap = data == 32
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    ahead = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return Rolling(data).of(starts, ends), np.searchsorted(ahead, starts, side="right") - 1


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it has fewer."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : n - size + 1 + k])
    return h


def in_blocks(texts: list[bytes], most: int = 1 << 19):
    """Runs of texts of about ``most`` bytes together, as slices; a longer text is a run of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))
