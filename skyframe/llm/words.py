"""Words of many texts at once, in numpy, for use inside tasks.

A word is a maximal run of bytes that are not space or 0x09 to 0x0D, with A-Z lower-cased. Its
hash is a polynomial over random 64-bit values of its bytes, taken from one running sum over the
whole buffer, and mixed. Two of n different words share a hash with odds of about n**2 / 2**61.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ALL = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_BASE))
_STRETCH = 1 << 16
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(2 * n, 1 << 12)
        for at, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[at] = np.cumprod(grown)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of consecutive texts: those of text i are first[i] to first[i + 1]."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A stretch of the buffer at a time, so that sums and powers stay in the cache."""
        data = np.frombuffer(self.data, np.uint8)
        out = np.empty(len(self.starts), np.uint64)
        cuts = np.searchsorted(self.starts, np.arange(0, len(data) + _STRETCH, _STRETCH))
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low == high:
                continue
            begin, end = int(self.starts[low]), int(self.ends[high - 1])
            up, down = _powers_to(end - begin)
            sums = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(_BYTE[data[begin:end]] * up[: end - begin], out=sums[1:])
            starts, ends = self.starts[low:high] - begin, self.ends[low:high] - begin
            out[low:high] = (sums[ends] - sums[starts]) * down[starts]
        return mixed(out)


def words_of(texts: list[bytes | None], lower: bool = True) -> Words:
    """The words of each text; a null text has none. Without `lower`, as they are written."""
    parts = [text or b"" for text in texts]
    data = b"\n".join(parts)
    data = data.lower() if lower else data
    sizes = np.fromiter((len(part) + 1 for part in parts), np.int64, len(parts))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    inside = _IS_WORD[np.frombuffer(data, np.uint8)]
    if not len(inside):
        edges = np.empty(0, np.int64)
    else:
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate(([0] if inside[0] else [], edges, [len(inside)] if inside[-1] else [])).astype(np.int64)
    starts, ends = edges[0::2], edges[1::2]
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def slices(texts: list[bytes | None], size: int = 1 << 20):
    """Ranges of consecutive texts of about `size` bytes; a longer text is a range of its own."""
    begin, total = 0, 0
    for at, text in enumerate(texts):
        total += len(text or b"") + 1
        if total >= size:
            yield begin, at + 1
            begin, total = at + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def stretches(texts, size: int = 1 << 20):
    """Consecutive values of an Arrow array of texts, about `size` bytes at a time, with the place
    of the first; a longer text is a stretch of its own."""
    begin, part, total = 0, [], 0
    for at, value in enumerate(texts):
        part.append(value.as_py())
        total += len(part[-1] or b"") + 1
        if total >= size:
            yield begin, part
            begin, part, total = at + 1, [], 0
    if part:
        yield begin, part
