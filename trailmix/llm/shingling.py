"""Words and word n-grams of many texts at once, as hashes, by array arithmetic modulo 2**64."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at a time; this bounds the sums and the tables of powers, which workers keep.
BLOCK = 1 << 18
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(base)
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of consecutive words, by differences of sums from the first one's start on; a hash does not depend on where its word stands."""
    lo, n = starts[0], int(ends[-1] - starts[0])
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes[lo : lo + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    first, last = starts - lo, ends - lo
    return mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _STEP)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a list of texts: byte offsets, hashes, and the words' range per text."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        self.data = b" ".join([b"", *raw, b""])
        codes = np.frombuffer(self.data, np.uint8)
        if lower:
            codes = _LOWER[codes]
            self.data = codes.tobytes()
        blank = _BLANK[codes]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        self.hashes = np.empty(len(self.starts), np.uint64)
        cuts = np.unique([*np.searchsorted(self.starts, np.arange(0, len(codes), BLOCK)), len(self.starts)])
        for a, b in itertools.pairwise(cuts.tolist()):
            self.hashes[a:b] = word_hashes(codes, self.starts[a:b], self.ends[a:b])
        borders = np.cumsum([1, *(len(r) + 1 for r in raw)])
        self.bounds = np.searchsorted(self.starts, borders)  # text i has words bounds[i] to bounds[i + 1]

    def text(self, first: int, last: int) -> bytes:
        """Words first to last (exclusive), joined by one blank."""
        return b" ".join(self.data[s:e] for s, e in zip(self.starts[first:last], self.ends[first:last], strict=True))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` items, by doubling; runs do not mind where texts end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done = None, 0
    block, width, factor = hashes, 1, int(_STEP)
    rest = size
    while rest:
        if rest & 1:
            piece = block[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(int(_STEP), width, 1 << 64)) + piece
            done += width
        rest >>= 1
        if rest:
            block = block[:-width] * np.uint64(factor) + block[width:]
            width *= 2
            factor = factor * factor % (1 << 64)
    return mixed(out + np.uint64(size))


def least_over(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values."""
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out if width == size else np.minimum(out[: len(values) - size + 1], out[size - width :])


def portions(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; a longer text is a range of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)
