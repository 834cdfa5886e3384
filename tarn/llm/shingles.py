"""Sets of word shingles as 64-bit integers, computed a batch of texts at a time.

Words are runs of bytes other than space and the controls 9 to 13, with A-Z in
lower case. A word's hash sums random values of its bytes times powers; a
shingle's hash sums its words' mixed hashes times constants, and is mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
_draw = np.random.default_rng(85)
_OF_BYTE = _draw.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _STEP, np.uint64))
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words_of_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of some bytes."""
    inside = _IS_WORD[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    sizes = ends - starts
    longest = int(sizes.max())
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _STEP, np.uint64))
    places = np.flatnonzero(inside)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values = _OF_BYTE[data[places]] * powers[np.arange(len(places)) - np.repeat(first, sizes)]
    return starts, mix(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all words, in pieces that end between words."""
    bytes_ = np.frombuffer(data, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(bytes_):
        end = min(len(bytes_), at + PIECE)
        while end < len(bytes_) and _IS_WORD[bytes_[end]]:
            wide = np.flatnonzero(~_IS_WORD[bytes_[end : end + PIECE]])
            end = end + int(wide[0]) if len(wide) else min(len(bytes_), end + PIECE)
        s, h = _words_of_piece(bytes_[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingles; with fewer words than ``width``, all of them as one; without words none."""
    blobs = [(t or "").encode().lower() for t in texts]
    starts, hashes = word_hashes(b"\n".join(blobs))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(b) + 1 for b in blobs])]))
    factors = _POWERS[:width]
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        n = int(j - i)
        if n == 0:
            yield np.zeros(0, np.uint64)
        elif n < width:
            yield mix((hashes[i:j] * factors[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            total = np.full(n - width + 1, width, np.uint64)
            for k in range(width):
                total += hashes[i + k : j - width + 1 + k] * factors[k]
            yield np.unique(mix(total))
