"""Words `[^\\x20\\x09-\\x0D]+` of many texts at once, as offsets into one byte buffer, with 64-bit hashes.

Hashes are polynomials over bytes (or over word hashes) modulo 2^64, taken as differences of running sums; they choose
and group, and equality is always settled on the bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 20
MASK = (1 << 64) - 1
_POWERS: dict[int, np.ndarray] = {}


@dataclass
class Words:
    """`data` holds every word followed by one space (split_words); word i is data[starts[i]:ends[i]]; text t has words
    first[t] to first[t + 1]."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def split_words(texts: list[bytes]) -> Words:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    white = WHITE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], white)).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep = ~white
    keep[ends] = True
    data = raw[keep]
    lengths = ends - starts
    new_ends = np.cumsum(lengths + 1) - 1
    data[new_ends] = 0x20
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return Words(data.tobytes(), new_ends - lengths, new_ends, np.searchsorted(starts, bounds))


# Byte kinds: 0 white space, 1 letters (and all bytes of other characters), 2 digits, 3 other signs.
KIND = np.full(256, 3, dtype=np.int8)
KIND[WHITE] = 0
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KIND[0x30:0x3A] = 2


def split_tokens(texts: list[bytes]) -> Words:
    """Runs of one kind of bytes instead of whole words; `data` is the texts as they are, each ended by a line feed."""
    data = b"\n".join(texts) + b"\n"
    kind = KIND[np.frombuffer(data, dtype=np.uint8)]
    change = np.flatnonzero(np.diff(kind, prepend=0))
    starts = change[kind[change] > 0]
    ends = np.append(change, len(kind))[np.searchsorted(change, starts) + 1]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return Words(data, starts, ends, np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes)))))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls up to the block size."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base & MASK, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 2 * BLOCK:
            _POWERS[base] = have
    return have[:n]


def _runs(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[begin:end] for each pair."""
    up, down = powers(base, len(values) + 1), powers(pow(base, -1, 1 << 64), len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return (total[end] - total[begin]) * down[begin]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words) -> np.ndarray:
    """A mixed 64-bit hash of each word, block by block so that memory does not follow the length of a text."""
    data = np.frombuffer(words.data, dtype=np.uint8)
    out = np.empty(len(words.starts), dtype=np.uint64)
    at = 0
    while at < len(out):
        upto = max(at + 1, int(np.searchsorted(words.ends, words.starts[at] + BLOCK)))
        low = words.starts[at]
        block = data[low:words.ends[upto - 1]].astype(np.uint64) + np.uint64(1)
        out[at:upto] = _runs(block, words.starts[at:upto] - low, words.ends[at:upto] - low, BASE)
        at = upto
    return mix(out)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A mixed hash of each run of `size` words, whatever text they belong to."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, BLOCK):
        upto = min(n, at + BLOCK)
        begin = np.arange(upto - at)
        out[at:upto] = _runs(hashes[at:upto + size - 1], begin, begin + size, 0xD6E8FEB86659FD93)
    return mix(out)
