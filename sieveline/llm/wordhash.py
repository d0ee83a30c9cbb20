"""Words and their 64-bit hashes from UTF-8 text, without a Python step for each word.

A word is a run of bytes other than space and \\x09-\\x0D, with A-Z taken as a-z. Its hash is a polynomial over a table
of random byte values modulo 2^64, read off prefix sums, and then mixed. Texts are taken whole: in blocks of about
``BLOCK`` bytes, cut at white space, so memory doesn't grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20_231)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
#: Bytes by kind for shapes: a for small letters and all beyond ASCII, A for large ones, 0 for digits, others as they are.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123], _KIND[128:], _KIND[65:91], _KIND[48:58] = 1, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + (1 << 16))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    gap = SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    first, last = [] if len(data) == 0 or gap[0] else [0], [] if len(data) == 0 or gap[-1] else [len(data)]
    edge = np.concatenate([np.array(first, np.int64), edge, np.array(last, np.int64)])
    return edge[0::2], edge[1::2]


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of the runs starts:ends of 64-bit values."""
    up, down = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _blocks(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > BLOCK:
        cut = at + BLOCK
        while cut < len(text) and not SPACE[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _words(data: np.ndarray) -> np.ndarray:
    return hash_runs(_VALUE[data], *bounds(data))[None]


def words_and_shapes(data: np.ndarray) -> np.ndarray:
    """Two rows: hashes of the words, and of their shapes, where runs of small, large, digit and other bytes count once."""
    starts, ends = bounds(data)
    kind = _KIND[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep &= ~SPACE[data]
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    shapes = hash_runs(_VALUE[kind[keep]], count[starts], count[ends])
    return np.stack([hash_runs(_VALUE[data], starts, ends), shapes])


def word_hashes(texts: list[bytes | None], of=_words) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts i:j, the hashes of all their words and where each text's words begin in them (and the end).

    ``of`` makes rows of hashes from bytes; with more than one row the result has these rows.
    """
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") <= BLOCK):
            size += len(texts[j] or b"") + 1
            j += 1
        if j == i + 1 and size > BLOCK + 1:
            rows = np.concatenate([of(np.frombuffer(block, np.uint8)) for block in _blocks(texts[i])], axis=1)
            ptr = np.array([0, rows.shape[1]])
        else:
            data = np.frombuffer(b"\n".join(t or b"" for t in texts[i:j]), np.uint8)
            rows = of(data)
            begin = np.zeros(j - i + 1, np.int64)
            np.cumsum([len(t or b"") + 1 for t in texts[i:j]], out=begin[1:])
            ptr = np.searchsorted(bounds(data)[0], begin)
        yield i, j, rows[0] if len(rows) == 1 else rows, ptr
        i = j


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words; the whole sequence as one where it is shorter; none without words."""
    if len(hashes) == 0:
        return hashes
    n = max(1, len(hashes) - size + 1)
    out = np.full(n, min(size, len(hashes)), np.uint64)
    for k in range(min(size, len(hashes))):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n])
    return out
