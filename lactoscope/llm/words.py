"""Words of UTF-8 texts and hashes of word windows, as whole-array operations."""

from __future__ import annotations

import numpy as np

# Odd multipliers: of bytes in a word, of words in a window.
_BYTE_STEP, _WORD_STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
# Bytes hashed at a time, so that a very long text needs no arrays of eight times its size.
_BLOCK = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# All but ASCII letters and digits ends a word here; bytes beyond ASCII belong to words.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_spans(data: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last one."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~gap[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of a 64-bit value."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(step: int, n: int) -> np.ndarray:
    powers = np.full(n, step, dtype=np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    n = len(starts)
    hashes = np.empty(n, dtype=np.uint64)
    if not n:
        return hashes
    powers = _powers(_BYTE_STEP, int((ends - starts).max()))
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _BLOCK)))
        s, e = starts[first:last], ends[first:last]
        lengths = e - s
        at = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        values = (data[inside + np.repeat(s, lengths)].astype(np.uint64) + np.uint64(1)) * powers[inside]
        hashes[first:last] = np.add.reduceat(values, at)
        first = last
    return mixed(hashes)


def hashed_words(data: np.ndarray, gap: np.ndarray = SPACE) -> np.ndarray:
    return word_hashes(data, *word_spans(data, gap))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; none if there are fewer."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    # Doubling: a window of 2m words is two windows of m words side by side.
    part, width, done, total = words, 1, 0, None
    size = len(words) - n + 1
    while True:
        if n & width:
            piece = part[done : done + size] * np.uint64(pow(_WORD_STEP, done, 1 << 64))
            total = piece if total is None else total + piece
            done += width
        if done == n:
            return mixed(total)
        part = part[:-width] + part[width:] * np.uint64(pow(_WORD_STEP, width, 1 << 64))
        width *= 2


def sliding(values: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbouring values."""
    if len(values) < width:
        return values[:0]
    part, done = values, 1
    while done * 2 <= width:
        part = of(part[:-done], part[done:])
        done *= 2
    rest = width - done
    return of(part[: len(values) - width + 1], part[rest : rest + len(values) - width + 1]) if rest else part


def covered(starts: np.ndarray, length, n: int) -> np.ndarray:
    """Which of n places lie in [start, start + length) for any start."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0
