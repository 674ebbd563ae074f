"""The row of least MD5 under each of many prefixes, for thousands of rows at once.

MD5 takes 64 short steps on a block of 64 bytes. Each step is done here by a few NumPy calls on all
rows of a part, and rows are compared by the first word of their digests, which is settled three
steps before the end. Only rows that share the least word are hashed to the end, one by one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORDS = ((1, 0), (5, 1), (3, 5), (7, 0))
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
# Rows and cells (rows times prefixes) done together, the longest text that is, and the rows from which it pays.
_ROWS_AT_ONCE, _CELLS_AT_ONCE, _LONGEST, _FEW = 1 << 14, 1 << 16, 200, 256
_BLOCK = 64


def least(prefixes: Sequence[bytes], texts: pa.Array, known: list[str | None]) -> dict[int, tuple[str, int]]:
    """For each prefix whose least digest falls below the one ``known``: the digest and the row of the text.

    ``texts`` has no nulls. Digests are in hexadecimal, as the least of them is sought.
    """
    found: dict[int, tuple[str, int]] = {}

    def offer(nth: int, row: int) -> None:
        digest = hashlib.md5(prefixes[nth] + texts[row].as_py(), usedforsecurity=False).hexdigest()
        before = found[nth][0] if nth in found else known[nth]
        if before is None or digest < before:
            found[nth] = digest, row

    texts = texts.cast(pa.large_binary())
    lengths = _lengths(texts)
    short = lengths <= _LONGEST
    for row in np.flatnonzero(~short).tolist():
        for nth in range(len(prefixes)):
            offer(nth, row)
    rows = np.flatnonzero(short)
    for begin in range(0, len(rows), _ROWS_AT_ONCE):
        part = rows[begin : begin + _ROWS_AT_ONCE]
        long = lengths[part]
        letters = _letters(texts.take(pa.array(part)))
        for size in sorted({len(prefix) for prefix in prefixes}):
            those = [nth for nth, prefix in enumerate(prefixes) if len(prefix) == size]
            blocks = (size + long + 8) // _BLOCK + 1
            for count in np.unique(blocks).tolist():
                some = np.flatnonzero(blocks == count)
                if len(some) < _FEW or size > _BLOCK - 8:
                    for row in part[some].tolist():
                        for nth in those:
                            offer(nth, row)
                    continue
                words = _words(letters[some], long[some], size, count)
                many = max(1, _CELLS_AT_ONCE // len(some))
                for together in (those[i : i + many] for i in range(0, len(those), many)):
                    firsts = _first_words(words, [prefixes[nth] for nth in together], len(some))
                    for nth, first, lowest in zip(together, firsts, firsts.min(axis=1).tolist()):
                        before = found[nth][0] if nth in found else known[nth]
                        if before is not None and lowest > int(before[:8], 16):
                            continue
                        nearest = some[first == lowest]
                        # Texts that come again and again are hashed once.
                        same = (letters[nearest] == letters[nearest[0]]).all(axis=1) & (long[nearest] == long[nearest[0]])
                        for row in part[[nearest[0], *nearest[~same]]].tolist():
                            offer(nth, row)
    return found


def _lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(_offsets(texts))


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], dtype="<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype="<i8")


def _letters(texts: pa.Array) -> np.ndarray:
    """Bytes of the texts, a row for each, zeros behind them."""
    offsets = _offsets(texts)
    lengths = np.diff(offsets)
    letters = np.zeros((len(texts), int(lengths.max())), dtype=np.uint8)
    if letters.size:
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
        letters[np.arange(letters.shape[1]) < lengths[:, None]] = data[offsets[0] : offsets[-1]]
    return letters


def _words(letters: np.ndarray, lengths: np.ndarray, size: int, blocks: int) -> list[np.ndarray | None]:
    """Words of the padded messages, rows side by side, with room of ``size`` bytes for a prefix; None where all are 0."""
    n, every = len(letters), np.arange(len(letters))
    padded = np.zeros((n, blocks * _BLOCK), dtype=np.uint8)
    width = min(letters.shape[1], padded.shape[1] - size)
    padded[:, size : size + width] = letters[:, :width]
    padded[every, size + lengths] = 0x80
    padded[:, -8:] = ((size + lengths) * 8).astype("<u8").view(np.uint8).reshape(n, 8)
    return [np.ascontiguousarray(word) if word.any() else None for word in padded.view("<u4").T]


def _first_words(words: list[np.ndarray | None], prefixes: Sequence[bytes], n: int) -> np.ndarray:
    """The first word of each row's digest under each prefix, as a number that is ordered like its hexadecimal text."""
    given = np.array([np.frombuffer(prefix + bytes(-len(prefix) % 4), dtype="<u4") for prefix in prefixes]).T[:, :, None]
    state = [np.full((len(prefixes), n), x) for x in _START]
    x, y = np.empty_like(state[0]), np.empty_like(state[0])
    for begin in range(0, len(words), 16):
        block = words[begin : begin + 16]
        if begin == 0:
            block = [*[g if word is None else word | g for word, g in zip(block, given)], *block[len(given) :]]
        last = begin + 16 == len(words)
        ended = _steps([part.copy() for part in state], block, 61 if last else 64, x, y)
        if last:
            return (ended[1] + state[0]).byteswap()
        state = [before + after for before, after in zip(state, ended)]
    raise ValueError("a message has a block")


def _steps(state: list[np.ndarray], block: list, count: int, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The first ``count`` steps on a block, in place."""
    a, b, c, d = state
    for i in range(count):
        turn, (times, plus) = i // 16, _WORDS[i // 16]
        if turn == 0:
            np.bitwise_xor(c, d, out=x)
            x &= b
            x ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=x)
            x &= d
            x ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=x)
            x ^= d
        else:
            np.invert(d, out=x)
            x |= b
            x ^= c
        x += a
        x += _ADDED[i]
        word = block[(times * i + plus) % 16]
        if word is not None:
            x += word
        shift = _TURNS[turn][i % 4]
        np.left_shift(x, np.uint32(shift), out=y)
        x >>= np.uint32(32 - shift)
        x |= y
        np.add(x, b, out=a)
        a, b, c, d = d, a, b, c
    return [a, b, c, d]
