"""The leading 32 bits of many MD5 digests at once, in numpy.

A draw for each of many events and repetitions is the MD5 of a prefix (seed,
repetition, record) and a suffix (event), so that SQL can repeat it. Prefixes
and suffixes of one length go together: only the words that differ are arrays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np

_TURNS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_SHIFTS = [(np.array(n, np.uint32), np.array(32 - n, np.uint32)) for n in (_TURNS[i // 16][i % 4] for i in range(64))]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Digests worked on at once: fewer are mostly the overhead of numpy's calls.
AT_ONCE = 32_768
#: And so few are left to hashlib.
FEW = 1_500
#: A longer message needs a second block.
ONE_BLOCK = 55


def _by_length(texts: list[bytes]) -> Iterable[tuple[int, np.ndarray]]:
    lengths = np.array([len(t) for t in texts])
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


def _words(texts: list[bytes], at: int, total: int | None) -> np.ndarray:
    """The texts at a place in blocks of 64 bytes, as (16, texts) words; with the end of a message of ``total`` bytes if given."""
    blocks = np.zeros((len(texts), 64), dtype=np.uint8)
    n = len(texts[0])
    blocks[:, at : at + n] = np.frombuffer(b"".join(texts), dtype=np.uint8).reshape(len(texts), n)
    words = blocks.view("<u4").T.copy()
    if total is not None:
        words[total // 4] |= np.uint32(0x80 << 8 * (total % 4))
        words[14] = 8 * total
    return words


def _leading(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The first word of the digests of one block each, its bytes in the order in which they are written.

    That word is settled three steps before the end. Words need not be of the
    full shape: most are the same for all rows or for all columns.
    """
    a, b, c, d = (np.full(shape, x) for x in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):
        part = i // 16
        if part == 0:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif part == 1:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif part == 2:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        left, right = _SHIFTS[i]
        np.add(f, a, f)
        np.add(f, words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[part] % 16] + _SINES[i], f)
        np.left_shift(f, left, g)
        np.right_shift(f, right, f)
        np.bitwise_or(f, g, f)
        np.add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    b += _START[0]
    return b.byteswap()


def _met(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A word of each prefix and each suffix, as a column or a row where the other side does not tell apart."""
    left, right = (x[:1] if (x == x[0]).all() else x for x in (left, right))
    return left[:, None] | right[None, :]


def md5_leading(prefixes: list[bytes], suffixes: list[bytes]) -> np.ndarray:
    """(prefixes, suffixes): the first 8 hexadecimal digits of md5(prefix + suffix) as numbers."""
    out = np.empty((len(prefixes), len(suffixes)), dtype=np.uint32)
    for n, ends in _by_length(suffixes):
        for m, starts in _by_length(prefixes):
            if n + m > ONE_BLOCK or len(starts) * len(ends) < FEW:
                for i in starts:
                    out[i, ends] = [int.from_bytes(hashlib.md5(prefixes[i] + suffixes[j]).digest()[:4], "big") for j in ends]
                continue
            for own in _even(ends, AT_ONCE):
                right = _words([suffixes[j] for j in own], m, n + m)
                for rows in _even(starts, max(1, AT_ONCE // len(own))):
                    left = _words([prefixes[i] for i in rows], 0, None)
                    words = [_met(x, y) for x, y in zip(left, right, strict=True)]
                    out[rows[:, None], own] = _leading(words, (len(rows), len(own)))
    return out


def _even(places: np.ndarray, most: int) -> list[np.ndarray]:
    """Parts of some one size, none of more than ``most``."""
    return np.array_split(places, -(-len(places) // most))
