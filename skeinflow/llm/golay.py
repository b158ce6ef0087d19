"""The perfect binary Golay code of 23 bits as a fuzzy hash, for whole numpy arrays.

Each of the 2**23 words lies within 3 bits of exactly one of 4,096 codewords, which are 7 bits or more apart. A word's
own index is that of its codeword. A word 3 bits away from it has five more codewords at 4 bits. If two words differ in
at most one bit, the own index of each is among the indices (own and at 4 bits) of the other: let c be the codeword of
u, and v a neighbour of u. Either v is within 3 bits of c, so c is v's codeword as well; or u is at 3 bits and v at 4,
so v's codeword d is another. Then d is at least 7 - 4 = 3 bits away from v, thus exactly 3, and at most 4 from u.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, INDEX_BITS, CHECK_BITS = 23, 12, 11
#: Fixed value: the code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Indices that a word has at most.
MOST = 6


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


def _linear(values: list[int]) -> np.ndarray:
    """The table of a linear function from its values for single bits."""
    table = np.zeros(1, np.uint32)
    for value in values:
        table = np.concatenate([table, table ^ np.uint32(value)])
    return table


_ONE = [_remainder(1 << bit) for bit in range(BITS)]
_LOW, _HIGH = _linear(_ONE[:CHECK_BITS]), _linear(_ONE[CHECK_BITS:])


def _patterns(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """(error patterns of that weight, their remainders)"""
    words = np.array([sum(1 << b for b in bits) for bits in combinations(range(BITS), weight)], np.uint32)
    return words, remainders(words)


def remainders(words: np.ndarray) -> np.ndarray:
    return _LOW[words & np.uint32((1 << CHECK_BITS) - 1)] ^ _HIGH[words >> np.uint32(CHECK_BITS)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    own = np.zeros(1 << CHECK_BITS, np.uint32)
    for weight in range(4):
        words, rest = _patterns(weight)
        own[rest] = words
    words, rest = _patterns(4)
    order = np.argsort(rest, kind="stable")
    # a remainder has either five patterns of four bits, and one of three, or none
    far = np.zeros((1 << CHECK_BITS, MOST - 1), np.uint32)
    far[rest[order].reshape(-1, MOST - 1)[:, 0]] = words[order].reshape(-1, MOST - 1)
    return own, far


_OWN, _FAR = _tables()


def own_index(words: np.ndarray) -> np.ndarray:
    """The index of the codeword of each word (uint32 below 2**23)."""
    return (words ^ _OWN[remainders(words)]) >> np.uint32(CHECK_BITS)


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, index): the own index of each word, and the five at 4 bits of those 3 bits away from their own."""
    rest = remainders(words)
    torn = np.flatnonzero(_FAR[rest, 0])
    far = (words[torn, None] ^ _FAR[rest[torn]]) >> np.uint32(CHECK_BITS)
    own = (words ^ _OWN[rest]) >> np.uint32(CHECK_BITS)
    return np.concatenate([np.arange(len(words)), np.repeat(torn, MOST - 1)]), np.concatenate([own, far.ravel()])
