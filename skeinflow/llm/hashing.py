"""64-bit hashes of words and word shingles, computed for whole byte buffers with numpy.

A word's hash is a polynomial over its bytes modulo 2**64, taken from running sums, then mixed; the result depends on
the word's bytes alone, not on where it stands. Buffers are worked off in pieces of about a megabyte that end at a word's
end, so memory doesn't follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

#: Bytes worked off at once.
PIECE = 1 << 20
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 1 << 16
#: An odd base and the constants of the splitmix64 generator.
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + LONG_WORD)
        _powers[:] = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def byte_values(separators: bytes, lower: bool = True) -> np.ndarray:
    """The value of each byte in the polynomial: 0 for a separator, else a random-looking number; A-Z count as a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    values[np.frombuffer(separators, np.uint8)] = 0
    return values


#: Words between white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = byte_values(b" \t\n\x0b\x0c\r")
#: Words of letters and digits: every other ASCII character separates.
ALNUM = byte_values(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)))


def _pieces(raw: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(raw)
    while n - at > PIECE:
        end = at + PIECE
        gaps = np.flatnonzero(values[raw[end - LONG_WORD : end]] == 0)
        if len(gaps):
            end = end - LONG_WORD + int(gaps[-1]) + 1
        else:
            while end < n:
                gaps = np.flatnonzero(values[raw[end : end + LONG_WORD]] == 0)
                if len(gaps):
                    end += int(gaps[0]) + 1
                    break
                end = min(n, end + LONG_WORD)
        yield at, end
        at = end
    yield at, n


def words(raw: np.ndarray, values: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer of bytes, and where each one begins."""
    hashes, begins = [], []
    for at, end in _pieces(raw, values):
        part = raw[at:end]
        v = values[part]
        inside = v != 0
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate(([0] if len(part) and inside[0] else [], turns, [len(part)] if len(part) and inside[-1] else [])).astype(np.int64)
        starts, ends = edges[0::2], edges[1::2]
        if not len(starts):
            continue
        if len(part) <= PIECE + LONG_WORD:
            power, inverse = _tables(len(part))
            sums = np.cumsum(v * power[: len(part)], dtype=np.uint64)
            before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
            h = mix((sums[ends - 1] - before) * inverse[starts])
        else:
            h = np.zeros(len(starts), np.uint64)
            for i in np.flatnonzero(ends - starts <= LONG_WORD):
                own = v[starts[i] : ends[i]]
                h[i] = np.cumsum(own * _tables(LONG_WORD)[0][: len(own)], dtype=np.uint64)[-1]
            h = mix(h)
        for i in np.flatnonzero(ends - starts > LONG_WORD):
            h[i] = int.from_bytes(blake2b(v[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        hashes.append(h)
        begins.append(starts + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins)


def batches_of(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold about ``size`` bytes together; a longer text stands alone."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield first, i
            first, total = i, 0
        total += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def shingles(texts: list[bytes], k: int, values: np.ndarray = WHITE) -> Iterator[tuple[int, np.ndarray]]:
    """(position in ``texts``, hashes of its shingles of k words in text order) for every text.

    With fewer than k words the whole sequence is one shingle; without words there is none.
    """
    odd = mix(np.arange(1, 2 * k + 1, dtype=np.uint64)) | np.uint64(1)
    for first, last in batches_of(texts):
        part = texts[first:last]
        # a line feed separates under both tables, so no word spans two texts
        raw = np.frombuffer(b"\n".join(part), np.uint8)
        h, begins = words(raw, values)
        bounds = np.cumsum([0] + [len(t) + 1 for t in part])
        cut = np.searchsorted(begins, bounds)
        n = len(h) - k + 1
        rolled = mix(sum(h[j : j + n] * odd[j] for j in range(k))) if n > 0 else np.zeros(0, np.uint64)
        for i in range(len(part)):
            a, b = int(cut[i]), int(cut[i + 1])
            if b - a >= k:
                yield first + i, rolled[a : b - k + 1]
            elif b > a:
                short = (h[a:b] * odd[: b - a]).sum(dtype=np.uint64, keepdims=True) + odd[k + b - a - 1 : k + b - a]
                yield first + i, mix(short)
            else:
                yield first + i, np.zeros(0, np.uint64)
