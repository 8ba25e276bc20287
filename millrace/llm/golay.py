"""The binary Golay code of 23 bits: every word is within three bits of exactly one codeword.

Its 4096 codewords are numbered by their 12 message bits. Two words that differ
in one bit decode to codewords which the other word, or a word one bit from it,
decodes to also; that is what the fuzzy keys rest on.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS = 23


def _remainder(word: int) -> int:
    for at in range(BITS - 1, 10, -1):
        if word >> at & 1:
            word ^= GENERATOR << (at - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits, and the error word of each remainder."""
    one = [_remainder(1 << i) for i in range(BITS)]

    def remainders(bits: range) -> np.ndarray:
        out = np.zeros(1, dtype=np.int64)
        for i in bits:
            out = np.concatenate([out, out ^ one[i]])
        return out

    errors = np.zeros(1 << 11, dtype=np.int64)
    for n in (1, 2, 3):
        for at in combinations(range(BITS), n):
            errors[np.bitwise_xor.reduce([one[i] for i in at])] = sum(1 << i for i in at)
    return remainders(range(12)), remainders(range(12, BITS)), errors


def index(words: np.ndarray) -> np.ndarray:
    """The number of the codeword nearest to each 23-bit word."""
    low, high, errors = _tables()
    words = words.astype(np.int64)
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11
