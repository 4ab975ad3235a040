"""The binary Golay code of length 23 as a fuzzy hash.

The code is perfect: each of the 2^23 words lies within 3 bits of exactly one of
the 2^12 codewords. A word's keys are the codeword indices that the word and its
23 neighbours at one bit decode to (1 or 6 of them). Two words at two bits or
fewer share a key: the word between them is a neighbour of both.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS = 23
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1. Fixed value.
GENERATOR = 0b110001110101


@cache
def decode_table() -> np.ndarray:
    """For every 23-bit word the index (0 to 4095) of its codeword."""
    index = np.arange(1 << 12, dtype=np.uint32)
    words = np.zeros(1 << 12, np.uint32)
    for bit in range(12):
        words ^= np.where(index >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0))
    errors = np.array([sum(1 << b for b in some) for k in range(4) for some in combinations(range(BITS), k)], np.uint32)
    table = np.empty(1 << BITS, np.uint16)
    for e in errors:
        table[words ^ e] = index
    return table


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in `words`, key) of all distinct keys of each word."""
    flips = np.r_[0, 1 << np.arange(BITS)].astype(np.uint32)
    got = np.sort(decode_table()[words.astype(np.uint32)[:, None] ^ flips], axis=1)
    new = np.ones(got.shape, bool)
    new[:, 1:] = got[:, 1:] != got[:, :-1]
    return np.nonzero(new)[0], got[new].astype(np.int64)
