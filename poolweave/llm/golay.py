"""The binary Golay code (23, 12): every 23-bit word and the codewords near it."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

N, K, RADIUS = 23, 12, 4
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(N - 1, N - K - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (N - K))
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and for each syndrome the information bits
    of all error patterns of weight up to 4 that have it (six at most, -1 where there are fewer)."""
    bits = np.array([_remainder(1 << i) for i in range(N)], np.int64)

    def syndromes(first: int, count: int) -> np.ndarray:
        out = np.zeros(1 << count, np.int64)
        for i in range(count):
            out[1 << i : 2 << i] = out[: 1 << i] ^ bits[first + i]
        return out

    found: list[list[int]] = [[] for _ in range(1 << (N - K))]
    for weight in range(RADIUS + 1):
        for places in combinations(range(N), weight):
            pattern = sum(1 << p for p in places)
            found[np.bitwise_xor.reduce(bits[list(places)]) if places else 0].append(pattern >> (N - K))
    width = max(map(len, found))
    near = np.array([x + [-1] * (width - len(x)) for x in found], np.int64)
    return syndromes(0, 12), syndromes(12, 11), near


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For 23-bit words the indices (information bits) of all codewords within 4 bits, -1 as filler.

    The code is perfect: a word has one codeword within 3 bits, and six in all if that one is 3
    bits away. Two words that differ in at most two bits share at least one index.
    """
    low, high, near = tables()
    errors = near[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words >> (N - K))[:, None] ^ errors)
