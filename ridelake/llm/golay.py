"""The perfect Golay code (23, 12, 7): codewords near a word, as fuzzy hash keys.

Every 23-bit word has exactly one codeword within distance 3, and the codewords
within distance 4 are that one or, if it is at distance 3, six. Two words that
differ in at most 2 bits have a codeword within distance 4 of both: the one
nearest to a word half way between them.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS = 23
CHECKS = 11
REACH = 4


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of the words by the generator."""
    left = words.astype(np.int64)
    for shift in range(BITS - 1, CHECKS - 1, -1):
        left ^= ((left >> shift) & 1) * (GENERATOR << (shift - CHECKS))
    return left


@cache
def patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the errors of weight up to 4 that lead to a codeword, and how many there are."""
    errors = np.array([sum(1 << b for b in c) for n in range(REACH + 1) for c in combinations(range(BITS), n)], dtype=np.int64)
    at = syndromes(errors)
    counts = np.bincount(at, minlength=1 << CHECKS)
    table = np.zeros((1 << CHECKS, counts.max()), dtype=np.int64)
    order = np.argsort(at, kind="stable")
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    table[at[order], np.arange(len(at)) - starts[at[order]]] = errors[order]
    return table, counts


def near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``words``, index of a codeword within distance 4); the index is the codeword's data bits."""
    table, counts = patterns()
    at = syndromes(words)
    n = counts[at]
    place = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    return place, (words.astype(np.int64)[place] ^ table[at[place], nth]) >> CHECKS
