"""The perfect binary Golay code of length 23 as a fuzzy hash of 23-bit words."""

from __future__ import annotations

import functools

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code.
GENERATOR = 0b110001110101


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator: 11-bit syndromes."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of weight 3 or less, and the patterns that lead to all codewords within distance 4."""
    one = 1 << np.arange(23)
    patterns = [np.zeros(1, np.int64), one]
    patterns += [np.array([a | b for i, a in enumerate(one) for b in one[:i]])]
    patterns += [np.array([a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]])]
    every = np.concatenate(patterns)
    near = np.zeros(2048, np.int64)
    near[_remainder(every)] = every
    # a word at distance 1 from w has the syndrome s ^ s(e); its error pattern, moved by e, leads from w to that word's codeword
    flips = np.concatenate(([0], one))
    syndromes = np.arange(2048)[:, None] ^ _remainder(flips)[None, :]
    return near, near[syndromes] ^ flips[None, :]


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the nearest codeword of each word (the perfect code has exactly one within distance 3)."""
    return (words ^ _tables()[0][_remainder(words)]) >> 11


def decode_near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the codeword indices to which the words within distance 1 decode, each once; 1 or 6 per word."""
    found = np.sort((words[:, None] ^ _tables()[1][_remainder(words)]) >> 11, axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    row, at = np.nonzero(first)
    return row, found[row, at]
