"""Words of whole Arrow blocks at once: boundaries and 64-bit hashes, without a Python loop.

A word is a maximal run of word bytes inside one text. Every byte of a multi-byte UTF-8 character is a
word byte, so words found by bytes are words found by characters. A word's hash is a polynomial over its
bytes modulo 2**64, scrambled; where a decision needs more than a hash, callers compare the words.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from .shared import mixed

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SEQUENCE = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Alphabet:
    """Which bytes are in words, and what each byte counts as."""

    inside: np.ndarray
    folded: np.ndarray


def alphabet(separators: bytes, fold: bool) -> Alphabet:
    folded = np.arange(256, dtype=np.uint8)
    if fold:
        folded[65:91] += 32
    inside = np.ones(256, bool)
    inside[np.frombuffer(separators, np.uint8)] = False
    return Alphabet(inside[folded], folded)


#: Words between white space, as they are, and with A-Z in lower case.
SPACED = alphabet(b" \t\n\v\f\r", False)
SPACED_FOLDED = alphabet(b" \t\n\v\f\r", True)
#: Words of digits, a-z and everything beyond ASCII, A-Z in lower case.
LETTERED = alphabet(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)), True)


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, size: int) -> np.ndarray:
    return _powers(base, 1 << max(20, (size - 1).bit_length()))[:size] if size else np.zeros(0, np.uint64)


@dataclass
class Words:
    """starts, ends: of each word in data; first: the index of each text's first word (n + 1); hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def text(self, i: int, kinds: Alphabet) -> bytes:
        return kinds.folded[self.data[self.starts[i] : self.ends[i]]].tobytes()


def find(data: np.ndarray, offsets: np.ndarray, kinds: Alphabet, hashed: bool = True) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    inside, cut = np.zeros(n + 2, bool), np.zeros(n + 1, bool)
    inside[1:-1] = kinds.inside[data]
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (cut[:-1] | ~inside[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (cut[1:] | ~inside[2:])) + 1
    first = np.searchsorted(starts, offsets)
    hashes = np.zeros(0, np.uint64)
    if hashed and len(starts):
        total = np.zeros(n + 1, np.uint64)
        weighted = (kinds.folded[data].astype(np.uint64) + np.uint64(1)) * powers(BASE, n)
        np.cumsum(weighted, out=total[1:])
        hashes = mixed((total[ends] - total[starts]) * powers(INVERSE, n)[starts])
    return Words(data, starts, ends, first, hashes)


def sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= SEQUENCE
        out += hashes[j : j + n]
    return mixed(out)


def whole_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a sequence of any length, as sequence_hashes gives for its length."""
    return sequence_hashes(hashes, len(hashes))[0]
