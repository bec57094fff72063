"""Rabin-Karp hashes and window segments over token arrays (numpy, inside a task).

A window is ``width`` consecutive tokens of one document. Its anchor is the leftmost of its
``gram``-token runs with the smallest hash, so equal windows have equal anchors at equal offsets.
Consecutive windows with one anchor position form a segment; a repeated window always lies
in segments whose anchor hash repeats. Segments are therefore a lossless unit, about
``2 / (width - gram)`` per token, for finding repeated windows without shuffling one row a token.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

LONGEST_ROLLED = 64  # bytes of a word; longer ones get a cryptographic hash
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit value (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums (mod 2^64), one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def run_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of tokens [lo, hi): the same for equal runs wherever they stand."""
    return mixed((prefix[hi] - prefix[lo]) * _power(_INVERSE, len(prefix))[lo]
                 + (hi - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row of one slice.

    Returns (64-bit value of each word, words in each row, byte start and end of each word).
    """
    text = data[offsets[0]:offsets[-1]]
    space = (text == 32) | ((text >= 9) & (text <= 13))
    begins = np.zeros(len(text) + 1, bool)
    begins[offsets[:-1][offsets[:-1] < offsets[-1]] - offsets[0]] = True  # a row always begins anew
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1] | begins[1:-1]
    last = word.copy()
    last[:-1] &= space[1:] | begins[1:-1]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    values = run_hash(prefix_hash(BYTE_VALUES[text]), lo, hi)
    # a polynomial modulo a power of two has known equal-valued strings of 1,024 bytes; short ones are too short for that
    for i in np.flatnonzero(hi - lo > LONGEST_ROLLED).tolist():
        values[i] = int.from_bytes(hashlib.blake2b(text[lo[i]:hi[i]].tobytes(), digest_size=8).digest(), "little")
    counts = np.diff(np.searchsorted(lo, offsets - offsets[0]))
    return values, counts, lo, hi


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


class Segments(NamedTuple):
    lo: np.ndarray  # first window start (in the concatenated tokens)
    n: np.ndarray  # windows
    anchor: np.ndarray  # tokens from lo to the anchor
    key: np.ndarray  # hash of the anchor
    whole: np.ndarray  # hash of all tokens of the segment's windows


def segments(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, gram: int) -> Segments:
    """Segments of all documents that stand one after another in ``values``."""
    none = np.empty(0, np.int64)
    fits = lengths >= width
    if not fits.any():
        return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    prefix = prefix_hash(values)
    at = np.arange(len(values) - gram + 1)
    grams = run_hash(prefix, at, at + gram)
    least = smallest((grams & _HIGH) | at.astype(np.uint64), width - gram + 1)
    valid = np.zeros(len(values) + 2, np.int8)
    np.add.at(valid, starts[fits], 1)
    np.add.at(valid, starts[fits] + lengths[fits] - width + 1, -1)
    windows = np.flatnonzero(np.cumsum(valid, dtype=np.int8))
    anchors = (least[windows] & _LOW).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(windows)))
    lo = windows[first]
    a = anchors[first]
    return Segments(lo, n, a - lo, grams[a], run_hash(prefix, lo, lo + n - 1 + width))
