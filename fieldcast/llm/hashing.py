"""Vectorised hashes of byte strings, words and word windows (numpy, inside tasks)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _U(0xD1342543DE82EF95)

#: The bytes 0x09-0x0D and 0x20 part words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _BASE)


@lru_cache(maxsize=4)
def _powers(bits: int, inverse: bool) -> np.ndarray:
    out = np.full(1 << bits, _BASE_INV if inverse else _BASE, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def _bits(n: int) -> int:
    return max(21, n.bit_length())


def _prefix(buf: np.ndarray) -> np.ndarray:
    """prefix[i]: sum of code(byte j) * BASE**j over j < i, modulo 2**64."""
    out = np.zeros(len(buf) + 1, dtype=_U)
    codes = _byte_codes()[buf]
    codes *= _powers(_bits(len(buf)), False)[: len(buf)]
    np.cumsum(codes, out=out[1:])
    return out


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal bytes wherever they stand."""
    prefix = _prefix(buf)
    inverse = _powers(_bits(len(buf)), True)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def byte_grams(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of buf[i:i+k] for every i that has k bytes."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    prefix = _prefix(buf)
    grams = prefix[k:] - prefix[:n]
    grams *= _powers(_bits(len(buf)), True)[:n]
    return mix(grams)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of other bytes than SPACE."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] (given as word hashes) for every i that has k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += words[j : j + n]
    return mix(out)


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, a line feed after each, and where each starts (and the end)."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return buf, at


def anchors(grams: np.ndarray, span: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers: every window, given by its first gram, takes the leftmost least of its ``span`` grams.

    ``starts`` are the windows' positions in ascending order.  Returns anchor
    position, first window and number of windows for each run of neighbouring
    windows with one anchor.  Equal windows take the same anchor at the same
    distance, since the choice depends on the window's own grams alone."""
    if not len(starts):
        e = np.zeros(0, dtype=np.int64)
        return e, e, e
    least = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    at = (least[starts] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(starts) != 1)])
    return at[first], starts[first], np.diff(np.r_[first, len(starts)])
