"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
# Odd multipliers, one for each place of a word in its shingle.
_PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) | 1) & 0xFFFFFFFFFFFFFFFF for i in range(64)],
                   dtype=np.uint64)
_hash = xxhash.xxh3_64_intdigest


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits."""
    return [w.encode() for w in WORD.findall((text or "").lower())]


def spaced_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: Sequence[bytes], size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, in order; with fewer words, one for all of them."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_hash, words), dtype=np.uint64, count=len(words))
    if len(words) < size:
        total = np.array([len(words)], dtype=np.uint64)
        for i, h in enumerate(hashes):
            total = mix(total + h * _PLACES[i:i + 1])
        return total
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        out += mix(hashes[i:len(words) - size + 1 + i] * _PLACES[i])
    return mix(out)
