"""Word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _A
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return (text or "").encode().translate(_LOWER).split()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of all runs of ``size`` words, ascending. Fewer words count as one run; no words give none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        out = mixed(out * _B + hashes[k : k + len(out)])
    return np.unique(out)


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return xxhash.xxh3_128_digest(shingles.tobytes())
