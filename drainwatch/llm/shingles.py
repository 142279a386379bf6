"""Word shingles as sets of 64-bit fingerprints, computed per text inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# Fingerprints of words kept per Python worker; beyond it the memory starts anew.
KEPT_WORDS = 400_000
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class WordFingerprints(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


WORDS = WordFingerprints()


def mixed(x: np.ndarray, m: np.uint64) -> np.ndarray:
    x = x * m
    return x ^ (x >> np.uint64(31))


def fingerprints(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def chained(prints: np.ndarray, size: int) -> np.ndarray:
    """One fingerprint per run of ``size`` consecutive words; the length is part of it."""
    n = len(prints) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for k in range(size):
        out = mixed(mixed(out, MIX[k % 3]) + prints[k : k + n], MIX[3])
    return mixed(out, MIX[0])


def lowered_words(text: str | None) -> list[bytes]:
    """bytes.lower changes A-Z only, bytes.split splits at exactly the six ASCII blanks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct fingerprints of the text's shingles; a text with fewer words has its whole sequence as its only one."""
    words = lowered_words(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(chained(fingerprints(words), min(size, len(words))))
