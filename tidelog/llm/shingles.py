"""Sets of word shingles as sorted 64-bit hashes, computed in Python workers."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

CACHE = 1 << 17
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Words are runs of bytes other than ASCII white space, A-Z in lower case; a text of fewer than k words has one shingle."""

    def __init__(self, k: int):
        self.k, self.cache = k, {}

    def words(self, text: str | None) -> np.ndarray:
        """The hash of every word of a text."""
        cache, out = self.cache, []
        if len(cache) > CACHE:
            cache.clear()
        for w in (text or "").encode().lower().split():
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def grams(self, words: np.ndarray) -> np.ndarray:
        """The hash of every shingle, in text order."""
        k = min(self.k, len(words))
        if not k:
            return words
        n = len(words) - k + 1
        with np.errstate(over="ignore"):
            h = mix(words[:n] + np.uint64(k))
            for j in range(1, k):
                h = mix(h * _A + words[j : j + n])
        return h


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def bitmap(tokens: np.ndarray, least: int = 256, most: int = 16384) -> np.ndarray:
    """Bit (hash mod width) for each token, as 64-bit words; the width is the least power of two from 4 bits a token on, clamped."""
    width = min(most, max(least, 1 << (4 * max(1, len(tokens)) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) as if they had been made with a width of `words` 64-bit words."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1) if maps.shape[1] != words else maps
