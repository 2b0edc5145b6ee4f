"""Rolling hashes of texts (the functions are the core's) and digests of words."""

from __future__ import annotations

import numpy as np
import xxhash

from tessel.functions.rolling import MULTIPLIER, code_points, gear, gear_hash, mix, sliding, window_hash

__all__ = ["MULTIPLIER", "WordDigests", "code_points", "gear", "gear_hash", "mix", "sliding", "window_hash"]


class WordDigests:
    """64-bit digests of words, kept between texts, at most ``kept`` and one text's more."""

    def __init__(self, kept: int = 200_000):
        self.known: dict[str, int] = {}
        self.kept = kept

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self.kept:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            return np.array([known[w] for w in words], np.uint64)
