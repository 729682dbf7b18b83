"""Hashes of words and of runs of words, by doubling.

A word's hash is a keyed blake2b of its bytes. The hash of two runs in a row, or of two that
overlap, mixes both of theirs; so a run of any length is reached in about log2 steps of
whole arrays. Nothing here is linear in the words, and what calls two runs equal for good
compares their words.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Words a worker remembers, and the longest (bytes).
MEMO_WORDS = 200_000
MEMO_BYTES = 48

_KEY = b"words of the corpus operators"


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=_KEY).digest(), "little")
        if len(self) < MEMO_WORDS and len(word) <= MEMO_BYTES:
            self[word] = found
        return found


_WORDS = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xA0761D6478BD642F))


def run_hashes(words: list[bytes], *sizes: int) -> list[np.ndarray]:
    """For each of the ascending sizes, 64-bit hashes of every size consecutive words (none if there are fewer)."""
    now, length, out = word_hashes(words), 1, []
    for size in sizes:
        if len(words) < size:
            out.append(np.empty(0, dtype=np.uint64))
            continue
        while 2 * length <= size:
            now, length = _both(now[:-length], now[length:]), 2 * length
        gap = size - length
        out.append(_both(now[:-gap], now[gap:]) if gap else now)
    return out
