"""Hashed word features whose scores are linear, so a word's score can be kept by word."""

from __future__ import annotations

import zlib
from array import array

import numpy as np

BITS = 18
#: Words whose scores a task keeps before it starts anew.
KEPT = 1 << 20


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings (inflected and compound forms share them)."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(b"=" + word.encode()) & mask, *(zlib.crc32(b"^" + word[:n].encode()) & mask for n in range(3, min(len(word), 9)))]


class WordScores(dict):
    """word -> sum of its features' weights."""

    def __init__(self, weights: np.ndarray, features=word_features) -> None:
        super().__init__()
        self.weights, self.features = weights, features

    def __missing__(self, word: str) -> float:
        if len(self) > KEPT:
            self.clear()
        self[word] = score = float(self.weights[self.features(word)].sum())
        return score


def incidence(words: list[str], features=word_features) -> tuple[np.ndarray, np.ndarray]:
    """For each word the buckets of its features, as two parallel arrays (word place, bucket)."""
    sizes, buckets = array("i"), array("i")
    for w in words:
        found = features(w)
        sizes.append(len(found))
        buckets.extend(found)
    return np.repeat(np.arange(len(words), dtype=np.int32), np.array(sizes)), np.array(buckets)
