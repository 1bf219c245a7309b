"""Hashed word shingles of a batch of texts, in numpy."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash

_WORD = re.compile(r"\S+")
#: Texts whose words are held at once.
SLICE = 1000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of ``words`` lower-case words.

    A text of fewer words has one shingle of all of them, an empty text none.
    """
    return [s for lo in range(0, len(texts), SLICE) for s in _sets(texts[lo : lo + SLICE], words)]


def _sets(texts: list[str], words: int) -> list[np.ndarray]:
    split = [_WORD.findall(t.lower()) for t in texts]
    flat = np.empty(sum(map(len, split)), dtype=object)
    flat[:] = [w for ws in split for w in ws]
    codes, distinct = pd.factorize(flat)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in distinct), dtype=np.uint64, count=len(distinct))[codes] if len(distinct) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(len(hashes) - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        rolled = rolled * _ODD + hashes[k : k + len(rolled)] * np.uint64(2 * k + 3)
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= words:
            own = rolled[at : at + n - words + 1]
        else:
            one = 0
            for k in range(n):
                one = (one * int(_ODD) + int(hashes[at + k]) * (2 * k + 3)) % (1 << 64)
            own = np.full(min(n, 1), one, dtype=np.uint64)
        out.append(np.unique(mix(own)))
        at += n
    return out
