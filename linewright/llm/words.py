"""Words and word windows of a text, as numbers that numpy can work on."""

from __future__ import annotations

import numpy as np
import xxhash

# splitmix64, a public 64-bit finaliser (fixed values)
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly over all 64-bit numbers, one to one."""
    x = x + _GAMMA
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word; forgets all words when it holds ``most``."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None, fold: bool = False) -> list[bytes]:
    """Runs of characters other than space and tab to carriage return, as UTF-8.

    ``fold`` lower-cases A-Z only. ``bytes.split`` parts at exactly these six characters.
    """
    raw = (text or "").encode("utf-8")
    return (raw.lower() if fold else raw).split()


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per window of ``width`` words; a shorter sequence is one window."""
    if len(hashes) == 0:
        return hashes
    width_here = min(width, len(hashes))
    n = len(hashes) - width_here + 1
    out = np.full(n, np.uint64(width_here), dtype=np.uint64)
    for i in range(width_here):
        out = mix(out ^ hashes[i : i + n])
    return out


def windows(words: list[bytes], width: int) -> set[bytes]:
    """The distinct windows themselves, exactly; words hold no space, so joining is one to one."""
    if not words:
        return set()
    width = min(width, len(words))
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
