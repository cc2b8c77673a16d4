"""Word hashes of packed texts, all in numpy."""

from __future__ import annotations

import numpy as np

_K = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes that are hashed at a time; a word may reach over any number of these blocks.
BLOCK = 1 << 20
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    """Powers of an odd base modulo 2^64."""
    steps = np.full(BLOCK, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mix(a * _K + (b ^ np.uint64(salt)))


def word_hashes(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in lower case (A-Z), index of each text's first word and one end).

    data, off: packed texts. is_word: 256 flags, the bytes that make up words. A word's
    hash is a sum over its bytes, so it is gathered block by block, however long the text.
    """
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        inside = is_word[block]
        before = np.empty_like(inside)
        before[0] = at > 0 and is_word[data[at - 1]]
        before[1:] = inside[:-1]
        before[off[np.searchsorted(off, at) : np.searchsorted(off, at + len(block))] - at] = False
        starts = np.flatnonzero(inside & ~before)
        weighed = (_LOWER.astype(np.uint64) + np.uint64(1))[block]
        weighed *= _UP[: len(block)]
        weighed[~inside] = 0
        if inside[0] and before[0]:  # the rest of a word that began in an earlier block
            last = next(i for i in reversed(range(len(places))) if len(places[i]))
            rest = int(weighed[: starts[0] if len(starts) else None].sum(dtype=np.uint64))
            moved = rest * pow(_BASE, at - int(places[last][-1]), 1 << 64) & _ALL
            hashes[last][-1] = (int(hashes[last][-1]) + moved) & _ALL
        if len(starts):
            hashes.append(np.add.reduceat(weighed, starts) * _DOWN[starts])
            places.append(starts + at)
    return mix(np.concatenate(hashes)), np.searchsorted(np.concatenate(places), off)


BLANK_BYTES = [0x20, *range(9, 14)]
NON_BLANK = np.ones(256, bool)
NON_BLANK[BLANK_BYTES] = False
#: Letters and digits of ASCII and all bytes of other characters.
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
