"""BagMinHash signatures of weighted sets, for many sets at once (numpy).

Every (element, weight level) pair owns a Poisson process whose points carry a time, one of m registers and
a position within the level; levels double in width: [0, 1), [1, 2), [2, 4), ... A point counts for a set if
its position lies below the element's weight there. A register keeps its earliest point, so two sets agree
in it with the probability of their weighted Jaccard similarity. Points later than every register's minimum
can change nothing: processes are followed only up to a limit that the total weight gives, and a set with a
register still empty is followed further, so the result does not depend on the limit.
"""

from __future__ import annotations

import numpy as np

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def _wrapped(n: int) -> np.uint64:
    return np.uint64(int(_A) * n & 0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, m: int) -> np.ndarray:
    """uint64 registers, (sets, m). elements: hashes, weights > 0, owner: the set of each; every set has an element."""
    registers = np.full((sets, m), np.inf)
    total = np.bincount(owner, weights=weights, minlength=sets)
    limit = (np.log(m) + 5.0) / np.maximum(total, 1e-12)
    todo = np.arange(sets)
    reach = 1.0
    while len(todo):
        chosen = np.isin(owner, todo) if len(todo) < sets else slice(None)
        _follow(registers, elements[chosen], weights[chosen], owner[chosen], limit * reach, m)
        todo = np.nonzero(np.isinf(registers).any(axis=1))[0]
        reach *= 2.0
    return registers.view(np.uint64)


def _follow(registers: np.ndarray, elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, limit: np.ndarray, m: int) -> None:
    level, low, width = 0, 0.0, 1.0
    while True:
        inside = weights > low
        if not inside.any():
            return
        e, w, o = elements[inside], weights[inside], owner[inside]
        state = mix(e + _wrapped(2 * level + 1))
        time = np.zeros(len(e))
        while len(e):
            state = mix(state + _A)
            time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
            alive = time <= limit[o]
            state, time, w, o, e = state[alive], time[alive], w[alive], o[alive], e[alive]
            draw = mix(state ^ _C)
            place = low + width * ((draw >> np.uint64(40)).astype(np.float64) * 2.0**-24)
            counts = place < w
            np.minimum.at(registers, (o[counts], ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)[counts]), time[counts])
        low, width, level = low + width, low + width, level + 1


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for every run of `rows` registers; the band's number is part of it."""
    sets, m = registers.shape
    out = np.empty((sets, m // rows), dtype=np.uint64)
    for b in range(m // rows):
        key = np.full(sets, _wrapped(b + 1))
        for r in range(b * rows, (b + 1) * rows):
            key = mix(key ^ registers[:, r])
        out[:, b] = key
    return out.view(np.int64)
