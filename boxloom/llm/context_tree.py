"""Context-tree weighting over bytes, binary-decomposed, on arrays of counted byte strings.

A gram is a byte with the ``DEPTH`` bytes before it, as one number: nearest context byte first,
the byte itself last. Each bit of a byte is a binary source of its own, told apart by the bits
before it; each such source has a context tree whose levels are the preceding bytes. A node's
Krichevsky-Trofimov estimate is mixed with the product of its children:

    Pw = 1/2 Pe + 1/2 prod(Pw of children), at the deepest level Pw = Pe.

Coding with the trained tree goes from the deepest context seen in training to the root:
p = w KT + (1 - w) p_deeper with w = Pe / (2 Pw). The levels below 2 span all groups of grams,
so they are held in a small table apart (at most 256 * 256 nodes).
"""

from __future__ import annotations

import math

import numpy as np

DEPTH = 4
#: Ends a text and stands for what precedes it; no UTF-8 text holds this byte.
EDGE = 0xFF
#: Levels that the table of low levels holds.
LOW = 2


def grams_of(raw: bytes) -> np.ndarray:
    """The gram of every byte of a text and of its end, in order."""
    data = np.frombuffer(bytes([EDGE]) * DEPTH + raw + bytes([EDGE]), np.uint8).astype(np.uint64)
    n = len(raw) + 1
    keys = data[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        keys |= data[DEPTH - back:DEPTH - back + n] << np.uint64(8 * (DEPTH + 1 - back))
    return keys


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log(gamma(x)) for x > 0: shifted upwards, then Stirling's series."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    s = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - s * (1 / 360 - s / 1260)) / y - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def weighted(estimate: np.ndarray, children: np.ndarray) -> np.ndarray:
    return math.log(0.5) + np.logaddexp(estimate, children)


class Level:
    """Nodes of one depth: for every bit, counts and log probabilities, and each gram's node."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        # Context of this depth and the byte, as one number; sorted by context, then byte.
        pairs = (grams >> np.uint64(8 * (DEPTH + 1 - depth))) << np.uint64(8) | (grams & np.uint64(0xFF))
        self.pairs, self.of_gram = np.unique(pairs, return_inverse=True)
        own = np.bincount(self.of_gram, weights=counts, minlength=len(self.pairs))
        context, byte = self.pairs >> np.uint64(8), self.pairs & np.uint64(0xFF)
        self.node, self.keys, self.zeros, self.ones, self.estimate, self.weighted = [], [], [], [], [], []
        for bit in range(8):
            prefix = np.uint64(1 << bit) | byte >> np.uint64(8 - bit)
            keys = context << np.uint64(8) | prefix  # monotone, as the pairs are sorted
            first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
            node = np.cumsum(first) - 1
            is_one = (byte >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
            size = int(first.sum())
            self.node.append(node)
            self.keys.append(keys[first])
            self.zeros.append(np.bincount(node, weights=np.where(is_one, 0, own), minlength=size))
            self.ones.append(np.bincount(node, weights=np.where(is_one, own, 0), minlength=size))
            self.estimate.append(log_kt(self.zeros[-1], self.ones[-1]))

    def weigh(self, deeper: Level | None) -> None:
        for bit in range(8):
            if deeper is None:
                self.weighted.append(self.estimate[bit])
                continue
            parents = (deeper.keys[bit] >> np.uint64(16)) << np.uint64(8) | deeper.keys[bit] & np.uint64(0xFF)
            sums = np.bincount(np.searchsorted(self.keys[bit], parents), weights=deeper.weighted[bit],
                               minlength=len(self.keys[bit]))
            self.weighted.append(weighted(self.estimate[bit], sums))


def levels_of(grams: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels ``LOW`` to ``DEPTH`` of grams that share their nearest ``LOW`` context bytes or hold all of them."""
    levels = [Level(grams, counts, d) for d in range(LOW, DEPTH + 1)]
    for i in range(len(levels) - 1, -1, -1):
        levels[i].weigh(levels[i + 1] if i + 1 < len(levels) else None)
    return levels


def low_sums(level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest byte * 256 + bit prefix, zeros, ones, summed log Pw) of the nodes of depth ``LOW``."""
    keys = np.concatenate(level.keys)
    nearest = (keys >> np.uint64(16)) << np.uint64(8) | keys & np.uint64(0xFF)
    places, at = np.unique(nearest, return_inverse=True)
    return places.astype(np.int64), *(np.bincount(at, weights=np.concatenate(x), minlength=len(places))
                                      for x in (level.zeros, level.ones, level.weighted))


class LowLevels:
    """Depths 0 and 1 as tables over (nearest byte, bit prefix)."""

    def __init__(self, places: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray):
        table = np.zeros((3, 256 * 256))
        for row, x in zip(table, (zeros, ones, deeper)):
            np.add.at(row, places, x)
        one = self._level(*table)
        root = self._level(*(x.reshape(256, 256).sum(axis=0) for x in (table[0], table[1], one[3])))
        self.one, self.root = one[:3], root[:3]

    @staticmethod
    def _level(zeros, ones, deeper):
        estimate = log_kt(zeros, ones)
        total = weighted(estimate, deeper)
        return zeros, ones, np.exp(math.log(0.5) + estimate - total), total


def code_lengths(grams: np.ndarray, levels: list[Level], low: LowLevels) -> np.ndarray:
    """log10 of the probability of every gram's byte in its context."""
    byte = (grams & np.uint64(0xFF)).astype(np.int64)
    nearest = (grams >> np.uint64(8 * DEPTH)).astype(np.int64)
    total = np.zeros(len(grams))
    for bit in range(8):
        is_one = (byte >> (7 - bit) & 1).astype(bool)
        prefix = 1 << bit | byte >> (8 - bit)
        p = np.full(len(grams), np.nan)

        def mix(p, zeros, ones, weight):
            seen = zeros + ones
            own = (np.where(is_one, ones, zeros) + 0.5) / (seen + 1.0)
            mixture = np.where(np.isnan(p), own, weight * own + (1 - weight) * p)
            return np.where(seen > 0, mixture, p)

        for level in reversed(levels):
            node = level.node[bit][level.of_gram]
            weight = np.exp(math.log(0.5) + level.estimate[bit] - level.weighted[bit])
            p = mix(p, level.zeros[bit][node], level.ones[bit][node], weight[node])
        place = nearest << 8 | prefix
        p = mix(p, *(x[place] for x in low.one))
        p = mix(p, *(x[prefix] for x in low.root))
        total += np.log10(np.where(np.isnan(p), 0.5, p))
    return total
