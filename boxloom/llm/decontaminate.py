"""Benchmark decontamination: approximate occurrences of test items, by pieces.

Texts and items are compared with A-Z lower-cased and white space runs as one space. An item of
m characters may differ by k = m * ``ERRORS`` edits. It is cut into k + 1 pieces, so any
occurrence holds at least one piece unchanged; one Aho-Corasick automaton finds all pieces in
one pass. Hits of an item that agree on where it would lie are one window. A window must hold
the 5-grams that k edits have to leave, and Myers' bit-parallel distance decides.

Items are taken in blocks of at most ``ITEM_BYTES``, which bounds what tasks are sent; more
items mean more passes.

Defined results: null or empty texts and items, and items without any word, match nothing;
texts of any length are searched whole; occurrences of an item that do not overlap are reported
each, from left to right, with the best distance there (of equal ones the first end, then the
latest start); equal items are reported each;
offsets are code points of the original text, ends exclusive; other columns pass through.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of an item's characters that may be edited.
ERRORS = 0.08
ITEM_BYTES = 8_000_000
GRAM = 5
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOUND = "array<struct<item_id:bigint,start:int,end:int,distance:int>>"


def normal(text: str) -> str:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()).decode("utf-8", "surrogatepass")


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of an item's error budget plus one pieces."""
    count = int(len(item) * ERRORS) + 1
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distances(pattern: str, text: str) -> Iterator[int]:
    """Least edit distance of ``pattern`` to a part of ``text`` that ends at each of its characters.

    Myers' algorithm: a column of the distance matrix as two bit vectors of its differences.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    for c in text:
        match = where.get(c, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        rise = down | full & ~(diagonal | up)
        fall = up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up = fall | full & ~(diagonal | rise)
        down = rise & diagonal
        yield score


def best_end(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of ``pattern`` in ``text`` with at most ``most`` edits."""
    best = min(((score, end) for end, score in enumerate(distances(pattern, text), 1)), default=None)
    return best if best and best[0] <= most else None


def places(pattern: str, text: str, most: int) -> Iterator[tuple[int, int]]:
    """(distance, end) of occurrences that do not overlap, from left to right.

    From the first end within the budget on, an occurrence may still get better for as many
    characters as two budgets; the best of these ends is taken (of equal ones the first), and the
    search goes on behind it.
    """
    at = 0
    while at < len(text):
        best, last = None, None
        for end, score in enumerate(distances(pattern, text[at:]), at + 1):
            if last is not None and end > last:
                break
            if score <= most:
                last = end + 2 * most if last is None else last
                if best is None or score < best[0]:
                    best = score, end
        if best is None:
            return
        yield best
        at = best[1]


class Matcher:
    def __init__(self, items: tuple[tuple[int, str], ...]):
        self.items = [(i, n) for i, text in items if (n := normal(text or ""))]
        self.grams = [{n[a:a + GRAM] for a in range(len(n) - GRAM + 1)} for _, n in self.items]
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for k, (_, n) in enumerate(self.items):
            for offset, piece in pieces(n):
                held.setdefault(piece, []).append((k, offset))
        for piece, uses in held.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if held:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, distance), offsets in the original text."""
        if not text or not self.items:
            return []
        flat = normal(text)
        places: dict[int, list[int]] = {}
        for last, (size, uses) in self.automaton.iter(flat):
            for k, offset in uses:
                places.setdefault(k, []).append(last + 1 - size - offset)
        found = []
        for k, starts in places.items():
            found += self._verify(k, sorted(set(starts)), flat)
        if not found:
            return []
        back = self._original(text, flat)
        out = sorted({(item, back[a][0], back[b - 1][1], d) for item, a, b, d in found}, key=lambda f: (f[1], f[0], f[2]))
        return out

    def _verify(self, k: int, starts: list[int], flat: str) -> Iterator[tuple[int, int, int, int]]:
        item_id, item = self.items[k]
        most = int(len(item) * ERRORS)
        group = [starts[0]]
        for start in [*starts[1:], None]:
            if start is not None and start - group[-1] <= 2 * most:
                group.append(start)
                continue
            at = max(0, group[0] - most)
            window = flat[at:group[-1] + len(item) + most]
            if self._keeps_grams(k, window, most):
                begun = 0
                for distance, end in places(item, window, most):
                    back = window[max(begun, end - len(item) - distance):end][::-1]
                    length = best_end(item[::-1], back, distance)
                    yield item_id, at + end - length[1], at + end, distance
                    begun = end
            group = [start]

    def _keeps_grams(self, k: int, window: str, most: int) -> bool:
        """Every edit spoils at most ``GRAM`` of the item's grams."""
        item = self.items[k][1]
        needed = len(item) - GRAM + 1 - GRAM * most
        if needed <= 0:
            return True
        grams = self.grams[k]
        there = {g for a in range(len(window) - GRAM + 1) if (g := window[a:a + GRAM]) in grams}
        return sum(item[a:a + GRAM] in there for a in range(len(item) - GRAM + 1)) >= needed

    @staticmethod
    def _original(text: str, flat: str) -> list[tuple[int, int]]:
        """(start, end) in the text of every character of its normal form."""
        back: list[tuple[int, int]] = []
        for m in WORD.finditer(text):
            if back:
                back.append((back[-1][1], m.start()))
            back += [(i, i + 1) for i in range(m.start(), m.end())]
        return back


@functools.lru_cache(maxsize=2)
def matcher(items: tuple[tuple[int, str], ...]) -> Matcher:
    return Matcher(items)


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items in blocks of bounded size, one partition of the table at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= ITEM_BYTES:
            yield tuple(block)
            block, size = [], 0
    if block:
        yield tuple(block)


def leaks_of(text: Column, items: tuple[tuple[int, str], ...]) -> Column:
    """Occurrences of the items in a text."""
    def find(texts: pd.Series) -> pd.Series:
        own = matcher(items)
        return pd.Series([own.find(t or "") for t in texts], dtype=object)

    return F.pandas_udf(find, FOUND)(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, distance) of every occurrence."""
    out = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, start int, end int, distance int")
    for items in item_blocks(benchmark):
        found = docs.select("doc_id", F.explode(leaks_of(F.col("text"), items)).alias("f"))
        out = out.union(found.select("doc_id", "f.item_id", "f.start", "f.end", "f.distance"))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Those documents that hold no test item."""
    for items in item_blocks(benchmark):
        docs = docs.where(F.size(leaks_of(F.col("text"), items)) == 0)
    return docs
