"""Byte-level BPE: encoding with vectorised pre-tokenisation, token offsets, decoding.

Pre-tokenisation works on arrays of code points. Each code point gets a symbol: its class
(letter, number, white space, other) with what the next characters say about it (last white
space of a run, start of a contraction). A finite automaton over these symbols marks where
tokens start. Its transition functions compose associatively, so the text is cut in blocks,
each block's function for every start state is composed, the block functions are scanned, and
each block then runs from its known state; all steps are array operations.

The slices between starts are looked up in a cache of merged pieces. New pieces merge their
pair of lowest rank until none is left: short ones side by side as rows of a matrix, long ones
with a heap over a linked list.

Defined results: a null or empty text has no tokens; texts of any length are encoded whole;
strings of special tokens are ordinary text; repeated rows are encoded each. Token ids are
little-endian unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.arrow import with_binary

RANKS = "byte_bpe_50k.tiktoken"
#: Code points handled at once, and pieces kept in a worker's cache.
CHARS, PIECES = 1_000_000, 150_000
#: Byte lengths up to which pieces are merged side by side, and the mark of a pair that does not merge.
WIDTHS, NOT = (4, 8, 12, 16, 24, 32), 1 << 40

# Symbols; white space is split by what follows it.
SPACE_RUN, GLUE, LAST_SPACE, LETTER, NUMBER, OTHER, SHORT, LONG, CUT = range(9)
# States: what the current token is.
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_GLUE, ONE_LEFT, TWO_LEFT = range(8)
#: White space of the pattern (fixed values of the standard): code point ranges.
SPACES = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
          (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a token starts here", both indexed by symbol * 8 + state."""
    follow = np.zeros((9, 8), np.uint8)
    starts = np.ones((9, 8), bool)
    for symbol, state in ((SPACE_RUN, IN_SPACES), (GLUE, AFTER_GLUE), (LAST_SPACE, NONE), (LETTER, IN_LETTERS),
                          (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (SHORT, ONE_LEFT), (LONG, TWO_LEFT), (CUT, NONE)):
        follow[symbol] = state
    goes_on = [(SPACE_RUN, IN_SPACES, IN_SPACES), (LETTER, IN_LETTERS, IN_LETTERS), (LETTER, ONE_LEFT, NONE),
               (LETTER, TWO_LEFT, ONE_LEFT), (NUMBER, IN_NUMBERS, IN_NUMBERS)]
    goes_on += [(s, AFTER_GLUE, t) for s, t in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS))]
    goes_on += [(s, state, IN_OTHERS) for s in (OTHER, SHORT, LONG) for state in (IN_OTHERS, AFTER_GLUE)]
    for symbol, state, then in goes_on:
        follow[symbol, state], starts[symbol, state] = then, False
    return follow.reshape(-1), starts.reshape(-1)


FOLLOW, STARTS = _automaton()


@functools.cache
def class_table() -> np.ndarray:
    """Symbol of every code point, without regard to its neighbours; the last entry is the cut."""
    major = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
                        np.uint8, sys.maxunicode + 1)
    for low, high in SPACES:
        table[low:high + 1] = SPACE_RUN
    return np.append(table, np.uint8(CUT))


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbols of code points in which every text ends with a cut."""
    plain = class_table()[codes]
    out = plain.copy()
    last = np.flatnonzero((plain[:-1] == SPACE_RUN) & (plain[1:] != SPACE_RUN) & (plain[1:] != CUT))
    out[last] = np.where(codes[last] == 32, GLUE, LAST_SPACE)
    at = np.flatnonzero(codes == ord("'"))
    for i in at.tolist():  # a cut follows every text, so i + 1 exists
        one, two = codes[i + 1], codes[i + 2] if i + 2 < len(codes) else 0
        if one in (115, 116, 109, 100):  # s t m d
            out[i] = SHORT
        elif (one, two) in ((114, 101), (118, 101), (108, 108)):  # re ve ll
            out[i] = LONG
    return out


def token_starts(marks: np.ndarray, width: int = 128) -> np.ndarray:
    """Whether a token starts at each symbol, by a scan over composed transition functions."""
    rows = -(-len(marks) // width)
    grid = np.full(rows * width, CUT, np.uint8)
    grid[:len(marks)] = marks
    grid = np.ascontiguousarray((grid * 8).reshape(rows, width).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        whole = FOLLOW[column[:, None] + whole]
    step = 1
    while step < rows:  # inclusive scan: function composition is associative
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.full(rows, NONE, np.uint8)
    state[1:] = whole[:-1, NONE]
    out = np.empty((width, rows), bool)
    for j, column in enumerate(grid):
        at = column + state
        out[j] = STARTS[at]
        state = FOLLOW[at]
    return out.T.reshape(-1)[:len(marks)]


def cut_pieces(texts: list[str]) -> list[list[int]]:
    """Code point offsets of the pieces of each text, its end included."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    codes = np.full(ends[-1] if len(ends) else 0, sys.maxunicode + 1, np.uint32)
    for text, end, n in zip(texts, ends.tolist(), lengths.tolist()):
        codes[end - 1 - n:end - 1] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    places = np.flatnonzero(token_starts(symbols(codes)))
    cuts = np.searchsorted(places, ends - 1, side="right")
    firsts = np.concatenate(([0], cuts[:-1])) if len(cuts) else cuts
    return [(places[a:b] - (end - 1 - n)).tolist() for a, b, end, n in zip(firsts, cuts, ends, lengths)]


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def bytes_of(path: str) -> list[bytes]:
    ranks = ranks_of(path)
    table = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        table[i] = piece
    return table


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of a piece: the adjacent pair of lowest rank, leftmost first, merged until none is left."""
    if piece in ranks:
        return [piece]
    parts: list[bytes | None] = [piece[i:i + 1] for i in range(len(piece))]
    # A heap of pairs over a linked list: n log n for long pieces.
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1)
            if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j], after[i] = joined, None, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [p for p in parts if p is not None]


@functools.cache
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pair keys (left id * 2^20 + right id), the id each pair merges to, byte ids, token sizes."""
    ranks = ranks_of(path)
    pairs = sorted((a << 20 | b, i) for piece, i in ranks.items() for k in range(1, len(piece))
                   if (a := ranks.get(piece[:k])) is not None and (b := ranks.get(piece[k:])) is not None)
    keys, merged = np.array(pairs, np.int64).T
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    return keys.copy(), merged.copy(), single, np.array(list(map(len, bytes_of(path))), np.int64)


def merged_ids(left: np.ndarray, right: np.ndarray, path: str) -> np.ndarray:
    """Id of each merged pair, ``NOT`` where the pair does not merge or a side is missing (-1)."""
    keys, merged, *_ = pair_table(path)
    wanted = left << 20 | right
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted) & (left >= 0) & (right >= 0), merged[at], NOT)


def merge_rows(ids: np.ndarray, path: str) -> np.ndarray:
    """Merges all rows of a matrix of byte ids (padded with -1) at once, one pair a row and round."""
    done = np.full_like(ids, -1)
    rows = np.arange(len(ids))
    pairs = merged_ids(ids[:, :-1], ids[:, 1:], path)
    while len(rows):
        at = np.argmin(pairs, axis=1)
        best = pairs[np.arange(len(rows)), at]
        going = best < NOT
        done[rows[~going], :ids.shape[1]] = ids[~going]
        ids, pairs, at, best, rows = ids[going], pairs[going], at[going], best[going], rows[going]
        if not len(rows):
            break
        width = ids.shape[1]
        n, column = np.arange(len(rows)), np.arange(width)
        ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1),
                                 column + (column > at[:, None]), axis=1)
        ids[n, at] = best
        column = column[:-1]
        pairs = np.take_along_axis(np.pad(pairs, ((0, 0), (0, 1)), constant_values=NOT),
                                   column + (column > at[:, None]), axis=1)
        right = np.where(at + 1 < width, ids[n, np.minimum(at + 1, width - 1)], -1)
        pairs[n, np.minimum(at, width - 2)] = np.where(
            at < width - 1, merged_ids(best, right, path), pairs[n, np.minimum(at, width - 2)])
        inner = np.flatnonzero(at > 0)
        pairs[inner, at[inner] - 1] = merged_ids(ids[inner, at[inner] - 1], best[inner], path)
    return done


class Pieces(dict):
    """piece -> its ids as bytes; with ``spans``, -> (ids, code point starts of its tokens, their ends, their number)."""

    def __init__(self, path: str, spans: bool):
        super().__init__()
        self.path, self.spans = path, spans

    def learn(self, pieces: list[str]) -> None:
        """Merges new pieces: short ones together as rows of a matrix, long ones each."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        done = 0
        for width in WIDTHS:
            part = []
            while done < len(order) and len(raw[order[done]]) <= width:
                part.append(order[done])
                done += 1
            if part:
                self._learn_rows([pieces[i] for i in part], [raw[i] for i in part], width)
        ranks = ranks_of(self.path)
        for i in order[done:]:
            ids = np.array([ranks[t] for t in merge(raw[i], ranks)], np.int64)
            self._keep([pieces[i]], [raw[i]], ids, np.array([len(ids)]))

    def _learn_rows(self, pieces: list[str], raw: list[bytes], width: int) -> None:
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        filled = np.arange(width) < sizes[:, None]
        matrix = np.full((len(raw), width), -1, np.int64)
        matrix[filled] = pair_table(self.path)[2][np.frombuffer(b"".join(raw), np.uint8)]
        ids = merge_rows(matrix, self.path)
        self._keep(pieces, raw, ids[ids >= 0], (ids >= 0).sum(axis=1))

    def _keep(self, pieces: list[str], raw: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        sizes = pair_table(self.path)[3][ids]
        stops = np.cumsum(sizes)
        # Code points begun up to each byte; a token that starts inside a character counts that character.
        begun = np.cumsum((np.frombuffer(b"".join(raw), np.uint8) & 0xC0) != 0x80)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        base = np.repeat(np.cumsum(lengths) - lengths, counts)
        out = [x.astype("<i4").tobytes() for x in (ids, begun[stops - sizes] - 1 - base, begun[stops - 1] - base)]
        ends = (4 * np.cumsum(counts)).tolist()
        for piece, at, to in zip(pieces, [0, *ends], ends):
            self[piece] = (out[0][at:to], out[1][at:to], out[2][at:to], (to - at) // 4) if self.spans else out[0][at:to]


@functools.cache
def pieces_of(path: str, spans: bool) -> Pieces:
    """The cache of this worker process."""
    return Pieces(path, spans)


def batched(texts: Iterable[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def looked_up(texts: Iterable[str], path: str, spans: bool) -> Iterator[tuple[list[int], list]]:
    """Piece offsets and cache entries of each text."""
    cache = pieces_of(path, spans)
    for held in batched(texts):
        cuts = cut_pieces(held)
        found, new = [], set()
        for text, c in zip(held, cuts):
            own = [text[a:b] for a, b in zip(c, c[1:])]
            entries = list(map(cache.get, own))
            if None in entries:
                new.update([p for p, e in zip(own, entries) if e is None])
                found.append((own, entries))
            else:
                found.append((None, entries))
        if len(cache) + len(new) > PIECES:
            cache.clear()
        cache.learn(list(new))
        for c, (own, entries) in zip(cuts, found):
            if own is not None:
                entries = [cache[p] if e is None else e for p, e in zip(own, entries)]
            yield c, entries


def encoded(texts: Iterable[str], path: str) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(ids, token starts, token ends) of each text; starts and ends in code points."""
    for cuts, found in looked_up(texts, path, True):
        counts = np.fromiter((x[3] for x in found), np.int64, len(found))
        base = np.repeat(np.array(cuts[:-1], np.int64), counts)
        yield (b"".join([x[0] for x in found]),
               base + np.frombuffer(b"".join([x[1] for x in found]), "<i4"),
               base + np.frombuffer(b"".join([x[2] for x in found]), "<i4"))


def encoded_ids(texts: Iterable[str], path: str) -> Iterator[bytes]:
    """Token ids of each text."""
    for _, found in looked_up(texts, path, False):
        yield b"".join(found)


def encode(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``token_ids`` (binary) and ``n_tokens`` of the text."""
    def ids(texts: list[str | None]) -> list[bytes]:
        return list(encoded_ids([t or "" for t in texts], path))

    return with_binary(docs, "text", "token_ids", ids, keep).withColumn(
        "n_tokens", (F.octet_length("token_ids") / 4).cast("bigint"))


def decode(tokens: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``tokens`` with ``decoded``, the bytes of ``token_ids``; null for null."""
    def raw(column: list[bytes | None]) -> list[bytes | None]:
        table = bytes_of(path)
        return [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in column]

    return with_binary(tokens, "token_ids", "decoded", raw, keep)
