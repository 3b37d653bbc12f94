"""Grammar inference for credential formats: state merging over labelled strings.

A prefix tree counts how often each character class follows each prefix of the labelled
strings. States are merged in breadth-first order when their stop and transition frequencies,
and those of all their successors, differ by less than a Hoeffding bound; merged states form a
probabilistic automaton. Strings are scored by the automaton's likelihood against plain
alternatives (random symbols, a number, a lower-case word).
"""

from __future__ import annotations

import math
from collections import deque

#: Character classes: name, members. Symbols are classes of their own.
CLASSES = (
    ("digit", "0123456789"), ("low_hex", "abcdef"), ("low", "ghijklmnopqrstuvwxyz"),
    ("up_hex", "ABCDEF"), ("up", "GHIJKLMNOPQRSTUVWXYZ"),
    *((c, c) for c in "+/_.=-"),
)
CLASS_OF = {c: i for i, (_, members) in enumerate(CLASSES) for c in members}
SIZE_OF = [len(members) for _, members in CLASSES]
SYMBOLS = sum(SIZE_OF)
#: One minus the confidence of the merge test.
ALPHA = 0.05
#: Probability kept for classes a state has never seen.
UNSEEN = 1e-3


class _Node:
    __slots__ = ("ends", "visits", "moves", "counts")

    def __init__(self) -> None:
        self.ends, self.visits = 0, 0
        self.moves: dict[int, _Node] = {}
        self.counts: dict[int, int] = {}


def prefix_tree(strings: list[str]) -> _Node:
    root = _Node()
    for s in strings:
        node = root
        for c in s:
            k = CLASS_OF[c]
            node.visits += 1
            node.counts[k] = node.counts.get(k, 0) + 1
            node = node.moves.setdefault(k, _Node())
        node.visits += 1
        node.ends += 1
    return root


def _differ(x: int, n: int, y: int, m: int, alpha: float) -> bool:
    if not n or not m:
        return False
    return abs(x / n - y / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def compatible(a: _Node, b: _Node, alpha: float = ALPHA) -> bool:
    """Same stop and transition frequencies, here and along all common continuations."""
    pairs, seen = [(a, b)], set()
    while pairs:
        p, q = pairs.pop()
        if (id(p), id(q)) in seen:
            continue
        seen.add((id(p), id(q)))
        if _differ(p.ends, p.visits, q.ends, q.visits, alpha):
            return False
        for k in p.counts.keys() | q.counts.keys():
            if _differ(p.counts.get(k, 0), p.visits, q.counts.get(k, 0), q.visits, alpha):
                return False
        pairs += [(p.moves[k], q.moves[k]) for k in p.moves.keys() & q.moves.keys()]
    return True


def _fold(into: _Node, tree: _Node) -> None:
    """Adds the counts of a tree, state by state, to those of an automaton."""
    todo = [(into, tree)]
    while todo:
        p, q = todo.pop()
        p.ends += q.ends
        p.visits += q.visits
        for k, n in q.counts.items():
            p.counts[k] = p.counts.get(k, 0) + n
            if k in p.moves:
                todo.append((p.moves[k], q.moves[k]))
            else:
                p.moves[k] = q.moves[k]


def infer(strings: list[str], alpha: float = ALPHA) -> list[tuple[float, dict[int, tuple[float, int]]]]:
    """Automaton as a list of states: stop probability, and per class (probability, next state)."""
    if not strings:
        return []
    root = prefix_tree(sorted(strings))
    settled, blue = [root], deque((root, k) for k in sorted(root.moves))
    known = {id(root)}
    while blue:
        parent, k = blue.popleft()
        node = parent.moves[k]
        if id(node) in known:
            continue
        for state in settled:
            if compatible(state, node, alpha):
                parent.moves[k] = state
                before = {id(s): set(s.moves) for s in settled}
                _fold(state, node)
                blue.extend((s, c) for s in settled for c in sorted(set(s.moves) - before[id(s)]))
                break
        else:
            settled.append(node)
            known.add(id(node))
            blue.extend((node, c) for c in sorted(node.moves))
    place = {id(s): i for i, s in enumerate(settled)}
    return [(s.ends / s.visits, {k: (n / s.visits, place[id(s.moves[k])]) for k, n in s.counts.items()})
            for s in settled]


def log_likelihood(automaton, text: str) -> float:
    """Natural log of the probability that the automaton writes exactly this string."""
    state, total = 0, 0.0
    for c in text:
        k = CLASS_OF[c]
        stop, moves = automaton[state]
        p, state = moves.get(k, (0.0, 0))
        total += math.log((1 - UNSEEN) * p / SIZE_OF[k] + UNSEEN / SYMBOLS)
    return total + math.log((1 - UNSEEN) * automaton[state][0] + UNSEEN / SYMBOLS)


def plain_likelihood(text: str) -> float:
    """The best of the plain alternatives: random symbols, a number, a lower-case word."""
    options = [-(len(text) + 1) * math.log(SYMBOLS + 1)]
    if text.isdigit():
        options.append(-(len(text) + 1) * math.log(11))
    if text.isalpha() and text.islower():
        options.append(-(len(text) + 1) * math.log(27))
    return max(options)


def format_score(automata, text: str) -> float:
    """Best log-likelihood ratio per character over all formats; minus infinity without any."""
    best = max((log_likelihood(a, text) for a in automata if a), default=-math.inf)
    return (best - plain_likelihood(text)) / (len(text) + 1)
