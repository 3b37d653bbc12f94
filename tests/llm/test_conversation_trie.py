"""The trie of rebuilt conversations against a dictionary of prefixes."""

import hashlib
import random
import zlib

from boxloom.llm import conversation_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """All nodes of the trie, from rows (conv_id, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, said in built.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, convs in members.items():
        value = (len(convs) - 1) * len(path[-1][1].encode().split()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += value
    return sorted((
        min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids.get(path, [])), leaves[path],
        saved[path], hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(built[c]) == len(path)).encode()).hexdigest())
        for path, convs in members.items())


def found(spark, rows, parts=3):
    return sorted(map(tuple, conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()))


def talk(rng, convs, most, words):
    return [(c, t, rng.choice(["user", "bot"]), rng.choice(words)) for c in convs for t in range(rng.randint(1, most))]


def test_random_conversations(spark):
    rng = random.Random(8)
    rows = talk(rng, range(-45, 90), 6, ["a", "a b", "a b c"])
    assert found(spark, rows) == plain(rows)


def test_a_long_chain_beside_short_ones(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 16)
    monkeypatch.setattr(conversation_trie, "TURN_LIMIT", 50)
    rng = random.Random(4)
    long = [(40, t, "user", f"word {t // 3}") for t in range(150)]
    rows = long + [(47, *r[1:]) for r in long[:90]] + [(48, *r[1:]) for r in long] + talk(rng, range(0, 30), 3, ["x", "y y"])
    assert found(spark, rows) == plain(rows)


def test_nulls_ties_repeats_and_bare_conversations(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "bot", ""), (1, 0, "bot", "a"), (1, 0, "bot", "a"),
            (2, 5, "user", "w " * 20_000), (21, 0, "user", "b"), (20, 0, "user", "b"), (20, 1, None, "c"), (3, 0, "x:y", "z"),
            (4, 0, "x", ":yz"), (23, 3, "user", "only"), (24, 3, "user", "only")]
    assert found(spark, rows) == plain(rows)


def test_many_ends_of_one_node_run_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 8)
    rows = [(c, 0, "user", "same first turn") for c in range(200)]
    assert found(spark, rows, 8) == plain(rows)


def test_extra_columns_and_empty_table(spark):
    rows = talk(random.Random(1), range(25), 4, ["a", "b"])
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA + ", i int, id string, parent string, depth int")
    assert sorted(map(tuple, conversation_trie.prefix_trie(df).collect())) == plain(rows)
    assert conversation_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
