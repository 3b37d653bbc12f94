import random
from collections import Counter

import numpy as np
import pytest

from boxloom.llm import jaccard_join as J
from boxloom.llm.components import components
from boxloom.llm.queries import QUERIES
from boxloom.llm.shingles import shingle_set
from tests.llm.helpers import edge_docs, no_docs

SF = "/root/testdata/sf0.001"


def plain_sets(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def plain_components(rows):
    """rows: (doc_id, text). Smallest id reachable by links; every pair is compared."""
    sets = [(i, plain_sets(t)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is None or j is None or not a or not b or min(len(a), len(b)) * 100 < 80 * max(len(a), len(b)):
                continue
            common = len(a & b)
            if common and 100 * common >= 80 * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i)) for i, s in sets), key=repr)


def got_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def family(rng, base, edits, size):
    """Copies with a few words changed, so that some pairs link only through others."""
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block,small", [(1024, 32), (4, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, block, small):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "CHUNK", 50)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for length, edits, size in ((120, 5, 40), (60, 2, 20), (30, 1, 15), (300, 14, 12), (6, 1, 8)):
        texts += family(rng, rng.choices(words, k=length), edits, size)
    passage = " ".join(rng.choices(words, k=60))
    texts += [" ".join(rng.choices(words, k=30)) + " " + passage + " " + " ".join(rng.choices(words, k=20)) for _ in range(40)]
    texts += ["a b c", "A b  c", "a b", "same text of five words here"] + ["same text of five words here"] * 5
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got_rows(J.link_documents(docs)) == plain_components(rows)


def test_edge_rows(spark):
    docs = edge_docs(spark, ["ONE", "the quick brown fox jumps over the lazy dog. " * 4])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got_rows(J.link_documents(docs)) == plain_components(rows)
    assert J.link_documents(no_docs(spark)).count() == 0
    kept = [r["doc_id"] for r in J.one_per_group(docs).collect()]
    want = Counter(i for i, _, c in plain_components(rows) if i == c)
    assert sorted(kept, key=repr) == sorted([i for i in want if i is not None] + [None] * want[None], key=repr)


def test_query_equals_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got_rows(QUERIES["op9_jaccard_join"](spark, SF)) == plain_components(rows)


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        x, y = (np.frombuffer(J.parity_bitmap(s), np.uint64) for s in (a, b))
        words = min(len(x), len(y))
        distance = int(np.bitwise_count(J.folded(x, words) ^ J.folded(y, words)).sum())
        assert J.overlap_bound(len(a), len(b), distance) >= len(np.intersect1d(a, b))


def test_shingle_sets_have_the_plain_sizes():
    for text in ("a b c d e f a b c d e f", "A b\x0bc", "", None, "x " * 50, "é è à ç ù û"):
        assert len(shingle_set(text)) == len(plain_sets(text))


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(chain.limit(0)).count() == 0
