"""Context-tree weighting against a plain recursion, and the word model against its formula."""

import math
import zlib
from collections import Counter

import pytest

from boxloom.llm.context_tree import DEPTH, EDGE
from boxloom.llm.lm_score import score_documents

TEXTS = ["abab abab", "the cat sat on the mat", "THE cat\tsat", "", None, "é\n", "abab abba the rat", "xyz",
         "the the the", "a", "mat the sat", "the cat sat on the mat"]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain_code_length(train, text):
    """Frozen context-tree weighting, written as the recursion over nodes."""
    counts = Counter()
    for t in train:
        raw = bytes([EDGE]) * DEPTH + (t or "").encode() + bytes([EDGE])
        for i in range(DEPTH, len(raw)):
            for bit in range(8):
                prefix, one = 1 << bit | raw[i] >> (8 - bit), raw[i] >> (7 - bit) & 1
                for d in range(DEPTH + 1):
                    counts[raw[i - d:i], prefix, one] += 1
    contexts = {(c, p) for c, p, _ in counts}

    def log_estimate(c, p):
        a, b = counts[c, p, 0], counts[c, p, 1]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_weighted(c, p):
        if len(c) == DEPTH:
            return log_estimate(c, p)
        deeper = sum(log_weighted(k, p) for k in {bytes([x]) + c for x in range(256)} if (k, p) in contexts)
        e = log_estimate(c, p)
        return math.log(.5) + max(e, deeper) + math.log1p(math.exp(-abs(e - deeper)))

    total = 0.0
    raw = bytes([EDGE]) * DEPTH + (text or "").encode() + bytes([EDGE])
    for i in range(DEPTH, len(raw)):
        for bit in range(8):
            prefix, one = 1 << bit | raw[i] >> (8 - bit), raw[i] >> (7 - bit) & 1
            p = None
            for d in range(DEPTH, -1, -1):
                c = raw[i - d:i]
                a, b = counts[c, prefix, 0], counts[c, prefix, 1]
                if a + b:
                    own = (counts[c, prefix, one] + .5) / (a + b + 1)
                    if p is None:
                        p = own
                    else:
                        w = math.exp(math.log(.5) + log_estimate(c, prefix) - log_weighted(c, prefix))
                        p = w * own + (1 - w) * p
            total += math.log10(.5 if p is None else p)
    return total


def test_scores_equal_the_plain_recursion(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, "repeated", "y"), (3, "repeated", "y")]
    got = score_documents(spark.createDataFrame(rows, "doc_id bigint, text string, block string")).collect()
    assert len(got) == len(rows)
    train = [t for i, t, _ in rows if not held_out(i)]
    words = Counter()
    for t in train:
        words.update((t or "").encode().lower().split() + ["end"])
    n, v = sum(words.values()), len(words)
    want = {}
    for i, t, _ in rows:
        tokens = (t or "").encode().lower().split() + ["end"]
        base = sum(math.log10((words[w] + .5) / (n + .5 * (v + 1))) for w in tokens)
        want.setdefault((i, len(tokens), sum(words[w] > 0 for w in tokens)), []).append((base, plain_code_length(train, t)))
    for r in got:
        options = want[r["doc_id"], r["n_tokens"], r["n_known"]]
        assert r["train_tokens"] == n and r["held_out"] == held_out(r["doc_id"])
        assert any(r["base_score"] == pytest.approx(b) and r["score"] == pytest.approx(s) for b, s in options)


def test_empty_table_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert score_documents(empty).count() == 0
    only = next(i for i in range(100) if held_out(i))
    row = score_documents(spark.createDataFrame([(only, "ab")], "doc_id bigint, text string")).first()
    assert row["n_known"] == 0 and row["train_tokens"] == 0
    assert row["score"] == pytest.approx(24 * math.log10(.5))
