"""The filter audit against documents counted one by one in every order."""

from collections import Counter
from itertools import permutations

import numpy as np

from boxloom.llm import filter_audit
from tests.llm.helpers import edge_docs, no_docs

LABELS = "doc_id bigint, quality int, toxic int"


def fails(text, earlier):
    words = (text or "").encode().split()
    t = text or ""
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": earlier}


def plain(rows, labels):
    """{(part, order, step): all figures} of rows (doc_id, text, lang), each order followed."""
    seen = []
    for doc_id, text, lang in rows:
        earlier = doc_id is not None and any(
            i is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in rows)
        says = [(q, t) for i, q, t in labels if i is not None and i == doc_id]
        seen.append((lang or "", fails(text, earlier), any(q == 1 for q, _ in says), any(t == 1 for _, t in says)))
    out, shapley = {}, Counter()
    for part in {s[0] for s in seen}:
        own = [s for s in seen if s[0] == part]
        for order in permutations("ABCDE"):
            alive = list(own)
            for step, f in enumerate(order, 1):
                gone = [s for s in alive if s[1][f]]
                alive = [s for s in alive if not s[1][f]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive), len(gone), sum(s[1][f] for s in own) - len(gone),
                    sum(s[1][f] and sum(s[1].values()) == 1 for s in own), sum(s[2] for s in gone), sum(s[3] for s in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: r[3:] for r in rows}


def test_popcount_by_carry_save_equals_plain_counts():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 7, 1_000, 4_097):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert filter_audit.positional_popcount(words).tolist() == [int((words >> b & 1).sum()) for b in range(32)]


def test_every_order_of_small_documents(spark):
    long = " ".join(f"w{i}" for i in range(120))
    texts = [long, long, "$ " + long, long.upper(), "a a a a " * 40, "", None, "Short # TEXT", long, "a a a a " * 40, long + " é漢"]
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)] + [(None, long, "en"), (3, long, "en"), (0, long, "de")]
    labels = [(0, 1, 0), (1, 1, None), (1, 0, 1), (2, None, 1), (4, 1, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = found(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)))
    assert got == plain(rows, labels)


def test_edge_rows_extra_columns_and_empty_tables(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    none = spark.createDataFrame([], LABELS)
    assert found(filter_audit.audit(docs.withColumn("part", docs.key).withColumn("failed", docs.n), none)) == plain(rows, [])
    assert filter_audit.audit(no_docs(spark), none).count() == 0


def test_many_parts_leave_a_task_in_portions(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 2)
    rows = [(i, f"text {i % 7}", f"l{i % 9}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(2)
    assert found(filter_audit.audit(docs, spark.createDataFrame([], LABELS))) == plain(rows, [])
