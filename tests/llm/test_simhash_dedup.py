"""Fingerprints and their components against plain versions."""

import numpy as np
import xxhash

from boxloom.llm import simhash_dedup
from tests.llm.helpers import edge_docs, no_docs


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest reachable position of each fingerprint, every pair compared."""
    prints = np.array(prints, np.uint64)
    label = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    while True:
        low = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (low == label).all():
            return label.tolist()
        label = low


def signed(prints):
    return [int(p) for p in np.array(prints, np.uint64).view(np.int64)]


def test_query_rows_equal_the_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = edge_docs(spark, ["one two three four", "One two THREE four", "x y", " X  y "]).withColumn("doc_id", simhash_dedup.F.col("doc_id") + 5_000)
    every = docs.select("doc_id", "text").union(more.select("doc_id", "text"))
    rows = sorted(((r.doc_id, r.text) for r in every.collect()), key=lambda r: (r[0] is None, r[0]))
    prints = [plain_fingerprint(t) for _, t in rows]
    labels = plain_components(prints)
    expected = sorted(((i, f"{p:016x}", rows[label][0]) for (i, _), p, label in zip(rows, prints, labels)), key=str)
    assert sorted(map(tuple, simhash_dedup.link_documents(every).collect()), key=str) == expected


def near_prints(rng, centres, copies, flips):
    out = []
    for c in rng.integers(0, 1 << 64, centres, dtype=np.uint64):
        for _ in range(copies):
            p = int(c)
            for b in rng.choice(64, rng.integers(0, flips + 1), replace=False):
                p ^= 1 << int(b)
            out.append(p)
    return sorted(set(out), key=lambda p: int(np.array(p, np.uint64).view(np.int64)))


def links_to_labels(spark, prints):
    df = spark.createDataFrame([(p,) for p in signed(prints)], "fp bigint").repartition(4)
    links = [(r.a, r.b) for r in simhash_dedup.near_links(df).collect()]
    at = {p: i for i, p in enumerate(signed(prints))}
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
        x, y = sorted((root(at[a]), root(at[b])))
        label[y] = x
    return [root(i) for i in range(len(prints))]


def test_links_connect_all_near_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(11)
    prints = near_prints(rng, 40, 30, 4)
    expected = plain_components(prints)
    assert links_to_labels(spark, prints) == expected
    monkeypatch.setattr(simhash_dedup, "PAIR_LIMIT", 1)  # every key goes by the other half
    assert links_to_labels(spark, prints) == expected


def test_a_crowded_half_makes_no_pairs(spark):
    rng = np.random.default_rng(3)
    lower = rng.integers(0, 1 << 32, 3_000, dtype=np.uint64)
    prints = {int(x) for x in lower} | {int(x) ^ 1 << int(b) for x, b in zip(lower[:500], rng.integers(0, 64, 500))}
    prints = sorted(prints, key=lambda p: int(np.array(p, np.uint64).view(np.int64)))
    assert links_to_labels(spark, prints) == plain_components(prints)


def test_long_texts_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5_000)) + " É ẞ"
    monkeypatch.setattr(simhash_dedup, "CHUNK", 64)
    assert simhash_dedup.fingerprint(text.encode()) & (1 << 64) - 1 == plain_fingerprint(text)


def test_rows_without_id_and_empty_tables(spark):
    rows = [(None, "a b c d"), (None, "A b c d"), (7, "a b c d"), (7, "q r s t u"), (9, None), (3, " ")]
    got = simhash_dedup.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got.collect()}
    assert by == {(i, f"{plain_fingerprint(t):016x}"): (3 if i in (9, 3) else 7) for i, t in rows}
    lone = simhash_dedup.link_documents(spark.createDataFrame([(None, "z z z z")], "doc_id bigint, text string")).first()
    assert lone.component_id is None
    assert simhash_dedup.link_documents(no_docs(spark)).count() == 0
