import re

import numpy as np
import pytest

from boxloom.llm.quality_rules import STEP, best_cut, guarded_cut, keep_good, score_quality
from tests.llm.helpers import edge_docs, no_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = {}
    for r in runs:
        times[r] = times.get(r, 0) + 1
    covered = {i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = ["a b c a b c d e\na b\na b\n\nx", "# * $ | a\x0bb", "one two three one two three one two", "  a b"]


def label_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_counts_equal_plain_ones(spark):
    docs = edge_docs(spark, TEXTS)
    got = score_quality(docs, label_rows(spark, [(8, 1, 0), (None, 1, 0), (3, None, 0)])).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        want = plain_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_score_is_the_mean_log_ratio(spark):
    from pyspark.sql import functions as F

    from boxloom.llm.quality_rules import BUCKETS, SMOOTHING, buckets, words
    docs = spark.createDataFrame([(1, "a b c"), (2, "x y"), (3, "a b z z")], "doc_id bigint, text string")
    grams = {r["doc_id"]: r["b"] for r in docs.select("doc_id", buckets(words(F.col("text"))).alias("b")).collect()}
    assert [len(grams[i]) for i in (1, 2, 3)] == [5, 3, 7]
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, own in grams.items():
        np.add.at(raw, own, 1)
        if i == 1:
            np.add.at(target, own, 1)
    ratio = np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)) - np.log(
        (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS))
    for r in score_quality(docs, label_rows(spark, [(1, 1, 0), (2, 0, 0)])).collect():
        assert r["score"] == pytest.approx(ratio[grams[r["doc_id"]]].mean())


def test_junk_goes_and_clean_stays(spark):
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice(["river", "stone", "and", "the", "of", "light", "walks", "over", "hill", "calm"], 120))
             for _ in range(40)]
    junk = [" ".join(f"{w}{s}" for w, s in zip(rng.choice(list("abcdefgh"), 120), rng.choice(["###", "$$$", "&&&"], 120)))
            for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id bigint, text string")
    labels = label_rows(spark, [(i, 1, 0) for i in range(20)])
    got = {r["doc_id"]: r for r in score_quality(docs, labels).collect()}
    assert all(not got[i]["kept"] for i in range(40, 48))
    assert all(got[i]["kept"] for i in range(40) if not got[i]["base_failed"])
    assert {r["doc_id"] for r in keep_good(docs, labels).collect()} == {i for i, r in got.items() if r["kept"]}


def test_no_rows_and_no_labels(spark):
    assert score_quality(no_docs(spark), label_rows(spark, [])).count() == 0
    assert {r["score"] for r in score_quality(edge_docs(spark), label_rows(spark, [])).collect()} == {0.0}


def test_labelled_bad_goes_and_good_stays(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = score_quality(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where(
        "NOT base_failed AND quality IS NOT NULL").collect()
    assert sum(r["quality"] == 0 for r in rows) > 20
    assert not [r["doc_id"] for r in rows if r["quality"] == 0 and r["kept"]]
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) >= 0.98 * len(good)


def test_short_trusted_texts_do_not_move_the_cut(spark):
    rng = np.random.default_rng(2)
    names = ["river", "stone", "and", "the", "of", "light", "walks", "over", "hill", "calm", "bird", "road"]
    texts = [" ".join(rng.choice(names, 80)) for _ in range(60)]
    odd = [f"{a}#1 {b}#2" for a in "qwxyz" for b in "qwxyz"]  # trusted, but far too short
    junk = [" ".join(f"{w}{s}" if k % 3 == 0 else w for k, (w, s) in enumerate(
        zip(rng.choice(names, 80), rng.choice(["###", "&&&"], 80)))) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts + odd + junk)), "doc_id bigint, text string")
    good = [(i, 1, 0) for i in range(40)]
    for more in ([], [(60 + i, 1, 0) for i in range(len(odd))]):
        got = {r["doc_id"]: r for r in score_quality(docs, label_rows(spark, good + more)).collect()}
        assert not any(got[i]["kept"] for i in range(85, 90))
        assert sum(got[i]["kept"] for i in range(60)) >= 0.9 * sum(not got[i]["base_failed"] for i in range(60))


def test_cut_parts_the_labels():
    assert best_cut({}, {0.0: 30}) == float("-inf")
    assert best_cut({1.0: 50, 0.5: 1}, {-1.0: 9, 0.0: 9}) == 0.25
    assert best_cut({1.0: 50, -2.0: 1}, {-1.0: 9, 0.0: 9}) == 0.5
    assert best_cut({1.0: 50}, {2.0: 9}) == 1.0  # too few bad ones
    assert best_cut({2.0: 1, 0.0: 1}, {}) == -2.0


def test_every_trusted_document_counts(spark, monkeypatch):
    from boxloom.llm import jaccard_join, quality_rules

    rows = spark.range(100_500).select("id")
    assert quality_rules.trusted_ids(rows.selectExpr("id AS doc_id", "1 AS quality")).count() == 100_500
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} end") for i in range(40)], "doc_id bigint, text string")
    trusted = quality_rules.trusted_ids(label_rows(spark, [(i, 1, 0) for i in range(0, 40, 2)]))
    want = quality_rules.log_ratios(docs, trusted)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 5)  # more ids than may be broadcast: a shuffle join
    assert np.array_equal(quality_rules.log_ratios(docs, trusted), want)


def test_one_rule_for_any_number_of_bad_labels():
    good = {1.0: 95, 0.9: 4, 0.0: 1}
    alone = best_cut(good, {})
    assert 0.0 < alone < 0.9 and guarded_cut({}, {0.0: 3}) == float("-inf")
    middle = (alone - STEP + 0.9) / 2
    assert guarded_cut(good, {}) == pytest.approx(middle)
    assert guarded_cut({1.0: 50}, {}) < 1.0  # equal scores all pass
    # far bad ones: the added one counts 1 of n + 1 against 1 good document of 100
    for n in range(150):
        cut = guarded_cut(good, {-1.0: n} if n else {})
        assert cut == pytest.approx(middle if n < 99 else -0.5)
    # near bad ones decide at once, the added one goes with them
    assert all(guarded_cut(good, {0.8: n}) == pytest.approx(0.85) for n in (1, 9, 10, 100))


def test_query_keeps_what_a_plain_version_keeps(spark):
    """The verdict of the registered query, recomputed outside Spark from its hashed n-grams."""
    from pyspark.sql import functions as F

    from boxloom.llm.quality_rules import BUCKETS, FOLDS, SMOOTHING, buckets, fold, words
    from boxloom.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    quality = {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality IN (0, 1)").collect():
        quality[r["doc_id"]] = max(r["quality"], quality.get(r["doc_id"], 0))
    rows = docs.select("doc_id", "text", buckets(words(F.col("text"))).alias("b"), fold(F.col("doc_id")).alias("f")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros((FOLDS, BUCKETS))
    for r in rows:
        np.add.at(raw, r["b"], 1)
        if quality.get(r["doc_id"]) == 1:
            np.add.at(target[r["f"]], r["b"], 1)
    share = lambda n: (n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS)
    ratio = lambda n: np.log(share(n) / share(raw)) if n.sum() else np.zeros(BUCKETS)
    whole, counts = target.sum(axis=0), {0: {}, 1: {}}
    fails = {id(r): (c := plain_counts(r["text"]))[0] < 50 or 100 * c[4] > 50 * c[0] for r in rows}
    for r in rows:
        label = quality.get(r["doc_id"])
        if label is not None and not fails[id(r)]:
            s = ratio(whole - target[r["f"]] if label else whole)[r["b"]].mean()
            step = int(np.floor(s / STEP)) * STEP
            counts[label][step] = counts[label].get(step, 0) + 1
    cut, final = guarded_cut(counts[1], counts[0]), ratio(whole)
    scores = {r["doc_id"]: (fails[id(r)], final[r["b"]].mean() if r["b"] else 0.0) for r in rows}
    got = QUERIES["op10_quality_rules"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        failed, score = scores[r["doc_id"]]
        assert r["score"] == pytest.approx(score) and r["base_failed"] == failed
        if abs(score - cut) > 2 * STEP:
            assert r["kept"] == (not failed and score >= cut)
