import random

import numpy as np

from boxloom.llm.queries import QUERIES
from boxloom.llm.toxicity import (
    CHAIN,
    best_threshold,
    chain_probabilities,
    deal_categories,
    fit,
    learn_targets,
    predict,
    score_toxicity,
    train_chain,
    traits,
    words_of,
)
from tests.llm.helpers import edge_docs, no_docs

SF = "/root/testdata/sf0.01"


def label_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_newton_steps_reach_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (300, 4)).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(int)
    w = fit(x, y)
    slope = np.column_stack([x, np.ones(300)]).T @ (predict(x, w) - y) + np.append(np.full(4, 0.3), 1e-6) * w
    assert np.abs(slope).max() < 1e-2
    assert best_threshold(np.array([.9, .8, .3, .1]), np.array([1, 1, 0, 0])) == 0.55


def test_later_models_see_the_earlier_probabilities():
    rng = random.Random(3)
    words = ["stone", "river", "calm", "hill", "walk", "light"]
    texts = [" ".join(rng.choices(words, k=30)) + (" idiot" if i % 5 == 0 else " worthless" if i % 7 == 0 else "") for i in range(400)]
    toxic = [int(i % 5 == 0 or i % 7 == 0) for i in range(400)]
    names, models, threshold = train_chain(texts, toxic, list(range(400)))
    assert [len(m) for m in models] == [len(names) + 1 + k for k in range(len(CHAIN))]
    p = chain_probabilities(["a calm idiot", "a calm stone", None, ""], names, models)
    assert p[0, 0] > 0.5 and p[0, 2] >= threshold and (p[1:, 2] < threshold).all()
    assert train_chain(["a"], [1], [1]) == ([], [], 1.0)


def marked_texts(marks, seed, n=300):
    """Texts of plain words of which every sixth is toxic by one of two marks, or by both."""
    rng = random.Random(seed)
    words = [f"{a}{b}en" for a in "bdfgkl" for b in ("alt", "ein", "ort")]
    texts, toxic = [], []
    for i in range(n):
        held = [marks[0]] if i % 12 == 0 else [marks[1]] if i % 12 == 6 else []
        held += [marks[0]] if i % 36 == 6 else []
        texts.append(" ".join(rng.choices(words, k=25) + [m + rng.choice(("ig", "lich", "er")) for m in held]))
        toxic.append(int(bool(held)))
    return texts, toxic


def test_every_language_has_its_own_categories():
    one, other = marked_texts(("gromma", "plutza"), 1), marked_texts(("vesk", "idiot"), 2)
    texts, toxic = one[0] + other[0], one[1] + other[1]
    langs = ["aa"] * len(one[0]) + [None] * len(other[0])
    names, y = learn_targets(texts, np.array(toxic), langs)
    for part in (slice(0, 300), slice(300, 600)):
        assert 0 < y[part, 0].sum() < y[part, 2].sum() and 0 < y[part, 1].sum() < y[part, 2].sum()
        assert ((y[part, 0] | y[part, 1]) == y[part, 2]).all()  # every toxic text is in one of them
    assert not (y[np.array(toxic) == 0]).any()
    dealt = deal_categories([traits(words_of(t)) for t in other[0]], np.array(other[1]))
    assert any(t.startswith(b"idio") for t in dealt["insult"]) and any(t.startswith(b"vesk") for t in dealt["contempt"])
    names, models, threshold = train_chain(texts, toxic, list(range(600)), langs)
    p = chain_probabilities(["balten grommaig deinen", "balten plutzaer deinen", "balten deinen"], names, models)
    assert (p[:2, 2] >= threshold).all() and p[2, 2] < threshold
    assert p[:2, :2].max(axis=1).min() > 0.5 and p[2, :2].max() < 0.5


def test_held_out_categories_of_every_language(spark):
    """On texts the chain has not seen, toxic ones of every language are put into a category, others not."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.where("doc_id % 3 > 0"))
    rows = got.join(labels.where("doc_id % 3 = 0").selectExpr("doc_id", "toxic AS truth"), "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        own = [r for r in rows if r["lang"] == lang]
        bad = [max(r["p_insult"], r["p_contempt"]) > 0.5 for r in own if r["truth"]]
        fine = [max(r["p_insult"], r["p_contempt"]) > 0.5 for r in own if not r["truth"]]
        assert sum(bad) >= 0.4 * len(bad) and sum(fine) <= 0.02 * len(fine), lang


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, test = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    got = score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), train)
    rows = got.join(test.select("doc_id", "toxic").withColumnRenamed("toxic", "truth"), "doc_id").select("toxic", "truth").collect()
    hit = sum(r["toxic"] and r["truth"] for r in rows)
    assert hit / sum(r["truth"] for r in rows) > 0.75
    assert hit / sum(r["toxic"] for r in rows) > 0.95


def test_edge_rows(spark):
    docs = edge_docs(spark)
    labels = label_rows(spark, [(8, 1, 1), (3, 1, 0), (3, 1, 0), (None, 1, 1), (4, 0, None)])
    got = score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["p_toxic"] <= 1 for r in got)
    assert {r["toxic"] for r in score_toxicity(docs, label_rows(spark, [])).collect()} == {False}
    assert score_toxicity(no_docs(spark), labels).count() == 0


def test_query_scores_every_document(spark):
    rows = QUERIES["op8_toxicity_chain"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
