"""Toxicity by a classifier chain: linear models in sequence, each fed the earlier probabilities.

Categories, in chain order: insult, contempt, toxic. Labels name toxic documents only, so the
first two are learned in each language apart: the traits (words and word beginnings; languages mark
toxic words by either) that tell toxic documents from others there are dealt to two categories. A
trait that belongs to a word of ``SEEDS`` goes where that word does, any other to the category that
covers fewer toxic documents so far, the strongest trait first. So the two are two kinds of toxic
wording in every language, and what their names say where a seed is told. A category's model sees
the presence of up to ``FEATURES`` traits of each language and the probabilities of the categories
before it.
It is trained with out-of-fold probabilities of those, so it learns from probabilities of the
quality it will get on unseen text; the models that score are then fitted on all training rows.

At most ``TRAIN_ROWS`` labelled documents, chosen by hash, train the models (the stated bound of
the sample); every document is scored whole.

Defined results: a null or empty text has no words and gets the models' intercepts; label rows
without id or without a label are ignored, of contradicting labels toxic wins; without labels
of both kinds every probability is 0; texts without language are one language more, as are all
where there is no column ``lang``; repeated rows are scored each; an empty table gives no
rows. Columns beyond those named are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHAIN = ("insult", "contempt", "toxic")
#: Words whose category is known.
SEEDS = {
    "insult": {b"idiot", b"moron", b"clown", b"stupid", b"fool", b"loser", b"dumb", b"imbecile"},
    "contempt": {b"worthless", b"pathetic", b"disgusting", b"trash", b"garbage", b"vile", b"filth", b"scum"},
}
TRAIN_ROWS, FOLDS = 8_000, 5
#: Traits of a language that models see; past these, traits hardly tell more than chance.
FEATURES = 60
#: Traits of a language that define categories, and the standard score they need.
FAMILIES, LEAST_SCORE = 16, 6.0
#: Lengths of word beginnings in bytes.
BEGINNINGS = range(4, 9)
#: A word is a feature only if so many training documents hold it.
LEAST_DOCS = 3
#: A trait must be so many times as frequent with a label as overall.
LEAST_LIFT = 3.0
PENALTY = 0.3
#: Everything in ASCII but letters and digits ends a word.
BREAKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").lower().translate(BREAKS).split())


def traits(words: set[bytes]) -> set[bytes]:
    """Words (ended by a blank) and the beginnings of longer ones."""
    found = {w + b" " for w in words}
    for n in BEGINNINGS:
        found.update([w[:n] for w in words if len(w) >= n])
    return found


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with an L2 penalty, intercept last and free; Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    weights, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], PENALTY)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + penalty * weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        weights -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-4:
            break
    return weights


def predict(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def telling_traits(bags: list[set[bytes]], labels: np.ndarray) -> list[tuple[bytes, float]]:
    """Traits that tell most for some label, by their standard score; of those that tell the same one."""
    held = [Counter() for _ in range(labels.shape[1] + 1)]
    for bag, row in zip(bags, labels):
        held[-1].update(bag)
        for k in np.flatnonzero(row):
            held[k].update(bag)
    names = sorted(w for w, n in held[-1].items() if n >= LEAST_DOCS)
    if not names:
        return []
    table = np.array([[h[w] for h in held] for w in names], float)
    rows, positive = len(bags), labels.sum(axis=0)
    expected = table[:, -1:] * positive / rows
    spread = np.sqrt(np.maximum(expected * (1 - positive / rows), 1e-9))
    telling = table[:, :-1] >= LEAST_LIFT * expected
    strength = np.where(telling, (table[:, :-1] - expected) / spread, 0.0).max(axis=1)
    chosen, seen = [], set()
    for i in np.argsort(-strength, kind="stable").tolist():
        if not strength[i]:
            break
        same = names[i][:BEGINNINGS[0]], *table[i].tolist()  # beginnings of one word tell the same
        if same not in seen:
            seen.add(same)
            chosen.append((names[i], float(strength[i])))
    return chosen


def deal_categories(bags: list[set[bytes]], toxic: np.ndarray) -> dict[str, set[bytes]]:
    """Traits of one language that put a toxic document into a category."""
    known = {w + b" ": c for c, words in SEEDS.items() for w in words}
    dealt: dict[str, set[bytes]] = {c: set() for c in SEEDS}
    covered: dict[str, set[int]] = {c: set() for c in SEEDS}
    marked = np.flatnonzero(toxic).tolist()
    families: list[bytes] = []
    for trait, score in telling_traits(bags, toxic[:, None]):
        if score < LEAST_SCORE or len(families) == FAMILIES:
            break
        if any(trait.startswith(f) or f.startswith(trait) for f in families):
            continue
        families.append(trait)
    named = {f: {c for w, c in known.items() if w.startswith(f)} for f in families}
    for trait in sorted(families, key=lambda f: len(named[f]) != 1):  # those of known words first
        own = named[trait] if len(named[trait]) == 1 else SEEDS
        category = min(own, key=lambda c: len(covered[c]))
        dealt[category].add(trait)
        covered[category].update(i for i in marked if trait in bags[i])
    return dealt


def presence(texts: list[str | None], names: list[bytes]) -> np.ndarray:
    place = {w: k for k, w in enumerate(names)}
    x = np.zeros((len(texts), len(place)))
    for row, text in zip(x, texts):
        row[[place[w] for w in traits(words_of(text)) & place.keys()]] = 1
    return x


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability between two rows that gives the best F1 score."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # equal probabilities go together
    at = int(np.argmax(f1))
    low = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + low) / 2)


def learn_targets(texts: list[str | None], toxic: np.ndarray, langs: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """Traits the models see, and for every text its categories; both from each language's own texts."""
    y = np.zeros((len(texts), len(CHAIN)), np.int64)
    y[:, -1] = toxic
    names: set[bytes] = set()
    for lang in dict.fromkeys(langs):
        own = [i for i, x in enumerate(langs) if x == lang]
        bags = [traits(words_of(texts[i])) for i in own]
        for c, telling in deal_categories(bags, toxic[own]).items():
            y[own, CHAIN.index(c)] = [int(t and bool(bag & telling)) for t, bag in zip(toxic[own], bags)]
        names.update(trait for trait, _ in telling_traits(bags, y[own])[:FEATURES])
    return sorted(names), y


def train_chain(texts: list[str | None], toxic: list[int], ids: list[int],
                langs: list[str | None] | None = None) -> tuple[list[bytes], list[np.ndarray], float]:
    """Traits, one weight vector per category, and the threshold of the last one's verdict.

    The threshold is the best one for the out-of-fold probabilities. Without both kinds of
    labels there are no models and nothing is toxic.
    """
    if len(set(toxic)) < 2:
        return [], [], 1.0
    order = np.argsort(ids, kind="stable")
    texts = [texts[i] for i in order]
    names, y = learn_targets(
        texts, np.array([int(toxic[i]) for i in order]), [langs[i] if langs else None for i in order])
    x = presence(texts, names)
    fold = np.arange(len(texts)) % FOLDS
    models = []
    for k in range(len(CHAIN)):
        models.append(fit(x, y[:, k]))
        out_of_fold = np.zeros(len(texts))
        for f in range(FOLDS):
            test = fold == f
            if test.any() and not test.all():
                out_of_fold[test] = predict(x[test], fit(x[~test], y[~test, k]))
        x = np.column_stack([x, out_of_fold])
    return names, models, best_threshold(out_of_fold, y[:, -1])


def chain_probabilities(texts: list[str | None], names: list[bytes], models: list[np.ndarray]) -> np.ndarray:
    if not models:
        return np.zeros((len(texts), len(CHAIN)))
    x = presence(texts, names)
    for weights in models:
        x = np.column_stack([x, predict(x, weights)])
    return x[:, len(names):]


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, lang, toxic) of at most ``rows`` labelled ids; one text of each id."""
    chosen = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
              .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return (docs.select("doc_id", "text", lang.cast("string").alias("lang")).join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"), F.min("lang").alias("lang")))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[np.ndarray], float]:
    """Trains the chain in one task on the bounded sample."""
    def train(key: tuple, rows: pa.Table) -> pa.Table:
        names, models, threshold = train_chain(*(rows.column(c).to_pylist() for c in ("text", "toxic", "doc_id", "lang")))
        return pa.table({"names": pa.array([names], pa.list_(pa.binary())),
                         "models": pa.array([[m.tolist() for m in models]], pa.list_(pa.list_(pa.float64()))),
                         "threshold": pa.array([threshold])})

    sample = training_sample(docs, labels).withColumn("all", F.lit(1))
    model = sample.groupBy("all").applyInArrow(train, "names array<binary>, models array<array<double>>, threshold double").first()
    if model is None:
        return [], [], 1.0
    return [bytes(n) for n in model["names"]], [np.array(m) for m in model["models"]], model["threshold"]


def probabilities(text: Column, names: list[bytes], models: list[np.ndarray]) -> Column:
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(chain_probabilities(list(texts), names, models), columns=list(CHAIN))

    return F.pandas_udf(score, ", ".join(f"{c} double" for c in CHAIN))(text)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``p_insult``, ``p_contempt``, ``p_toxic`` and the verdict ``toxic``."""
    names, models, threshold = learn(docs, labels)
    scored = docs.withColumn("_chain", probabilities(F.col("text"), names, models))
    for c in CHAIN:
        scored = scored.withColumn(f"p_{c}", F.col(f"_chain.{c}"))
    return scored.drop("_chain").withColumn("toxic", F.col("p_toxic") >= threshold)
