"""Quality rules: word and line counts, then an n-gram likelihood ratio against trusted text.

Only DataFrame functions are used. Word 1- and 2-grams are hashed into ``BUCKETS`` buckets.
Two smoothed multinomials over the buckets are counted over the corpus: one of all documents,
one of the documents trusted as targets. A document's score is the mean over its n-grams of
log(target / raw); it is kept if no base rule fails and the score reaches the threshold.

The threshold is set where held-out scores part labelled good from labelled bad documents best,
so every document is judged by the same number. Only labelled documents that no base rule fails
count, and trusted ones are scored with a target that their own fold is left out of. Bad labels may
be few or none, so ``PRIOR_BAD`` more is thought a number of deviations below the mean of those
held-out trusted scores, however many there are.

Defined results: a null or empty text has no words, so its counts are 0, its score is 0 and it
fails the base rule; null or unknown ids in ``labels`` are ignored; repeated rows are counted
and judged one by one; an empty corpus gives no rows. Without trusted documents both
multinomials are equal and all scores are 0; if no trusted document passes the base rules, only
they decide. Columns beyond
(doc_id, text) are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.jaccard_join import bounded_ids

BUCKETS = 10_000
#: Parts of the trusted documents, by a hash of the id, for scores that do not know the document.
FOLDS = 10
#: Pseudo count of each bucket in both multinomials.
SMOOTHING = 1.0
#: Bad documents added to the labelled ones, and how many standard deviations below the mean of the
#: trusted documents they lie.
PRIOR_BAD = 1
DEVIATIONS = 3.0
#: Held-out scores are counted in steps of this size.
STEP = 1e-4
WHITE = "\\x20\\x09-\\x0D"


def words(text: Column) -> Column:
    """Words of a text as an array, empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WHITE}]+"))


def bound(value: Column, body) -> Column:
    """``body`` over a value that is computed once and then named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(words_: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words, in order."""
    return F.when(F.size(words_) < size, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.size(words_) - size),
            lambda i: F.xxhash64(*[F.get(words_, i + k) for k in range(size)])))


def repeated_words(words_: Column, size: int = 3) -> Column:
    """Words inside windows that occur twice or more in the text, all occurrences counted.

    Windows sorted with their places put equal ones side by side; each repeated window adds
    the words the one before it has not covered.
    """
    def covered(places: Column) -> Column:
        return F.aggregate(
            places, F.struct(F.lit(-size).alias("last"), F.lit(0).cast("bigint").alias("n")),
            lambda acc, p: F.struct(
                p.alias("last"), (acc["n"] + F.least(F.lit(size), p - acc["last"])).alias("n")),
            lambda acc: acc["n"])

    def repeated_places(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bound(placed, lambda z: F.sort_array(F.transform(
            F.filter(z, lambda x, i: (
                F.coalesce(F.get(z, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(z, i + 1)["h"] == x["h"], F.lit(False)))),
            lambda x: x["i"])))

    return bound(bound(words_, lambda listed: windows(listed, size)), lambda hashes: F.when(
        F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")
    ).otherwise(covered(repeated_places(hashes))))


def buckets(words_: Column) -> Column:
    """Bucket numbers of all word 1- and 2-grams."""
    def folded(h: Column) -> Column:
        return F.pmod(h, F.lit(BUCKETS)).cast("int")

    return bound(words_, lambda listed: F.concat(
        F.transform(listed, lambda w: folded(F.xxhash64(w))),
        F.transform(windows(listed, 2), folded)))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, words and the counts the base rules use; lines are split at line feeds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = docs.select(F.col("doc_id"), text.alias("text"), words(F.col("text")).alias("words"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.rlike(x, F.lit(f"[^{WHITE}]")))
    n_dup = bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    word_chars = F.length(F.array_join("words", ""))
    n_symbols = F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", ""))
    return listed.select(
        "doc_id", "words",
        F.size("words").cast("bigint").alias("n_words"),
        word_chars.cast("bigint").alias("word_chars"),
        n_symbols.cast("bigint").alias("n_symbols"),
        n_dup.cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids labelled as good quality."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket, from the n-grams of all documents.

    Row i leaves fold i of the trusted documents out of the target; the last row has all.
    """
    marked = docs.select("doc_id", "text").join(
        bounded_ids(trusted).select("doc_id", fold(F.col("doc_id")).alias("fold")), "doc_id", "left")
    parts = [F.count_if(F.col("fold") == i).alias(f"t{i}") for i in range(FOLDS)]
    counted = (
        marked.select("fold", F.explode(buckets(words(F.col("text")))).alias("b"))
        .groupBy("b").agg(F.count("*").alias("raw"), *parts).collect())
    raw, target = np.zeros(BUCKETS), np.zeros((FOLDS, BUCKETS))
    for row in counted:  # at most BUCKETS rows
        raw[row["b"]] = row["raw"]
        target[:, row["b"]] = [row[f"t{i}"] for i in range(FOLDS)]
    total = target.sum(axis=0)
    share = lambda n: (n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS)
    used = np.vstack([total - target, total])
    return np.array([np.log(share(n) / share(raw)) if n.sum() else np.zeros(BUCKETS) for n in used])


def mean_ratio(words_: Column, ratios: np.ndarray, start: Column | None = None) -> Column:
    """Mean of the buckets' ratios over a document's n-grams; 0 without any.

    ``start`` is where the document's own row of ``ratios`` begins, if there are several.
    """
    table = F.split(F.lit(",".join(map(repr, ratios.ravel().tolist()))), ",").cast("array<double>")
    at = (lambda x: x) if start is None else (lambda x: x + start)
    return bound(buckets(words_), lambda b: F.when(F.size(b) == 0, F.lit(0.0)).otherwise(
        F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.get(table, at(x))) / F.size(b)))


def held_out_scores(docs: DataFrame, labels: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Quality label and score of labelled documents that pass the base rules.

    The fold of a good document is left out of the target it is scored with; a bad one is in none.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").alias("quality"))
    start = BUCKETS * F.when(F.col("quality") == 1, fold(F.col("doc_id"))).otherwise(FOLDS)
    score = bound(words(F.col("text")), lambda w: F.when(
        ~base_failed(F.size(w), repeated_words(w)), mean_ratio(w, ratios, start)))
    return docs.select("doc_id", "text").join(bounded_ids(known), "doc_id").select("quality", score.alias("s"))


def best_cut(good: dict[float, int], bad: dict[float, int]) -> float:
    """Score from which documents are kept, given how many labelled ones have which score.

    It is where the share of good ones below and the share of bad ones from there on add up to the
    least, in the middle of the gap; without bad ones a number of deviations below the mean.
    """
    n_good, n_bad = sum(good.values()), sum(bad.values())
    if not n_good:
        return float("-inf")
    if not n_bad:
        mean = sum(s * n for s, n in good.items()) / n_good
        return mean - DEVIATIONS * (sum((s - mean) ** 2 * n for s, n in good.items()) / n_good) ** 0.5
    at = sorted(good.keys() | bad.keys())
    lost, passed = 0, n_bad
    best, cut = passed / n_bad, at[0]
    for low, high in zip(at, at[1:] + [at[-1] + 2 * STEP]):
        lost += good.get(low, 0)
        passed -= bad.get(low, 0)
        if lost / n_good + passed / n_bad < best:
            best, cut = lost / n_good + passed / n_bad, (low + high) / 2
    return cut


def guarded_cut(good: dict[float, int], bad: dict[float, int]) -> float:
    """``best_cut`` with the added bad documents among the labelled ones."""
    if not good:
        return float("-inf")
    added = best_cut(good, {}) - STEP
    return best_cut(good, {**bad, added: bad.get(added, 0) + PRIOR_BAD})


def learned(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Ratios of all buckets, and the score from which a document is kept."""
    ratios = log_ratios(docs, trusted_ids(labels))
    counts: dict[int, dict[float, int]] = {0: {}, 1: {}}
    scores = held_out_scores(docs, labels, ratios)
    for row in scores.groupBy("quality", F.floor(F.col("s") / STEP).alias("step")).count().collect():
        if row["step"] is not None:
            counts[row["quality"]][row["step"] * STEP] = row["count"]
    return ratios[-1], guarded_cut(counts[1], counts[0])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base verdict, score and verdict of every document."""
    ratios, threshold = learned(docs, labels)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    scored = base_counts(docs).withColumn("score", mean_ratio(F.col("words"), ratios)).drop("words")
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those documents that are kept, with all their columns."""
    ratios, threshold = learned(docs, labels)
    good = bound(words(F.col("text")), lambda w: (
        ~base_failed(F.size(w), repeated_words(w)) & (mean_ratio(w, ratios) >= F.lit(threshold))))
    return docs.where(good)
