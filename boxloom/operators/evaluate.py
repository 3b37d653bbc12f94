"""Matching of predictions to truth, and the figures derived from it.

The rule is the published VOC/COCO one: per image and class, predictions in falling
score take the free truth box they overlap most, if by at least the threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import area, box, intersection, iou, overlap_reaches
from boxloom.operators.match_blocks import match_in_blocks
from boxloom.plans.running import Running, running, value_bucket
from boxloom.plans.skew import hot_keys, join_on, small_side
from boxloom.session import durable

GROUP_LIMIT = 1_000
# The ten overlap levels of the averaged figure, in percent.
LEVELS = (50, 55, 60, 65, 70, 75, 80, 85, 90, 95)


def _corners(*first: Column) -> Column:
    return F.struct(*first, *[F.col(c) for c in ("x1", "y1", "x2", "y2")])


def _reached(overlap: Column, joint: Column, levels: tuple[int, ...]) -> Column:
    """The levels that an overlap reaches, one bit each."""
    return reduce(lambda m, k: m.bitwiseOR(F.when(overlap_reaches(overlap, joint, F.lit(levels[k])), 1 << k).otherwise(0)),
                  range(len(levels)), F.lit(0))


def _candidates(preds: Column, truths: Column, levels: tuple[int, ...]) -> Column:
    """Each prediction with the truth boxes it overlaps by the lowest level or more, best first."""
    def pair(p: Column, t: Column) -> Column:
        overlap = intersection(box(p), box(t))
        return F.struct((-iou(box(p), box(t))).alias("far"), t["box"].alias("box"), overlap.alias("overlap"),
                        (area(box(p)) + area(box(t)) - overlap).alias("joint"))

    def near(c: Column) -> Column:
        return overlap_reaches(c["overlap"], c["joint"], F.lit(min(levels)))

    def marked(c: Column) -> Column:
        return F.struct(c["far"].alias("far"), c["box"].alias("box"), _reached(c["overlap"], c["joint"], levels).alias("bits"))

    return F.transform(preds, lambda p: F.struct(
        p["box"].alias("box"), p["score"].cast("double").alias("score"),
        F.array_sort(F.transform(F.filter(F.transform(truths, lambda t: pair(p, t)), near), marked)).alias("near")))


_PICK = "struct<box:bigint,truth:bigint,bits:int>"


def _take(preds: Column) -> Column:
    """One fold over predictions in order decides all levels: (box, truth, bits) of what they take.

    A prediction goes through its truth boxes from the best on. At the levels it reaches it takes
    the truth unless a better prediction holds it there, and unless it has one there already.
    """
    def bits_of(picks: Column, test) -> Column:
        return F.aggregate(F.filter(picks, test), F.lit(0), lambda m, k: m.bitwiseOR(k["bits"]))

    def offer(picks: Column, p: Column, c: Column) -> Column:
        taken = bits_of(picks, lambda k: k["truth"].eqNullSafe(c["box"]) | k["box"].eqNullSafe(p["box"]))
        gain = c["bits"].bitwiseAND(F.bitwise_not(taken))
        pick = F.struct(p["box"].alias("box"), c["box"].alias("truth"), gain.alias("bits"))
        return F.when(gain > 0, F.concat(picks, F.array(pick))).otherwise(picks)

    return F.aggregate(preds, F.array().cast(f"array<{_PICK}>"), lambda picks, p: F.aggregate(
        p["near"], picks, lambda inner, c: offer(inner, p, c)))


def _by_level(picks: Column, levels: tuple[int, ...]) -> Column:
    """The truth taken at each level, null where none is."""
    def at(k: int) -> Column:
        return F.get(F.filter(picks, lambda c: c["bits"].bitwiseAND(1 << k) > 0), F.lit(0))["truth"]

    return F.array(*[at(k) for k in range(len(levels))])


def _folded(preds: DataFrame, truth: DataFrame, keys: list[str], levels: tuple[int, ...]) -> DataFrame:
    p = preds.groupBy(*keys).agg(F.sort_array(F.collect_list(_corners(
        (-F.col("score")).alias("at"), F.col("box"), F.col("score")))).alias("_p"))
    t = truth.groupBy(*keys).agg(F.collect_list(_corners(F.col("box"))).alias("_t"))
    met = join_on(p, t, keys, "left").select(*keys, "_p", F.when(
        F.col("_t").isNotNull(), _candidates(F.col("_p"), F.col("_t"), levels)).alias("_n"))
    # Exploding the one array keeps the fold out of the step below, which would run it per prediction.
    taken = met.select(*keys, "_p", F.explode(F.array(_take(F.filter("_n", lambda q: F.size(q["near"]) > 0)))).alias("_k"))
    each = taken.select(*keys, F.explode(F.transform("_p", lambda q: F.struct(
        q["box"].alias("box"), q["score"].cast("double").alias("score"),
        F.filter("_k", lambda k: k["box"].eqNullSafe(q["box"])).alias("own")))).alias("_r"))
    return each.select(*keys, "_r.box", "_r.score", _by_level(F.col("_r.own"), levels).alias("truths"))


def match_levels(preds: DataFrame, truth: DataFrame, levels: tuple[int, ...] = LEVELS,
                 keys: tuple[str, ...] = ("img", "cls"), group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Each prediction once, with the truth box it takes at each of ``levels`` (percent), or null.

    Inputs hold the keys, box, corners; predictions also score. One shuffle per side for
    usual groups; groups above ``group_limit`` on either side are settled in blocks.
    """
    keys = list(keys)
    sizes = preds.select(*keys).unionByName(truth.select(*keys))
    hot = hot_keys(sizes, keys, group_limit)
    if hot is None or min(levels) <= 0:
        return _folded(preds, truth, keys, levels)
    hot = small_side(hot)

    def part(df: DataFrame, how: str) -> DataFrame:
        return join_on(df, hot, keys, how)

    return _folded(part(preds, "left_anti"), part(truth, "left_anti"), keys, levels).unionByName(
        match_in_blocks(part(preds, "left_semi"), part(truth, "left_semi"), keys, levels))


def at_levels(matches: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``match_levels`` with a row per level: the columns level and truth in place of truths."""
    rest = [c for c in matches.columns if c != "truths"]
    return matches.select(*rest, F.posexplode("truths").alias("_k", "truth")).select(
        *rest, F.get(F.array(*[F.lit(v) for v in levels]), F.col("_k")).alias("level"), "truth")


def match(preds: DataFrame, truth: DataFrame, levels: tuple[int, ...] = LEVELS,
          keys: tuple[str, ...] = ("img", "cls"), group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Each prediction once per level with the truth box it takes, or null."""
    return at_levels(match_levels(preds, truth, levels, keys, group_limit), levels)


def _counted(matches: DataFrame, by: list[str], levels: tuple[int, ...]) -> DataFrame:
    """Hits and predictions (tp, n) per level and ``by``, from rows with ``truths`` or with ``truth``.

    Rows with all levels are counted in one pass, a column per level; only counts are unfolded.
    """
    everyone = F.count(F.lit(1)).alias("n")
    if "truths" not in matches.columns:
        marks = [c for c in ("level",) if c in matches.columns]
        return matches.groupBy(*marks, *by).agg(F.count("truth").alias("tp"), everyone)
    hits = F.array(*[F.count(F.get("truths", F.lit(k))) for k in range(len(levels))])
    return matches.groupBy(*by).agg(hits.alias("_tp"), everyone).select(
        *by, "n", F.posexplode("_tp").alias("_k", "tp")).select(
        F.get(F.array(*[F.lit(v) for v in levels]), F.col("_k")).alias("level"), *by, "tp", "n")


def curve(matches: DataFrame, truth: DataFrame, group: list[str],
          levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Precision and recall at every distinct score, per ``group`` columns of ``truth``.

    Predictions of equal score enter together, so ties leave no choice. Rows are combined
    to one per group and score and written once, before anything runs over a group; scores run in
    buckets whose bounds come from the scores themselves.
    """
    marks = ["level"] if "level" in matches.columns or "truths" in matches.columns else []
    keys = [*marks, *group]
    points = durable(_counted(matches, [*group, "score"], levels).withColumnsRenamed({"tp": "_tp", "n": "_all"}), "points")
    total = truth.groupBy(*group).agg(F.count(F.lit(1)).alias("n_truth")) if group else None
    ran = running(points, keys, -value_bucket(points, F.col("score")), [-F.col("score")],
                  tp=Running("sum", F.col("_tp")), n=Running("sum", F.col("_all")))
    if total is None:
        ran = ran.join(F.broadcast(truth.agg(F.count(F.lit(1)).alias("n_truth"))))
    else:
        ran = join_on(ran, total, group)
    precision = F.col("tp") / F.col("n")
    recall = F.col("tp") / F.col("n_truth")
    return ran.select(
        *keys, "score", F.col("_tp").alias("gain"), "tp", "n", "n_truth",
        precision.alias("precision"), recall.alias("recall"),
        (F.col("tp") * 2 / (F.col("n") + F.col("n_truth"))).alias("f1"),
    )


def average_precision(matches: DataFrame, truth: DataFrame, group: list[str],
                      levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Area under the falling envelope of the precision/recall curve, per level and group.

    Groups with truth but without predictions score 0.
    """
    points = durable(curve(matches, truth, group, levels), "curve")
    keys = ["level", *group]
    best = running(points, keys, value_bucket(points, F.col("score")), [F.col("score")],
                   best=Running("max", F.col("precision")))
    scored = best.groupBy(*keys).agg(
        (F.sum(F.col("gain") * F.col("best")) / F.max("n_truth")).alias("ap"))
    every = truth.select(*group).distinct().withColumn(
        "level", F.explode(F.array(*[F.lit(v) for v in levels])))
    return join_on(every, scored, keys, "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def operating_point(matches: DataFrame, truth: DataFrame, group: list[str], min_score: float,
                    levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Precision and recall of the predictions with at least ``min_score``, for every group with truth.

    A group without such predictions has recall 0 and no precision.
    """
    marks = ["level"] if "level" in matches.columns or "truths" in matches.columns else []
    counted = _counted(matches.filter(F.col("score") >= min_score), group, levels)
    total = truth.groupBy(*group).agg(F.count(F.lit(1)).alias("n_truth"))
    if marks:
        total = total.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    zero = F.lit(0).cast("bigint")
    every = join_on(total, counted, [*marks, *group], "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("tp", "n")})
    return every.select(
        *marks, *group, "tp", "n", "n_truth",
        F.try_divide("tp", "n").alias("precision"),
        (F.col("tp") / F.col("n_truth")).alias("recall"))


def best_threshold(points: DataFrame, group: list[str]) -> DataFrame:
    """The score with the highest F1 per group; the higher score wins a tie."""
    keys = [*[c for c in ("level",) if c in points.columns], *group]
    picked = F.max_by(F.struct("score", "f1", "precision", "recall"), F.struct("f1", "score"))
    return points.groupBy(*keys).agg(picked.alias("_b")).select(*keys, "_b.*")
