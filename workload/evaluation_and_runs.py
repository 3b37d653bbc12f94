"""Matching against truth, its figures, and training reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.operators import evaluate, runs
from boxloom.session import durable
from workload import views as V
from workload.register import query
from workload.views import area_sql, overlap_sql, with_views

_I = overlap_sql("p", "t")
_U = f"({area_sql('p')} + {area_sql('t')} - {_I})"

# Ordered matching: one step of the recursion per rank of a prediction within its group.
_MATCH = f"""
levels AS (SELECT unnest([50, 55, 60, 65, 70, 75, 80, 85, 90, 95]) AS level),
ranked AS (SELECT *, row_number() OVER (PARTITION BY img, cls ORDER BY score DESC, box) AS rn FROM preds),
cand AS (
  SELECT p.img, p.cls, p.box, list({{'iou': {_I} / {_U}, 'low': -t.box, 'box': t.box, 'i': {_I}, 'u': {_U}}}) AS c
  FROM ranked p JOIN truth t ON t.img = p.img AND t.cls = p.cls AND {_I} * 2 >= {_U} GROUP BY ALL),
steps AS (
  SELECT r.img, r.cls, r.box, r.score, r.rn, level, c.c FROM ranked r CROSS JOIN levels LEFT JOIN cand c USING (img, cls, box)),
fold AS (
  SELECT img, cls, level, 0::bigint AS rn, []::bigint[] AS taken, NULL::bigint AS box, NULL::bigint AS score, NULL::bigint AS truth
  FROM (SELECT DISTINCT img, cls, level FROM steps)
  UNION ALL
  SELECT img, cls, level, rn, CASE WHEN hit IS NULL THEN taken ELSE list_append(taken, hit) END, box, score, hit FROM (
    SELECT s.*, f.taken, list_max(list_transform(list_filter(s.c, lambda x: x.i * 100 >= x.u * s.level AND NOT list_contains(f.taken, x.box)),
             lambda x: {{'iou': x.iou, 'low': x.low, 'box': x.box}})).box AS hit
    FROM fold f JOIN steps s ON s.img = f.img AND s.cls = f.cls AND s.level = f.level AND s.rn = f.rn + 1)),
matched AS (SELECT img, cls, level, box, score, truth FROM fold WHERE rn > 0)"""


def _matches(spark, d, levels=evaluate.LEVELS):
    """Matches and the truth; both inputs are read several times, so they are derived once and written."""
    truth = durable(V.truth(spark, d), "truth")
    return evaluate.match_levels(durable(V.preds(spark, d), "preds"), truth, levels), truth


@query(with_views("preds truth", "SELECT img, cls, level, box, score::double AS score, truth FROM matched", _MATCH))
def matched_predictions(spark, d):
    return evaluate.at_levels(_matches(spark, d)[0])


_AT_LEVELS = "SELECT img, cls, box, score::double AS score, list(truth ORDER BY level) AS truths FROM matched GROUP BY ALL"


@query(with_views("preds truth", _AT_LEVELS, _MATCH))
def matched_at_all_levels(spark, d):
    """A row per prediction with what it takes at the ten levels."""
    return _matches(spark, d)[0]


@query(with_views("crowded_preds crowded_truth", _AT_LEVELS,
                  _MATCH.replace("FROM preds)", "FROM crowded_preds)").replace("JOIN truth t", "JOIN crowded_truth t")))
def crowded_matches(spark, d):
    """The same on seven large canvases of two classes, each of them hot.

    Both sides are read several times, so their boxes are derived once and written.
    """
    boxes = durable(V.crowded(spark, d), "boxes")
    return evaluate.match_levels(V.crowded_preds(boxes), V.crowded_truth(boxes), group_limit=V.CROWD_LIMIT)


_CURVE = """,
totals AS (SELECT cls, count(*) AS n_truth FROM truth GROUP BY 1),
points AS (
  SELECT level, cls, score, gain, tp, n, tp / n AS prec FROM (
    SELECT level, cls, score, gain, sum(gain) OVER w AS tp, sum(every) OVER w AS n FROM (
      SELECT level, cls, score, count(truth) AS gain, count(*) AS every FROM matched GROUP BY ALL)
    WINDOW w AS (PARTITION BY level, cls ORDER BY score DESC))),
ap AS (
  SELECT l.level, t.cls, coalesce(sum(gain * best) / any_value(n_truth), 0.0) AS ap FROM totals t CROSS JOIN levels l
  LEFT JOIN (SELECT *, max(prec) OVER (PARTITION BY level, cls ORDER BY score) AS best FROM points) p
    ON p.cls = t.cls AND p.level = l.level GROUP BY 1, 2)"""


@query(with_views("preds truth", "SELECT level, cls, round(ap, 9) AS ap FROM ap", _MATCH + _CURVE))
def average_precision(spark, d):
    out = evaluate.average_precision(*_matches(spark, d), ["cls"])
    return out.select("level", "cls", F.round("ap", 9).alias("ap"))


@query(with_views("preds truth", """
SELECT round(avg(ap) FILTER (level = 50), 9) AS map50, round(avg(ap), 9) AS map50_95 FROM ap""", _MATCH + _CURVE))
def mean_average_precision(spark, d):
    out = evaluate.average_precision(*_matches(spark, d), ["cls"])
    return out.agg(F.round(F.avg(F.when(F.col("level") == 50, F.col("ap"))), 9).alias("map50"),
                   F.round(F.avg("ap"), 9).alias("map50_95"))


@query(with_views("preds truth", """
SELECT 50 AS level, t.cls, count(m.truth) AS tp, count(m.box) AS n, any_value(n_truth) AS n_truth,
       count(m.truth) / nullif(count(m.box), 0) AS precision, count(m.truth) / any_value(n_truth) AS recall
FROM totals t LEFT JOIN matched m ON m.cls = t.cls AND m.score >= 690 AND m.level = 50 GROUP BY t.cls""", _MATCH + _CURVE))
def operating_points(spark, d):
    return evaluate.operating_point(*_matches(spark, d, (50,)), ["cls"], 690, (50,))


_F1 = _MATCH + """,
f1 AS (
  SELECT score::double AS score, tp, n, tp / n AS precision, tp / total AS recall, tp * 2 / (n + total) AS f1 FROM (
    SELECT score, sum(gain) OVER w AS tp, sum(every) OVER w AS n, (SELECT count(*) FROM truth) AS total FROM (
      SELECT score, count(truth) AS gain, count(*) AS every FROM matched WHERE level = 50 GROUP BY 1)
    WINDOW w AS (ORDER BY score DESC)))"""


def _f1(spark, d):
    return evaluate.curve(*_matches(spark, d, (50,)), [], (50,))


@query(with_views("preds truth", "SELECT score, tp::bigint AS tp, n::bigint AS n, precision, recall, f1 FROM f1", _F1))
def f1_curve(spark, d):
    return _f1(spark, d).select("score", "tp", "n", "precision", "recall", "f1")


@query(with_views("preds truth", """
SELECT 50 AS level, score, f1, precision, recall FROM f1 ORDER BY f1 DESC, score DESC LIMIT 1""", _F1))
def best_confidence(spark, d):
    return evaluate.best_threshold(_f1(spark, d), [])


# --- training reports -----------------------------------------------------------------------------

@query(with_views("run_metrics", """
SELECT run, epoch, time_c, map50, max(map50) OVER w AS best_so_far, time_c - coalesce(lag(time_c) OVER w, 0) AS epoch_time
FROM run_metrics WINDOW w AS (PARTITION BY run ORDER BY epoch)"""))
def epoch_report(spark, d):
    return runs.epoch_report(V.run_metrics(spark, d), "time_c", "map50")


@query(with_views("run_metrics", """
SELECT run, 'map50' AS metric, min_by(epoch, (-map50, epoch)) AS epoch, max(map50)::double AS value FROM run_metrics GROUP BY 1
UNION ALL SELECT run, 'time_c', min_by(epoch, (time_c, epoch)), min(time_c)::double FROM run_metrics GROUP BY 1"""))
def best_epochs(spark, d):
    return runs.best_epochs(V.run_metrics(spark, d), ["map50", "time_c"], lowest=("time_c",))


@query(with_views("run_metrics", """
SELECT run, count(*) AS epochs, max(time_c) AS total_time, max(time_c) / count(*) AS mean_time FROM run_metrics GROUP BY 1"""))
def run_summary(spark, d):
    return runs.run_summary(V.run_metrics(spark, d), "time_c")
