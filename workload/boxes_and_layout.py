"""Geometry, filters, suppression, layout, occlusion and the tables written from boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions import geometry as G
from boxloom.operators import layout, occlusion, overlap, slots
from boxloom.operators.suppress import keep_best, kept_per_group
from boxloom.plans.skew import top_k
from boxloom.session import durable
from boxloom.sinks import tables as S
from workload import views as V
from workload.register import query
from workload.views import area_sql, greedy_sql, overlap_sql, with_views

def canvas():
    return F.lit(V.WIDTH), F.lit(V.HEIGHT)


def label():
    return G.Label(*[F.col(c) for c in ("cx", "cy", "w", "h")])


def by_score():
    return [-F.col("score"), F.col("box")]


def _named(parts, names):
    return [c.alias(n) for c, n in zip(parts, names)]


@query(with_views("boxes", """
SELECT img, box, (x1 + x2) / 3840 AS cx, (y1 + y2) / 2160 AS cy, (x2 - x1) / 1920 AS w, (y2 - y1) / 1080 AS h FROM boxes"""))
def center_labels(spark, d):
    return V.boxes(spark, d).select(
        "img", "box", *_named(G.to_label(G.box(), *canvas()), ("cx", "cy", "w", "h")))


_PIXELS = """
SELECT stem, box_no, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM (
  SELECT *, l + bw AS r, t + bh AS b FROM (
    SELECT stem, box_no, cast(trunc((cx - w / 2) * 400) AS bigint) AS l, cast(trunc((cy - h / 2) * 300) AS bigint) AS t,
           cast(trunc(w * 400) AS bigint) AS bw, cast(trunc(h * 300) AS bigint) AS bh
    FROM (SELECT * REPLACE (cx * 4 - 1 AS cx, cy * 4 - 1 AS cy) FROM labels)))"""


def _wide_labels(spark, d):
    """Labels spread beyond a small canvas, so that every bound is met."""
    return V.labels(spark, d).withColumns({"cx": F.col("cx") * 4 - 1, "cy": F.col("cy") * 4 - 1})


@query(with_views("labels", _PIXELS.format(
    x1="greatest(0, l)", y1="greatest(0, t)", x2="least(399, r)", y2="least(299, b)")))
def clamped_corners(spark, d):
    return _wide_labels(spark, d).select(
        "stem", "box_no", *_named(G.to_corners(label(), F.lit(400), F.lit(300)), ("x1", "y1", "x2", "y2")))


@query(with_views("labels", _PIXELS.format(x1="l", y1="t", x2="r", y2="b")))
def placement_corners(spark, d):
    return _wide_labels(spark, d).select("stem", "box_no", *_named(
        G.to_corners(label(), F.lit(400), F.lit(300), clamp=False), ("x1", "y1", "x2", "y2")))


@query(with_views("boxes", """
SELECT img, box, CASE WHEN x2 - 70 > x1 AND y2 > y1 THEN (y2 - y1) / (x2 - 70 - x1) END AS aspect,
       (x2 - 70 - x1) * (y2 - y1) / 2073600 AS share, x2 - 70 > x1 AND y2 > y1 AS solid FROM boxes"""))
def box_shapes(spark, d):
    """Shapes of boxes cut by 70 pixels, so that some lose their width."""
    a = G.box()._replace(x2=F.col("x2") - 70)
    return V.boxes(spark, d).select(
        "img", "box", G.aspect(a).alias("aspect"), G.area_share(a, *canvas()).alias("share"),
        G.has_sides(a).alias("solid"))


@query(with_views("labels", """
SELECT stem, box_no, a AS angle,
       CASE a WHEN 90 THEN cy WHEN 180 THEN 1 - cx WHEN 270 THEN 1 - cy ELSE cx END AS cx,
       CASE a WHEN 90 THEN 1 - cx WHEN 180 THEN 1 - cy WHEN 270 THEN cx ELSE cy END AS cy,
       CASE WHEN a IN (90, 270) THEN h ELSE w END AS w, CASE WHEN a IN (90, 270) THEN w ELSE h END AS h
FROM (SELECT *, (box_no % 4) * 90 AS a FROM labels)"""))
def rotated_labels(spark, d):
    angle = F.col("angle")
    return V.labels(spark, d).withColumn("angle", (F.col("box_no") % 4) * 90).select(
        "stem", "box_no", "angle", *_named(G.rotate_label(label(), angle), ("cx", "cy", "w", "h")))


@query(with_views("labels", """
SELECT split, stem, box_no, printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h) AS line FROM labels"""))
def fixed_point_lines(spark, d):
    return S.label_lines(V.labels(spark, d))


@query(with_views("labels", """
SELECT stem, box_no, hi AS highlighted, cast(trunc(cw * s) AS bigint) AS card_w, cast(trunc(ch * s) AS bigint) AS card_h FROM (
  SELECT *, CASE WHEN hi THEN least(cast(trunc(w * 1920) AS bigint) / cw, cast(trunc(h * 1080) AS bigint) / ch)
                 ELSE (150 / cw + 200.0 / ch) / 2.0 END AS s
  FROM (SELECT *, 450 + class_id AS cw, 628 + class_id AS ch, coalesce(t, 0) <> 0 AND coalesce(w * h > t, false) AS hi
        FROM (SELECT *, CASE WHEN class_id % 10 = 0 THEN NULL WHEN class_id % 10 = 1 THEN 0.0 ELSE 0.0101 END::double AS t FROM labels)))"""))
def placement_sizes(spark, d):
    c = F.col("class_id")
    threshold = F.when(c % 10 == 0, F.lit(None).cast("double")).when(c % 10 == 1, 0.0).otherwise(0.0101)
    highlighted, card_w, card_h = G.placement_size(
        label(), *canvas(), 450 + c, 628 + c, F.lit(150), F.lit(200), threshold)
    return V.labels(spark, d).select(
        "stem", "box_no", highlighted.alias("highlighted"), card_w.alias("card_w"), card_h.alias("card_h"))


@query(with_views("boxes", """
SELECT img, box, greatest(0, least(x1, 600 - 300)) AS px, greatest(0, least(y2 + 10, 800 - 420)) AS py FROM boxes"""))
def preview_corners(spark, d):
    px, py = G.preview_corner(G.box(), F.lit(600), F.lit(800), F.lit(300), F.lit(420))
    return V.boxes(spark, d).select("img", "box", px.alias("px"), py.alias("py"))


# --- filters -------------------------------------------------------------------------------

_SHAPE = ("x2 > x1 AND y2 > y1 AND (y2 - y1) / (x2 - x1) BETWEEN {} AND {} "
          "AND (x2 - x1) * (y2 - y1) / 2073600 BETWEEN {} AND {}")
_SLOT = _SHAPE.format(1.25, 1.55, 0.005, 0.50)
_LIVE = _SHAPE.format(0.6, 2.2, 0.004, 0.15)


@query(with_views("boxes", f"SELECT img, box FROM boxes WHERE {_SLOT}"))
def slot_shaped_boxes(spark, d):
    return V.boxes(spark, d).filter(G.slot_shape(G.box(), *canvas())).select("img", "box")


@query(with_views("boxes", f"SELECT img, box FROM boxes WHERE {_LIVE}"))
def live_shaped_boxes(spark, d):
    return V.boxes(spark, d).filter(G.live_shape(G.box(), *canvas())).select("img", "box")


@query(with_views("boxes", "SELECT img, box, score FROM boxes WHERE score >= 690"))
def confident_boxes(spark, d):
    return V.boxes(spark, d).filter(F.col("score") >= 690).select("img", "box", "score")


# --- overlap and suppression ------------------------------------------------------------------

_INTER = overlap_sql("a", "b")
_JOINT = f"({area_sql('a')} + {area_sql('b')} - {_INTER})"


@query(with_views("boxes", f"""
SELECT a.img, a.box AS a, b.box AS b, {_INTER} AS overlap, {_JOINT} AS joint, {_INTER} / {_JOINT} AS iou
FROM boxes a JOIN boxes b ON a.img = b.img AND a.box < b.box AND {_INTER} > 0 AND {_INTER} * 2 >= {_JOINT}"""))
def overlapping_pairs(spark, d):
    """Pairs that share at least half of their joint area."""
    boxes = V.boxes(spark, d)
    return overlap.overlapping_pairs(boxes, boxes, ["img"], "box", "box", 0.5, once=True)


_COLUMNS = ("img", "box", "cls", "score", "x1", "y1", "x2", "y2")


def _boxes(spark, d):
    return V.boxes(spark, d).select(*_COLUMNS)


def greedy(body: str, num: int, den: int, group: str = "img", source: str = "boxes") -> str:
    return with_views("boxes", body, greedy_sql("kept", source, group, num, den))


@query(greedy("SELECT img, box, cls, score, x1, y1, x2, y2 FROM kept", 1, 4))
def greedy_slots(spark, d):
    return keep_best(_boxes(spark, d), ["img"], by_score(), 0.25)


@query(greedy("SELECT img, box FROM kept", 1, 2))
def suppressed_any_class(spark, d):
    return keep_best(_boxes(spark, d), ["img"], by_score(), 0.5).select("img", "box")


_PER_CLASS = "img * 8 + cls % 4"


@query(greedy("SELECT img, cls % 4 AS cls, box FROM kept", 1, 2, _PER_CLASS))
def suppressed_per_class(spark, d):
    boxes = _boxes(spark, d).withColumn("cls", F.col("cls") % 4)
    return keep_best(boxes, ["img", "cls"], by_score(), 0.5).select("img", "cls", "box")


_SHAPED = f"(SELECT * FROM boxes WHERE {_SLOT})"


@query(greedy("""
SELECT img, box, slot FROM (SELECT img, box, row_number() OVER (PARTITION BY img ORDER BY score DESC, box) AS slot FROM kept)
WHERE slot <= 30""", 1, 4, source=_SHAPED))
def top_slots(spark, d):
    """Slot-shaped boxes, overlaps removed, at most 30 per image."""
    shaped = _boxes(spark, d).filter(G.slot_shape(G.box(), *canvas()))
    kept = kept_per_group(shaped.select(*_COLUMNS), ["img"], by_score(), 0.25, 30)
    return kept.select("img", F.posexplode("kept").alias("_i", "_b")).select(
        "img", "_b.box", (F.col("_i") + 1).cast("bigint").alias("slot"))


@query(with_views("boxes", """
SELECT img, box, score FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, box) AS rn FROM boxes) WHERE rn <= 300"""))
def top_detections(spark, d):
    return top_k(V.boxes(spark, d).select("img", "box", "score"), ["img"], by_score(), 300)


@query(greedy("""
SELECT (SELECT count(DISTINCT img) FROM boxes) AS images, count(*) AS slots FROM (
  SELECT row_number() OVER (PARTITION BY img ORDER BY score DESC, box) AS slot FROM kept) WHERE slot <= 30""",
              1, 4, source=_SHAPED))
def slot_run_totals(spark, d):
    """Images seen and boxes written by a slot run, in one pass over images."""
    boxes = _boxes(spark, d)
    kept = kept_per_group(boxes.filter(G.slot_shape(G.box(), *canvas())), ["img"], by_score(), 0.25, 30)
    rows = boxes.select("img").distinct().select(F.lit(1).alias("image"), F.lit(0).alias("slots")).unionByName(
        kept.select(F.lit(0).alias("image"), F.size("kept").alias("slots")))
    return rows.agg(F.sum("image").cast("bigint").alias("images"), F.sum("slots").cast("bigint").alias("slots"))


@query(greedy("""
SELECT i.img AS image, coalesce(found, []) AS slots, coalesce(found, []) AS candidates
FROM (SELECT DISTINCT img FROM boxes) i LEFT JOIN (
  SELECT img, list([x1::double, y1::double, x2::double, y2::double] ORDER BY score DESC, box) AS found
  FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, box) AS slot FROM kept)
  WHERE slot <= 30 GROUP BY 1) s ON s.img = i.img""",
              1, 4, source=_SHAPED))
def slot_records(spark, d):
    boxes = _boxes(spark, d)
    kept = kept_per_group(boxes.filter(G.slot_shape(G.box(), *canvas())), ["img"], by_score(), 0.25, 30)
    flat = kept.select("img", F.posexplode("kept").alias("slot", "_b")).select("img", "slot", "_b.*")
    return S.slot_records(flat, boxes, "img", "slot")


@query(with_views("boxes", """
SELECT i.img AS image, coalesce(found, []) AS slots, coalesce(found, []) AS candidates
FROM (SELECT DISTINCT img FROM boxes) i LEFT JOIN (
  SELECT img, list([x1::double, y1::double, x2::double, y2::double] ORDER BY score DESC, box) AS found
  FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, box) AS slot FROM kept)
  WHERE slot <= 30 GROUP BY 1) s ON s.img = i.img""",
    greedy_sql("sure", "(SELECT * FROM boxes WHERE score >= 200)", "img", 1, 2) + f""",
capped AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY img ORDER BY score DESC, box) AS n FROM sure)
           WHERE n <= 300 AND {_SLOT}),
""" + greedy_sql("kept", "capped", "img", 1, 4)))
def proposed_slots(spark, d):
    """Detections to slot records in one operator."""
    boxes = _boxes(spark, d).withColumn("score", F.col("score") / 1000)
    return slots.propose_slots(boxes, boxes, "img", by_score(), *canvas())


# --- hot images: thousands of boxes each, more with every scale --------------------------------

_CROWD_IOU = f"""
near AS (
  SELECT a.img, a.box AS a, b.box AS b, {overlap_sql('a', 'b')} AS overlap, {area_sql('a')} + {area_sql('b')} - {overlap_sql('a', 'b')} AS joint
  FROM (SELECT *, unnest([x1 // 400 + 1, x1 // 400 + 2]) AS t FROM crowded) a
  JOIN (SELECT *, x1 // 400 + 1 AS t FROM crowded) b ON a.img = b.img AND a.t = b.t AND (a.x1, a.box) < (b.x1, b.box)
  WHERE a.x2 > b.x1 AND a.y1 < b.y2 AND b.y1 < a.y2)"""


@query(with_views("crowded", """
SELECT img, least(a, b) AS a, greatest(a, b) AS b, overlap::bigint AS overlap FROM near WHERE overlap > 0 AND overlap * 10 >= joint""", _CROWD_IOU))
def crowded_pairs(spark, d):
    """Overlapping pairs of hot images, which meet on a grid."""
    rows = V.crowded(spark, d)
    return overlap.overlapping_pairs(rows, rows, ["img"], "box", "box", 0.1, once=True).select("img", "a", "b", "overlap")


@query(with_views("crowded", """
SELECT img, box, score FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, box) AS rn FROM crowded) WHERE rn <= 300"""))
def crowded_top_detections(spark, d):
    """The cap of 300 binds on every image."""
    return top_k(V.crowded(spark, d).select("img", "box", "score"), ["img"], by_score(), 300)


@query(with_views("crowded", """
SELECT 'page' AS split, cast(img AS varchar) AS stem, string_agg(cast(cls AS varchar), chr(10) ORDER BY box) AS text FROM crowded GROUP BY img"""))
def crowded_label_texts(spark, d):
    """One text an image, however many lines it has."""
    lines = V.crowded(spark, d).select(
        F.lit("page").alias("split"), F.col("img").cast("string").alias("stem"), F.col("box").alias("box_no"),
        F.col("cls").cast("string").alias("line"))
    return S.label_texts(lines, lines)


@query()
def crowded_slots(spark, d):
    """Greedy removal on hot images: rounds over pairs. Its SQL takes a minute; tests hold it against a loop."""
    return keep_best(V.crowded(spark, d), ["img"], by_score(), 0.25).select("img", "box")


@query(with_views("labels", """
SELECT split, stem, string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h), chr(10) ORDER BY box_no) AS text
FROM labels GROUP BY ALL"""))
def label_texts(spark, d):
    return S.label_texts(S.label_lines(V.labels(spark, d)), V.images(spark, d))


# --- layout ----------------------------------------------------------------------------------

_LAYOUT = with_views("labels images", """
SELECT i.img, n AS boxes, coalesce(min_h, 1.0) AS min_height, med AS median_area,
       CASE WHEN n IS NULL THEN 300.0 WHEN band_n >= greatest(3, n // 3) THEN band_w * 1920 ELSE sq END AS target_w,
       CASE WHEN n IS NULL THEN 420.0 WHEN band_n >= greatest(3, n // 3) THEN band_h * 1080 ELSE sq * 1.4 END AS target_h,
       med * 1.5 AS highlight_above, coalesce(trimmed, 1.0) * (1920.0::double / 1080) AS mean_aspect,
       coalesce(tall * (1920.0::double / 1080), coalesce(trimmed, 1.0) * (1920.0::double / 1080) * 2.4) AS tall_aspect
FROM images i LEFT JOIN (
  SELECT img, any_value(n) AS n, min(h) AS min_h, any_value(med) AS med, sqrt(any_value(med) * 2073600 / 1.4) AS sq,
         count(*) FILTER (w * h BETWEEN med * 0.9::double AND med * 1.1::double) AS band_n,
         median(w) FILTER (w * h BETWEEN med * 0.9::double AND med * 1.1::double) AS band_w,
         median(h) FILTER (w * h BETWEEN med * 0.9::double AND med * 1.1::double) AS band_h,
         avg(h / w) FILTER (CASE WHEN floor(n * 0.75) > floor(n * 0.25) THEN rn > floor(n * 0.25) AND rn <= floor(n * 0.75) ELSE true END) AS trimmed,
         avg(h / w) FILTER (h / w >= 1.5) AS tall
  FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY h / w) AS rn, count(*) OVER (PARTITION BY img) AS n,
               median(w * h) OVER (PARTITION BY img) AS med FROM labels) GROUP BY img) s ON s.img = i.img""")


def _layout(spark, d):
    sized = V.images(spark, d).select("img", F.lit(V.WIDTH).alias("width"), F.lit(V.HEIGHT).alias("height"))
    return layout.layout_stats(sized, V.labels(spark, d).select("img", "w", "h"), ["img"])


@query(f"SELECT * FROM ({_LAYOUT})")
def layout_stats(spark, d):
    return _layout(spark, d)


@query(f"SELECT img, median_area, highlight_above FROM ({_LAYOUT})")
def median_box_areas(spark, d):
    return _layout(spark, d).select("img", "median_area", "highlight_above")


@query(f"SELECT img, target_w, target_h FROM ({_LAYOUT})")
def target_card_sizes(spark, d):
    return _layout(spark, d).select("img", "target_w", "target_h")


@query(f"SELECT img, mean_aspect, tall_aspect FROM ({_LAYOUT})")
def mean_aspects(spark, d):
    return _layout(spark, d).select("img", "mean_aspect", "tall_aspect")


@query(f"SELECT img, min_height FROM ({_LAYOUT})")
def min_box_heights(spark, d):
    return _layout(spark, d).select("img", "min_height")


# --- occlusion ---------------------------------------------------------------------------------

_HIDDEN = """
hits AS (
  SELECT b.img, b.box, greatest(b.x1, o.x1) AS x1, greatest(b.y1, o.y1) AS y1, least(b.x2, o.x2) AS x2, least(b.y2, o.y2) AS y2
  FROM boxes b JOIN occluders o ON o.img = b.img AND b.x1 < o.x2 AND o.x1 < b.x2 AND b.y1 < o.y2 AND o.y1 < b.y2),
lines AS (SELECT img, box, x1, x2, unnest(range(y1, y2)) AS y FROM hits),
spans AS (SELECT *, max(x2) OVER (PARTITION BY img, box, y ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM lines),
hidden AS (SELECT img, box, cast(sum(greatest(0, x2 - greatest(x1, coalesce(seen, x1)))) AS bigint) AS hidden FROM spans GROUP BY ALL)"""


@query(with_views("boxes occluders", """
SELECT b.img, b.box, coalesce(hidden, 0) AS hidden FROM boxes b LEFT JOIN hidden h ON h.img = b.img AND h.box = b.box""", _HIDDEN))
def hidden_pixels(spark, d):
    boxes = V.boxes(spark, d).select("img", "box", "x1", "y1", "x2", "y2")
    return occlusion.hidden_area(boxes, V.occluders(spark, d), ["img"]).select("img", "box", "hidden")


@query(with_views("boxes occluders", f"""
SELECT b.img, b.box FROM boxes b LEFT JOIN hidden h ON h.img = b.img AND h.box = b.box
WHERE coalesce(hidden, 0) / {area_sql('b')} < 0.85""", _HIDDEN))
def visible_labels(spark, d):
    boxes = V.boxes(spark, d).select("img", "box", "x1", "y1", "x2", "y2")
    return occlusion.visible_labels(
        boxes, V.occluders(spark, d), ["img"], V.WIDTH, V.HEIGHT).select("img", "box")


_CROWD_HIDDEN = """
boxes AS (SELECT img, box, x1 // 3 AS x1, y1 // 3 AS y1, x1 // 3 + x2 - x1 AS x2, y1 // 3 + y2 - y1 AS y2 FROM crowded),
occluders AS (SELECT img, x1 + 5 AS x1, y1 + 5 AS y1, x2 + 5 AS x2, y2 + 5 AS y2 FROM boxes WHERE box % 2 = 0),
hits AS (
  SELECT b.img, b.box, greatest(b.x1, o.x1) AS x1, greatest(b.y1, o.y1) AS y1, least(b.x2, o.x2) AS x2, least(b.y2, o.y2) AS y2
  FROM (SELECT *, unnest([x1 // 400, x1 // 400 + 1, x1 // 400 + 2]) AS t FROM boxes) b
  JOIN (SELECT *, x1 // 400 + 1 AS t FROM occluders) o ON o.img = b.img AND o.t = b.t
  WHERE b.x1 < o.x2 AND o.x1 < b.x2 AND b.y1 < o.y2 AND o.y1 < b.y2),
""" + _HIDDEN[_HIDDEN.index("lines AS"):]


@query(with_views("crowded", """
SELECT b.img, b.box, coalesce(hidden, 0) AS hidden FROM boxes b LEFT JOIN hidden h ON h.img = b.img AND h.box = b.box""", _CROWD_HIDDEN))
def crowded_hidden_pixels(spark, d):
    """Hidden area on hot canvases, three times as dense as the other crowded queries."""
    c = F.col
    x, y = F.expr("x1 div 3"), F.expr("y1 div 3")
    # Read several times, so derived once and written.
    boxes = durable(V.crowded(spark, d).select(
        "img", "box", x.alias("x1"), y.alias("y1"), (x + c("x2") - c("x1")).alias("x2"), (y + c("y2") - c("y1")).alias("y2")), "boxes")
    over = boxes.filter(c("box") % 2 == 0).select("img", *[(c(k) + 5).alias(k) for k in ("x1", "y1", "x2", "y2")])
    return occlusion.hidden_area(boxes, over, ["img"]).select("img", "box", "hidden")
