"""Streaming forms of the live loop, streamed counts and batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.operators.lookup import last_known, urls_by_name
from boxloom.plans.skew import join_on
from boxloom.session import scratch_path
from boxloom.streaming import counting, frames, live, ordered, scoring
from boxloom.streaming.drain import drain, use_rocksdb
from workload import views as V
from workload.stand_ins import batched, failing_stand_in, stand_in
from workload.register import query
from workload.planning_and_lookup import _URLS
from workload.views import greedy_sql, with_views


def live_frames(spark, d):
    """One row per viewed frame: pointer, and all detections of its image as an array."""
    found = V.boxes(spark, d).groupBy("img").agg(F.collect_list(F.struct(
        F.col("box").alias("box_no"), (F.col("cls") % 70).alias("class_id"), (F.col("score") / 1000).alias("score"),
        *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])).alias("boxes"))
    pointed = last_known(V.frames(spark, d), V.pointer(spark, d), "session_id", "ts", {"px": 0, "py": 0})
    return join_on(pointed, found, ["img"], "left").select(
        "session_id", "frame_no", "ts", "px", "py", "boxes")


def _stream(spark, d):
    """The frames as a stream of files."""
    path = scratch_path(spark, "frames")
    rows = live_frames(spark, d)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


_SHOWN = (
    greedy_sql("kept", """(
      SELECT img, box, cls % 70 AS class_id, score, x1, y1, x2, y2 FROM boxes WHERE score / 1000 >= 0.69)""", "img * 100 + class_id", 1, 2) + """,
capped AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY img ORDER BY score DESC, box) AS n FROM kept) WHERE n <= 300),
shown AS (SELECT * FROM capped WHERE (y2 - y1) / (x2 - x1) BETWEEN 0.6 AND 2.2 AND (x2 - x1) * (y2 - y1) / 2073600 BETWEEN 0.004 AND 0.15),
per_image AS (SELECT img, count(*) AS n_shown FROM shown GROUP BY 1),
view AS (
  SELECT p.session_id, p.frame_no, coalesce(n_shown, 0)::int AS n_shown, h.box AS box_no, h.class_id,
         greatest(0, least(h.x1, 1920 - 300)) AS preview_x, greatest(0, least(h.y2 + 10, 1080 - 420)) AS preview_y, h.x1
  FROM pointed p LEFT JOIN per_image USING (img) LEFT JOIN (
    SELECT frame_no, min_by(s, s.n) AS h FROM (
      SELECT frame_no, s FROM pointed p JOIN shown s ON s.img = p.img AND p.px BETWEEN s.x1 AND s.x2 AND p.py BETWEEN s.y1 AND s.y2)
    GROUP BY 1) USING (frame_no))""")


@query(with_views("boxes pointed registry", """
SELECT session_id, frame_no, n_shown, box_no, v.class_id, CASE WHEN box_no IS NOT NULL THEN preview_x END AS preview_x,
       CASE WHEN box_no IS NOT NULL THEN preview_y END AS preview_y, coalesce(name, cast(v.class_id AS varchar)) AS label
FROM view v LEFT JOIN registry r ON r.class_id = v.class_id""", _SHOWN))
def live_view(spark, d):
    names = V.registry(spark, d)
    return drain(live.live_view(_stream(spark, d), names, V.WIDTH, V.HEIGHT), "live-view").drop("ts")


@query(with_views("boxes pointed registry printings", """
SELECT session_id, frame_no, r.name AS label, image_url FROM view v JOIN registry r ON r.class_id = v.class_id
JOIN urls u ON u.class_id = v.class_id""", _SHOWN + "," + _URLS))
def preview_links(spark, d):
    """Hovered frames of named classes with the URL of the card image."""
    names = V.registry(spark, d)
    view = live.live_view(_stream(spark, d), names, V.WIDTH, V.HEIGHT)
    linked = live.preview_links(view, names, V.catalog(spark, d))
    return drain(linked, "preview-links").join(
        names.select(F.col("name").alias("label")), "label", "left_semi").select(
        "session_id", "frame_no", "label", "image_url")


@query(with_views("boxes pointed registry printings", """
SELECT DISTINCT image_url FROM view v JOIN urls u ON u.class_id = v.class_id WHERE image_url IS NOT NULL""", _SHOWN + "," + _URLS))
def first_fetches(spark, d):
    """The URLs the live loop has to fetch, each once."""
    names = V.registry(spark, d)
    view = live.live_view(_stream(spark, d), names, V.WIDTH, V.HEIGHT)
    uses = live.first_uses(live.preview_links(view, names, V.catalog(spark, d)))
    return drain(uses, "first-fetches").select("image_url")


_SHARE = """(greatest(0, least(b.x2, f.rx + 300, 1920) - greatest(b.x1, f.rx, 0)) *
  greatest(0, least(b.y2, f.ry + 420, 1080) - greatest(b.y1, f.ry, 0)) / ((b.x2 - b.x1) * (b.y2 - b.y1)))"""

_MEMORY = _SHOWN + "," + _URLS + f""",
per_frame AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_no) AS rn FROM (
  SELECT p.session_id, p.frame_no, px, py, coalesce(list({{'box': s.box, 'class_id': s.class_id, 'x1': s.x1, 'y1': s.y1, 'x2': s.x2, 'y2': s.y2, 'linked': u.image_url IS NOT NULL}}
                       ORDER BY s.n) FILTER (s.box IS NOT NULL), []) AS shown
  FROM pointed p LEFT JOIN shown s ON s.img = p.img LEFT JOIN urls u ON u.class_id = s.class_id GROUP BY ALL)),
memory AS (
  SELECT session_id, 0::bigint AS rn, 0::bigint AS frame_no, 0::bigint AS n_seen, 0::bigint AS n_hidden, NULL::bigint AS box_no,
         NULL::bigint AS class_id, false AS fresh, NULL::bigint AS rx, NULL::bigint AS ry
  FROM (SELECT DISTINCT session_id FROM per_frame)
  UNION ALL
  SELECT session_id, rn, frame_no, len(seen), len(shown) - len(seen), hit.box, hit.class_id, coalesce(hit.linked, false),
         CASE WHEN hit.linked THEN greatest(0, least(hit.x1, 1920 - 300)) ELSE rx END,
         CASE WHEN hit.linked THEN greatest(0, least(hit.y2 + 10, 1080 - 420)) ELSE ry END
  FROM (SELECT *, list_filter(seen, lambda b: px BETWEEN b.x1 AND b.x2 AND py BETWEEN b.y1 AND b.y2)[1] AS hit FROM (
    SELECT s.*, f.rx, f.ry, list_filter(s.shown, lambda b: f.rx IS NULL OR {_SHARE} < 0.5) AS seen
    FROM memory f JOIN per_frame s ON s.session_id = f.session_id AND s.rn = f.rn + 1)))"""


@query(with_views("boxes pointed registry printings", """
SELECT session_id, frame_no, n_seen, n_hidden, box_no, class_id, CASE WHEN fresh THEN rx END AS overlay_x,
       CASE WHEN fresh THEN ry END AS overlay_y, 0::bigint AS late FROM memory WHERE rn > 0""", _MEMORY))
def overlay_memory(spark, d):
    """Boxes under the last overlay are hidden; classes with a card image leave an overlay."""
    use_rocksdb(spark)
    linked = urls_by_name(V.registry(spark, d), V.catalog(spark, d)).filter(F.col("image_url").isNotNull())
    if linked.limit(live.MAX_PREVIEW_CLASSES + 1).count() > live.MAX_PREVIEW_CLASSES:
        raise ValueError("too many classes to send to every task")
    ids = frozenset(r["class_id"] for r in linked.select("class_id").collect())
    frames = _stream(spark, d).withColumn(
        "shown", live.frame_boxes(F.col("boxes"), V.WIDTH, V.HEIGHT))
    return drain(live.remember_overlay(frames, live.OverlayMemory(ids, V.WIDTH, V.HEIGHT)), "overlay")


def _written_stream(spark, rows, label):
    """Rows in an order that has nothing to do with their time, as a stream of files."""
    path = scratch_path(spark, label)
    rows.orderBy(F.xxhash64(*rows.columns[:3])).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _with_end(rows, delay: str):
    """A last row, of no session that has others, which lets the watermark pass all of them."""
    last = rows.agg((F.max("ts") + F.expr(f"INTERVAL {delay}") * 2).alias("ts"))
    return rows.unionByName(last.withColumn("session_id", F.lit(-1).cast("bigint")), allowMissingColumns=True)


_DELAY = "400 DAYS"


@query(with_views("boxes pointed registry printings", """
SELECT session_id, frame_no, n_seen, n_hidden, box_no, class_id, CASE WHEN fresh THEN rx END AS overlay_x,
       CASE WHEN fresh THEN ry END AS overlay_y, 0::bigint AS late FROM memory WHERE rn > 0""", _MEMORY))
def overlay_of_shuffled_frames(spark, d):
    """``overlay_memory`` over frames that arrive in any order: they wait for the watermark."""
    use_rocksdb(spark)
    linked = urls_by_name(V.registry(spark, d), V.catalog(spark, d)).filter(F.col("image_url").isNotNull())
    if linked.limit(live.MAX_PREVIEW_CLASSES + 1).count() > live.MAX_PREVIEW_CLASSES:
        raise ValueError("too many classes to send to every task")
    ids = frozenset(r["class_id"] for r in linked.select("class_id").collect())
    frames = _written_stream(spark, _with_end(live_frames(spark, d), _DELAY), "shuffled")
    shown = frames.withColumn("shown", live.frame_boxes(F.col("boxes"), V.WIDTH, V.HEIGHT))
    return drain(ordered.overlay_in_order(shown, live.OverlayMemory(ids, V.WIDTH, V.HEIGHT), _DELAY), "overlay")


@query(with_views("pointed", "SELECT session_id, frame_no, px, py FROM pointed"))
def streamed_pointer_at_frame(spark, d):
    """The as-of pointer from a stream of pointer events and one of frames."""
    use_rocksdb(spark)
    frames = _with_end(V.frames(spark, d).select("session_id", "frame_no", "ts"), _DELAY)
    pointers = _with_end(V.pointer(spark, d), _DELAY)
    return drain(ordered.pointer_at_frames(
        _written_stream(spark, frames, "frames"), _written_stream(spark, pointers, "pointer"), _DELAY), "pointed")


@query(with_views("boxes frames", """
SELECT session_id, frame_no, ts, true AS complete, count(box) AS n_boxes, coalesce(sum(box), 0)::bigint AS box_sum,
       coalesce(sum(x2 - x1), 0)::double AS widths FROM frames LEFT JOIN (SELECT img, box % 1000000007 AS box, x1, x2 FROM boxes) USING (img) GROUP BY ALL"""))
def assembled_frames(spark, d):
    """Frames from detection rows and heartbeats; some frames have no boxes."""
    use_rocksdb(spark)
    shown = V.frames(spark, d)
    found = V.boxes(spark, d).select("img", (F.col("box") % 1000000007).alias("box_no"), (F.col("cls") % 70).alias("class_id"),
                                     (F.col("score") / 1000).alias("score"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    sizes = found.groupBy("img").agg(F.count(F.lit(1)).alias("n_boxes"))
    beats = join_on(shown, sizes, ["img"], "left").select("session_id", "frame_no", "ts", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"))
    rows = join_on(shown, found, ["img"]).drop("img")
    out = drain(frames.assemble_frames(
        _written_stream(spark, rows, "detections"), _written_stream(spark, beats, "heartbeats"), _DELAY), "assembled")
    summed = lambda of: F.aggregate(F.transform("boxes", of), F.lit(0.0), lambda a, b: a + b)
    return out.select("session_id", "frame_no", "ts", "complete", F.size("boxes").cast("bigint").alias("n_boxes"),
                      summed(lambda b: b["box_no"].cast("double")).cast("bigint").alias("box_sum"),
                      summed(lambda b: b["x2"] - b["x1"]).alias("widths"))


@query(with_views("label_counts", "SELECT split, class_id, n FROM label_counts"))
def streamed_coverage(spark, d):
    """Label counts kept by a stream over the label source."""
    source = V.table(spark, d, "lineitem")
    stream = spark.readStream.schema(source.schema).option(
        "pathGlobFilter", "lineitem.parquet").parquet(d)
    labels = V.boxes_of(stream).select(
        V.split_of(F.col("img")).alias("split"), (F.col("cls") % 70).alias("class_id"))
    path = scratch_path(spark, "counts")
    counting.write_counts(labels, f"{path}/tables", f"{path}/progress").awaitTermination()
    return counting.latest_counts(spark, f"{path}/tables")


# --- scoring -----------------------------------------------------------------------------------------

_SCORED = """
SELECT image_id, box_no, class_id, score, x1, y1, x2, y2 FROM (
  SELECT doc_id AS image_id, 1 AS box_no, n % 10 AS class_id, n % 1000 / 1000 AS score, (n % 300)::double AS x1, (n % 200)::double AS y1,
         (n % 300 + 60 + n % 50)::double AS x2, (n % 200 + 90 + n % 70)::double AS y2, n FROM (SELECT doc_id, length(text) AS n FROM documents)
  UNION ALL SELECT doc_id, 2, 1, 0.5, 10.0, 20.0, 110.0, 160.0, n FROM (SELECT doc_id, length(text) AS n FROM documents) WHERE n % 2 = 0)
WHERE n % 10 <> 4"""


def _contents(spark, d):
    return V.table(spark, d, "documents").select(
        F.col("doc_id").alias("image_id"), F.col("text").alias("content"))


@query(_SCORED)
def scored_images(spark, d):
    return scoring.score(_contents(spark, d), stand_in)


@query(_SCORED + " AND n % 10 <> 3")
def scored_despite_failures(spark, d):
    return scoring.score(_contents(spark, d), failing_stand_in, on_error="empty")


@query(_SCORED)
def scored_in_batches(spark, d):
    return scoring.score_batches(_contents(spark, d), batched(stand_in))


@query(_SCORED + " AND n % 10 <> 3")
def batches_despite_failures(spark, d):
    """Every batch with a bad image fails; the others of the batch are scored."""
    return scoring.score_batches(_contents(spark, d), batched(failing_stand_in), on_error="empty")
