"""Split and class planning, file picks, lookups, hover and the as-of pointer."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions import names as N
from boxloom.operators import lookup, planning
from boxloom.operators.suppress import kept_per_group
from boxloom.plans import generation
from boxloom.sources import catalog, images
from workload import views as V
from workload.boxes_and_layout import by_score
from workload.register import query
from workload.views import greedy_sql, with_views


# --- splits ------------------------------------------------------------------------------------

@query(with_views("images", """
SELECT stem, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'valid' ELSE 'test' END AS split FROM (
  SELECT stem, row_number() OVER (ORDER BY md5('s7|' || stem), stem) AS rn,
         cast(trunc(0.7::double * count(*) OVER ()) AS bigint) AS a, cast(trunc(0.2::double * count(*) OVER ()) AS bigint) AS b FROM images)"""))
def exact_split(spark, d):
    return planning.split_files(V.images(spark, d).select("stem"), "stem", "s7")


def _image_counts(spark, d):
    rows = V.images(spark, d).groupBy("split").count().collect()
    return {r["split"]: r["count"] for r in rows}


_SEATS = """
seats AS (
  SELECT split, place, (n + k) * step AS due FROM (
    SELECT *, unnest(range(0, (SELECT count(*) FROM part))) AS k FROM (
      SELECT s.split, s.step, s.place, (SELECT count(*) FROM images i WHERE i.split = s.split) AS n
      FROM (VALUES ('train', 2, 0), ('valid', 7, 1), ('test', 14, 2)) s(split, step, place)))),
quota AS (
  SELECT image_no, split FROM (SELECT split, row_number() OVER (ORDER BY due, place) - 1 AS image_no FROM seats)
  WHERE image_no < (SELECT count(*) FROM part))"""


def _quota(spark, d):
    """One new image per card, on top of the images there are."""
    wanted = V.table(spark, d, "part").count()
    return planning.split_quota(spark, wanted, _image_counts(spark, d))


@query(with_views("images", "SELECT image_no, split FROM quota", _SEATS))
def split_quota(spark, d):
    return _quota(spark, d)


# --- files and picks ---------------------------------------------------------------------------

@query(with_views("image_paths images truth", """
SELECT split, stem FROM images JOIN image_paths USING (img)
WHERE regexp_matches(lower(path), '\\.(png|jpg)$') AND img IN (SELECT img FROM truth)"""))
def template_pairs(spark, d):
    """PNG and JPG images with a label file, which those with truth boxes have."""
    found = images.split_images(V.image_paths(spark, d), images.TEMPLATE_IMAGES).select("split", "stem")
    files = V.truth(spark, d).select("img").distinct().select(
        V.split_of(F.col("img")).alias("split"), F.concat(F.lit("img_"), F.col("img").cast("string")).alias("stem"))
    return planning.template_pairs(found, files)


@query(with_views("images parsed", """
SELECT a.stem, a.split, box_no, class_id FROM (
  SELECT stem, CASE WHEN rn <= 0.7::double * n // 1 THEN 'train' WHEN rn <= (0.7::double * n // 1) + (0.2::double * n // 1) THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT stem, row_number() OVER (ORDER BY md5('s7|' || stem), stem) AS rn, count(*) OVER () AS n FROM images)) a
LEFT JOIN parsed p ON p.stem = a.stem"""))
def labels_by_assignment(spark, d):
    from boxloom.operators.labels import parse_lines

    assigned = planning.split_files(V.images(spark, d).select("stem"), "stem", "s7")
    found = parse_lines(V.label_lines(spark, d)).select("stem", "box_no", "class_id")
    return planning.carry_labels(assigned, found)


_WANTED = "SELECT regexp_replace(replace(name, ' ', '_'), '[^A-Za-z0-9_-]', '', 'g') || '_' || id || '.png' AS file, card_no, pos FROM printings"


def _wanted(spark, d):
    rows = catalog.printings(V.catalog(spark, d))
    return rows.select(N.image_file_name(F.col("name"), F.col("id")).alias("file"), "card_no", "pos")


def _present(spark, d):
    return images.set_images(V.card_files(spark, d)).select("file").distinct()


@query(with_views("printings named_files", f"SELECT * FROM ({_WANTED}) WHERE file NOT IN (SELECT file FROM named_files)"))
def pending_files(spark, d):
    return planning.pending_files(_wanted(spark, d), _present(spark, d))


@query(with_views("printings named_files", f"SELECT count(*) AS present FROM ({_WANTED}) WHERE file IN (SELECT file FROM named_files)"))
def present_files(spark, d):
    return planning.present_files(_wanted(spark, d), _present(spark, d)).agg(F.count(F.lit(1)).alias("present"))


_FILES = f"""
SELECT {V._CANON} AS name, row_number() OVER (PARTITION BY {V._CANON} ORDER BY md5('s3|' || set_code || '|' || file), set_code, file) - 1 AS file_no,
       set_code, file, count(*) OVER (PARTITION BY {V._CANON}) AS files FROM named_files"""


@query(with_views("named_files", _FILES))
def class_files(spark, d):
    return planning.class_files(images.set_images(V.card_files(spark, d)), "s3")


@query(with_views("labels registry named_files", f"""
SELECT stem, box_no, name, set_code, file FROM (
  SELECT stem, box_no, r.name, ('0x' || substr(md5('s4|' || stem || '|' || cast(box_no AS varchar)), 1, 8))::bigint % z.files AS file_no
  FROM labels l JOIN registry r USING (class_id) JOIN (SELECT name, count(*) AS files FROM (SELECT {V._CANON} AS name FROM named_files) GROUP BY 1) z ON z.name = r.name) s
JOIN ({_FILES}) f USING (name, file_no)"""))
def seeded_picks(spark, d):
    """A card file of the right class for every label."""
    named = V.labels(spark, d).select("stem", "box_no", "class_id").join(V.registry(spark, d), "class_id")
    pool = planning.class_files(images.set_images(V.card_files(spark, d)), "s3")
    return planning.draw(named.select("stem", "box_no", "name"), pool, ["name"], "file_no", "files",
                         "s4", ["stem", "box_no"], on_miss="drop").select("stem", "box_no", "name", "set_code", "file")


@query(with_views("images", """
SELECT split, min_by(stem, md5('s5|' || stem)) AS stem FROM images GROUP BY 1"""))
def one_template_per_split(spark, d):
    return planning.pick_one(V.images(spark, d).select("split", "stem"), ["split"], "s5", ["stem"])


@query(with_views("printings", """
SELECT card_no, pos, id, image_url, name FROM (
  SELECT *, row_number() OVER (PARTITION BY card_no ORDER BY pos) AS rn FROM printings WHERE set_id = 'HVY' AND image_url IS NOT NULL) WHERE rn = 1"""))
def first_usable_printings(spark, d):
    return planning.first_usable_printing(catalog.printings(V.catalog(spark, d)), "hvy")


@query(with_views("printings named_files", """
SELECT card_no, name, id, image_url, file FROM (
  SELECT *, row_number() OVER (PARTITION BY card_no ORDER BY pos) AS rn,
         regexp_replace(replace(name, ' ', '_'), '[^A-Za-z0-9_-]', '', 'g') || '_' || id || '.png' AS file
  FROM printings WHERE set_id = 'HVY' AND image_url IS NOT NULL)
WHERE rn = 1 AND file NOT IN (SELECT file FROM named_files)"""))
def download_list(spark, d):
    """The images of one set that are still to be fetched."""
    return planning.download_list(catalog.printings(V.catalog(spark, d)), "hvy", _present(spark, d))


# --- class planning ------------------------------------------------------------------------------

@query(with_views("counts_so_far", """
SELECT split, class_id, name, n, total FROM (SELECT * FROM counts_so_far WHERE split = 'valid' ORDER BY n, total, class_id LIMIT 20)"""))
def lowest_classes(spark, d):
    return planning.lowest_classes(V.counts_so_far(spark, d), "valid", 20)


_SLOTS = "SELECT split, 2 * count(*) AS slots FROM images GROUP BY 1"
_QUOTA = f"""
wanted AS ({_SLOTS}),
sorted AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS s FROM counts_so_far WINDOW w AS (PARTITION BY split ORDER BY n, class_id)),
levels AS (
  SELECT split, n + (slots - (i * n - s)) // i AS lvl, (slots - (i * n - s)) % i AS extra FROM (
    SELECT *, row_number() OVER (PARTITION BY split ORDER BY i DESC) AS best
    FROM sorted JOIN wanted USING (split) WHERE i * n - s <= slots) WHERE best = 1),
quotas AS (
  SELECT split, class_id, n, total, cast(lvl - n + CASE WHEN r <= extra THEN 1 ELSE 0 END AS bigint) AS quota FROM (
    SELECT c.*, lvl, extra, row_number() OVER (PARTITION BY split
      ORDER BY total, md5('s6|' || split || '|' || cast(class_id AS varchar)), class_id) AS r
    FROM counts_so_far c JOIN levels USING (split) WHERE n <= lvl))"""


def _class_quota(spark, d):
    slots = V.images(spark, d).groupBy("split").agg((F.count(F.lit(1)) * 2).alias("slots"))
    counts = V.counts_so_far(spark, d).select("split", "class_id", "n", "total")
    return planning.class_quota(counts, slots, "s6")


@query(with_views("counts_so_far images", "SELECT split, class_id, n, total, quota FROM quotas WHERE quota > 0", _QUOTA))
def class_quota(spark, d):
    """Two labels more per image: how many each class gets."""
    return _class_quota(spark, d)


@query(with_views("counts_so_far images", """
SELECT split, row_number() OVER (PARTITION BY split ORDER BY level, total,
         md5('s6|' || split || '|' || cast(class_id AS varchar)), class_id) - 1 AS slot_no, class_id, level, level < 100 AS makeup
FROM (SELECT split, class_id, total, n + unnest(range(0, quota)) AS level FROM quotas WHERE quota > 0)""", _QUOTA))
def class_seats(spark, d):
    return planning.class_seats(_class_quota(spark, d), "s6", makeup_min=100)


_MANY = _QUOTA.replace(_SLOTS, _SLOTS.replace("2 *", "20 *"))


@query(with_views("counts_so_far images", """
SELECT split, level, class_id, count(*) AS seats, min(slot_no) AS first_slot, sum(slot_no)::bigint AS slots FROM (
  SELECT split, row_number() OVER (PARTITION BY split ORDER BY level, total,
           md5('s6|' || split || '|' || cast(class_id AS varchar)), class_id) - 1 AS slot_no, class_id, level
  FROM (SELECT split, class_id, total, n + unnest(range(0, quota)) AS level FROM quotas WHERE quota > 0)) GROUP BY ALL""", _MANY))
def seats_at_tenfold(spark, d):
    """Ten times the slots of ``class_seats``: who sits at each level, and where."""
    slots = V.images(spark, d).groupBy("split").agg((F.count(F.lit(1)) * 20).alias("slots"))
    counts = V.counts_so_far(spark, d).select("split", "class_id", "n", "total")
    return planning.class_seats(planning.class_quota(counts, slots, "s6"), "s6").groupBy("split", "level", "class_id").agg(
        F.count(F.lit(1)).alias("seats"), F.min("slot_no").alias("first_slot"), F.sum("slot_no").alias("slots"))


def _plan(spark, d):
    templates = V.images(spark, d).select("split", "stem")
    boxes = V.labels(spark, d).select("split", "stem", "box_no", "cx", "cy", "w", "h")
    counts = V.counts_so_far(spark, d).select("split", "class_id", "n", "total")
    return generation.plan_dataset(_quota(spark, d), templates, boxes, counts, "s9")


_PLAN = _SEATS + """,
pool AS (
  SELECT split, stem AS template, row_number() OVER (PARTITION BY split ORDER BY md5('s9|' || stem), stem) - 1 AS template_no,
         count(*) OVER (PARTITION BY split) AS templates FROM images),
drawn AS (
  SELECT image_no, q.split, template, (('0x' || substr(md5('s9-turn|' || cast(image_no AS varchar)), 1, 8))::bigint % 4) * 90 AS angle,
         'synthetic_' || cast(image_no AS varchar) || '_' || substr(md5('s9|' || cast(image_no AS varchar)), 1, 8) || '_' || template AS stem
  FROM quota q JOIN pool p ON p.split = q.split AND
    p.template_no = ('0x' || substr(md5('s9-template|' || cast(image_no AS varchar)), 1, 8))::bigint % p.templates),
slots AS (
  SELECT i.*, l.box_no, l.cx, l.cy, l.w, l.h,
         row_number() OVER (PARTITION BY i.split ORDER BY image_no, md5('s9|' || cast(l.box_no AS varchar)), box_no) - 1 AS slot_no
  FROM drawn i JOIN labels l ON l.stem = i.template AND l.split = i.split),
""" + _QUOTA.strip().replace(_SLOTS, "SELECT split, count(*) AS slots FROM slots GROUP BY 1").replace("'s6|'", "'s9|'") + """,
seated AS (
  SELECT split, class_id, row_number() OVER (PARTITION BY split ORDER BY level, total,
           md5('s9|' || split || '|' || cast(class_id AS varchar)), class_id) - 1 AS slot_no
  FROM (SELECT split, class_id, total, n + unnest(range(0, quota)) AS level FROM quotas WHERE quota > 0))"""


@query(with_views("images labels counts_so_far", "SELECT image_no, split, template, angle, stem FROM drawn", _PLAN))
def planned_images(spark, d):
    return _plan(spark, d).images


@query(with_views("images labels counts_so_far", """
SELECT image_no, split, stem, box_no, class_id, angle,
       CASE angle WHEN 90 THEN cy WHEN 180 THEN 1 - cx WHEN 270 THEN 1 - cy ELSE cx END AS cx,
       CASE angle WHEN 90 THEN 1 - cx WHEN 180 THEN 1 - cy WHEN 270 THEN cx ELSE cy END AS cy,
       CASE WHEN angle IN (90, 270) THEN h ELSE w END AS w, CASE WHEN angle IN (90, 270) THEN w ELSE h END AS h
FROM slots JOIN seated USING (split, slot_no)""", _PLAN))
def planned_labels(spark, d):
    return _plan(spark, d).labels


_TURNED = """CASE angle WHEN 90 THEN cy WHEN 180 THEN 1 - cx WHEN 270 THEN 1 - cy ELSE cx END AS cx,
       CASE angle WHEN 90 THEN 1 - cx WHEN 180 THEN 1 - cy WHEN 270 THEN cx ELSE cy END AS cy,
       CASE WHEN angle IN (90, 270) THEN h ELSE w END AS w, CASE WHEN angle IN (90, 270) THEN w ELSE h END AS h"""


@query(with_views("images labels counts_so_far named_files registry", f"""
SELECT s.image_no, s.split, s.stem, s.box_no, s.class_id, r.name, f.set_code, f.file
FROM (SELECT * FROM slots JOIN seated USING (split, slot_no)) s JOIN registry r USING (class_id)
JOIN ({_FILES.replace("'s3|'", "'s9|'")}) f ON f.name = r.name AND f.file_no =
  ('0x' || substr(md5('s9-file|' || cast(s.image_no AS varchar) || '|' || cast(s.box_no AS varchar)), 1, 8))::bigint % f.files""", _PLAN))
def planned_label_files(spark, d):
    """The plan guided by coverage, each label with a card file of its class."""
    templates = V.images(spark, d).select("split", "stem")
    boxes = V.labels(spark, d).select("split", "stem", "box_no", "cx", "cy", "w", "h")
    counts = V.counts_so_far(spark, d).select("split", "class_id", "n", "total")
    files = images.set_images(V.card_files(spark, d))
    plan = generation.plan_dataset(_quota(spark, d), templates, boxes, counts, "s9", registry=V.registry(spark, d), files=files)
    return plan.labels.select("image_no", "split", "stem", "box_no", "class_id", "name", "set_code", "file")


_DEFAULT = _SEATS + f""",
open_images AS (SELECT * FROM images WHERE split <> 'valid'),
pool AS (
  SELECT split, stem AS template, row_number() OVER (PARTITION BY split ORDER BY md5('s8|' || stem), stem) - 1 AS template_no,
         count(*) OVER (PARTITION BY split) AS templates FROM open_images),
drawn AS (
  SELECT image_no, p.split, template, (('0x' || substr(md5('s8-turn|' || cast(image_no AS varchar)), 1, 8))::bigint % 4) * 90 AS angle,
         'synthetic_' || cast(image_no AS varchar) || '_' || substr(md5('s8|' || cast(image_no AS varchar)), 1, 8) || '_' || template AS stem
  FROM quota q JOIN pool p ON p.split = CASE q.split WHEN 'valid' THEN 'train' ELSE q.split END AND
    p.template_no = ('0x' || substr(md5('s8-template|' || cast(image_no AS varchar)), 1, 8))::bigint % p.templates),
every_file AS (SELECT name, set_code, file, row_number() OVER (ORDER BY name, file_no) - 1 AS no FROM ({_FILES.replace("'s3|'", "'s8|'")})),
filled AS (
  SELECT i.image_no, i.split, i.stem, l.box_no, angle, l.cx, l.cy, l.w, l.h,
         ('0x' || substr(md5('s8-file|' || cast(image_no AS varchar) || '|' || cast(box_no AS varchar)), 1, 8))::bigint % (SELECT count(*) FROM every_file) AS no
  FROM drawn i JOIN labels l ON l.stem = i.template AND l.split = i.split)"""


def _plan_by_files(spark, d):
    """No template in one of the splits: its images take the first split that has some."""
    templates = V.images(spark, d).where("split <> 'valid'").select("split", "stem")
    boxes = V.labels(spark, d).select("split", "stem", "box_no", "cx", "cy", "w", "h")
    files = images.set_images(V.card_files(spark, d))
    return generation.plan_by_files(_quota(spark, d), templates, boxes, V.registry(spark, d), files, "s8")


@query(with_views("images labels named_files", "SELECT image_no, split, template, angle, stem FROM drawn", _DEFAULT))
def file_planned_images(spark, d):
    return _plan_by_files(spark, d).images


@query(with_views("images labels named_files registry", f"""
SELECT image_no, split, stem, box_no, class_id, angle, name, set_code, file, {_TURNED}
FROM filled JOIN every_file USING (no) JOIN registry USING (name)""", _DEFAULT))
def file_planned_labels(spark, d):
    return _plan_by_files(spark, d).labels


# --- lookups --------------------------------------------------------------------------------------

_URLS = """
usable AS (
  SELECT p.card_no, lower(trim(p.name)) AS k, regexp_replace(lower(trim(p.name)), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS l, image_url
  FROM printings p WHERE pos = 0),
asked AS (
  SELECT class_id, name, lower(trim(replace(name, '_', ' '))) AS k,
         regexp_replace(lower(trim(replace(name, '_', ' '))), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS l FROM registry),
urls AS (
  SELECT class_id, a.name, min(u.card_no) AS card_no, arg_min_null(u.image_url, u.card_no) AS image_url
  FROM asked a LEFT JOIN usable u ON u.k = a.k OR u.l = a.l GROUP BY 1, 2)"""


@query(with_views("registry printings", "SELECT class_id, name, card_no, image_url FROM urls", _URLS))
def urls_by_name(spark, d):
    return lookup.urls_by_name(V.registry(spark, d), V.catalog(spark, d))


@query(with_views("printings", """
SELECT p_partkey, a.id, h.image_url FROM (SELECT p_partkey, lower('hvy' || lpad(cast(p_partkey % 1100 AS varchar), 3, '0')) AS id FROM part) a
LEFT JOIN (SELECT upper(id) AS key, arg_min_null(image_url, card_no) AS image_url FROM printings GROUP BY 1) h ON h.key = upper(a.id)"""))
def urls_by_id(spark, d):
    ids = V.table(spark, d, "part").select("p_partkey", F.concat(
        F.lit("hvy"), F.lpad((F.col("p_partkey") % 1100).cast("string"), 3, "0")).alias("id"))
    return lookup.urls_by_id(ids, catalog.printings(V.catalog(spark, d)))


def _pointed(spark, d):
    return lookup.last_known(V.frames(spark, d), V.pointer(spark, d), "session_id", "ts", {"px": 0, "py": 0})


@query(with_views("pointed", "SELECT session_id, frame_no, px, py FROM pointed"))
def pointer_at_frame(spark, d):
    return _pointed(spark, d).select("session_id", "frame_no", "px", "py")


@query(with_views("boxes pointed", """
SELECT session_id, frame_no, box, cls FROM (
  SELECT p.session_id, p.frame_no, k.box, k.cls, row_number() OVER (PARTITION BY p.frame_no ORDER BY k.score DESC, k.box) AS rn
  FROM pointed p LEFT JOIN kept k ON k.img = p.img AND p.px BETWEEN k.x1 AND k.x2 AND p.py BETWEEN k.y1 AND k.y2) WHERE rn = 1""",
                  greedy_sql("kept", "boxes", "img", 1, 2)))
def hovered_boxes(spark, d):
    boxes = V.boxes(spark, d).select("img", "box", "cls", "score", "x1", "y1", "x2", "y2")
    kept = kept_per_group(boxes, ["img"], by_score(), 0.5, 300)
    return lookup.hovered_boxes(_pointed(spark, d), kept, ["img"]).select(
        "session_id", "frame_no", "hit.box", "hit.cls")
