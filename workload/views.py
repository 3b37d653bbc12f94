"""Derived inputs of the registered queries, for both engines.

Each view is given twice: as a DataFrame over the shared tables, and as the text of a
common table expression for the SQL side. Only integers and texts are derived, besides
quotients of integers, which both engines round alike. No view needs a window: a box is
numbered by a digest of its row, so a hot order is never gathered to count its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.session import SPLITS, durable

WIDTH, HEIGHT = 1920, 1080
SETS = ("SEA", "WTR", "HVY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def boxes_of(lineitem: DataFrame, *more: Column) -> DataFrame:
    c = F.col
    quantity = c("l_quantity").cast("bigint")
    cents = F.round(c("l_extendedprice") * 100).cast("bigint")
    key = F.md5(F.concat_ws("|", *[_text(x) for x in (
        c("l_orderkey"), c("l_linenumber"), c("l_partkey"), c("l_suppkey"), cents, quantity)]))
    bw = 60 + quantity * 2
    percent = 60 + (c("l_partkey") * 7 + c("l_linenumber") * 13) % 140
    bh = F.floor(bw * percent / 100).cast("bigint")
    x1 = 300 + (c("l_partkey") * 37) % 120
    y1 = 200 + (c("l_suppkey") * 53 + c("l_linenumber") * 17) % 120
    # Never null, so joins and filters on these columns add no checks that compute them again.
    def sure(value: Column) -> Column:
        return F.coalesce(value, F.lit(0).cast("bigint"))

    return lineitem.select(
        c("l_orderkey").alias("img"),
        sure(F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")).alias("box"),
        sure(c("l_partkey")).alias("cls"), sure(cents % 1000).alias("score"),
        sure(bw).alias("bw"), sure(bh).alias("bh"), sure(x1).alias("x1"), sure(y1).alias("y1"),
        sure(x1 + bw).alias("x2"), sure(y1 + bh).alias("y2"), *more)


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxes_of(table(spark, d, "lineitem"))


def crowded(spark: SparkSession, d: str) -> DataFrame:
    """All boxes on as many large canvases as there are line numbers: every image is hot."""
    b = boxes_of(table(spark, d, "lineitem"), F.col("l_linenumber").cast("bigint").alias("page"))
    x, y = F.col("box") % 30000, F.expr("box div 30000") % 30000
    return b.select(F.col("page").alias("img"), "box", "cls", "score", x.alias("x1"), y.alias("y1"),
                    (x + F.col("bw")).alias("x2"), (y + F.col("bh")).alias("y2"))


def split_of(img: Column) -> Column:
    return F.when(img % 10 < 7, "train").when(img % 10 < 9, "valid").otherwise("test")


def cards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    code = F.when(k % 3 == 0, "SEA").when(k % 3 == 1, "WTR").otherwise("HVY")
    return table(spark, d, "part").select(
        k.alias("card_no"), F.col("p_name").alias("name"), code.alias("set_code"),
        F.concat(F.translate("p_name", " ", "_"), F.lit("_"), code,
                 F.lpad(_text(k % 1000), 3, "0")).alias("raw_name"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Cards with nested printings; some lack a set, some printings have no URL."""
    k = F.col("card_no")

    def printing(i: int, s: str) -> Column:
        return F.when((k + i) % 4 != 0, F.struct(
            F.concat(F.lit(s), F.lpad(_text(k % 1000), 3, "0")).alias("id"), F.lit(s).alias("set_id"),
            F.when(k % 7 != 0, F.concat_ws("/", F.lit("u"), F.lit(s), _text(k))).alias("image_url")))

    listed = F.filter(F.array(*[printing(i, s) for i, s in enumerate(SETS)]), lambda p: p.isNotNull())
    return cards(spark, d).select("card_no", "name", listed.alias("printings"))


def card_files(spark: SparkSession, d: str) -> DataFrame:
    """Paths of card images; some in capitals, some of another kind."""
    k = F.col("card_no")
    kind = F.when(k % 11 == 0, ".PNG").when(k % 11 == 1, ".jpg").otherwise(".png")
    return cards(spark, d).select(
        "card_no", F.concat(F.lit("images/"), F.col("set_code"), F.lit("/"), F.col("raw_name"), kind).alias("path"))


def known_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class list of an earlier run: it knew all sets but the last."""
    return cards(spark, d).filter(F.col("set_code") != SETS[2]).select(F.col("card_no").alias("pos"), "raw_name")


def images(spark: SparkSession, d: str) -> DataFrame:
    """One row per image that has boxes."""
    return boxes(spark, d).select("img").distinct().select(
        "img", split_of(F.col("img")).alias("split"), F.concat(F.lit("img_"), _text(F.col("img"))).alias("stem"))


def image_paths(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("img") % 13 == 0, ".JPG").when(F.col("img") % 13 == 1, ".bmp").when(
        F.col("img") % 13 == 2, ".jpeg").otherwise(".png")
    return images(spark, d).select(
        "img", F.concat(F.lit("set/"), F.col("split"), F.lit("/images/"), F.col("stem"), kind).alias("path"))


def label_lines(spark: SparkSession, d: str) -> DataFrame:
    """Label lines; some with four tokens, some with a bad class, some with an unknown class."""
    def part(value: Column, size: int) -> Column:
        return F.concat(F.lit(" 0."), F.lpad(_text(F.floor(value * 1000000 / size).cast("bigint")), 6, "0"))

    c = F.col
    odd = c("img") + c("box") % 1000
    cls = F.when(odd % 97 == 0, "x").otherwise(_text(c("cls") % 70))
    line = F.concat(
        cls, part(c("x1") + c("x2"), 2 * WIDTH), part(c("y1") + c("y2"), 2 * HEIGHT), part(c("bw"), WIDTH),
        F.when(odd % 89 == 0, "").otherwise(part(c("bh"), HEIGHT)))
    return boxes(spark, d).select(
        split_of(c("img")).alias("split"), F.concat(F.lit("img_"), _text(c("img"))).alias("stem"),
        c("box").alias("line_no"), line.alias("line"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels as numbers, with the image they belong to."""
    c = F.col
    return boxes(spark, d).select(
        "img", split_of(c("img")).alias("split"), F.concat(F.lit("img_"), _text(c("img"))).alias("stem"),
        c("box").alias("box_no"), (c("cls") % 70).alias("class_id"),
        ((c("x1") + c("x2")) / (2 * WIDTH)).alias("cx"), ((c("y1") + c("y2")) / (2 * HEIGHT)).alias("cy"),
        (c("bw") / WIDTH).alias("w"), (c("bh") / HEIGHT).alias("h"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).filter(F.col("box") % 3 != 0).select(
        "img", "box", (F.col("cls") % 20).alias("cls"), "x1", "y1", "x2", "y2")


def preds(spark: SparkSession, d: str) -> DataFrame:
    """Predictions: shifted, some missing, some of a wrong class."""
    c = F.col
    dx, dy = c("cls") % 9 - 4, c("img") % 7 - 3
    return boxes(spark, d).filter(c("score") % 8 != 1).select(
        "img", "box",
        F.when(c("score") % 10 == 0, (c("cls") + 1) % 20).otherwise(c("cls") % 20).alias("cls"), "score",
        (c("x1") + dx).alias("x1"), (c("y1") + dy).alias("y1"),
        (c("x2") + dx).alias("x2"), (c("y2") + dy).alias("y2"))


#: Boxes of an image and class above which the queries on crowded canvases call it hot.
CROWD_LIMIT = 200


def crowded_truth(boxes: DataFrame) -> DataFrame:
    """Truth among the boxes of ``crowded``."""
    return boxes.filter(F.col("box") % 3 != 0).select(
        "img", "box", (F.col("cls") % 2).alias("cls"), "x1", "y1", "x2", "y2")


def crowded_preds(boxes: DataFrame) -> DataFrame:
    """Predictions from the boxes of ``crowded``."""
    c = F.col
    dx, dy = c("cls") % 9 - 4, c("cls") % 7 - 3
    return boxes.filter(c("score") % 8 != 1).select(
        "img", "box", (c("cls") % 2).alias("cls"), "score", (c("x1") + dx).alias("x1"), (c("y1") + dy).alias("y1"),
        (c("x2") + dx).alias("x2"), (c("y2") + dy).alias("y2"))


def occluders(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return boxes(spark, d).filter(c("box") % 2 == 0).select(
        "img", c("box").alias("occ_no"), (c("x1") + 5).alias("x1"), (c("y1") + 5).alias("y1"),
        (c("x1") + 5 + c("bw")).alias("x2"), (c("y1") + 5 + c("bh")).alias("y2"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Viewed frames, spread over all images: there are three images for two events."""
    c = F.col
    return table(spark, d, "events").filter(c("event_type") == "view").select(
        c("user_id").alias("session_id"), c("event_id").alias("frame_no"),
        c("ts").cast("timestamp").alias("ts"), F.floor(c("event_id") * 3 / 2).alias("img"))


def pointer(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "events").filter(c("event_type") == "click").select(
        c("user_id").alias("session_id"), "event_id", c("ts").cast("timestamp").alias("ts"),
        (300 + (c("event_id") * 37) % 200).alias("px"), (200 + (c("event_id") * 53) % 200).alias("py"))


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Epochs of training runs: cumulative time and a score."""
    c = F.col
    cents = F.round(c("o_totalprice") * 100).cast("bigint")
    return table(spark, d, "orders").select(
        (c("o_custkey") % 40).alias("run"), c("o_orderkey").alias("epoch"),
        (c("o_orderkey") * 1000 + cents % 997).alias("time_c"), (cents % 10000).alias("map50"))


def counts_so_far(spark: SparkSession, d: str) -> DataFrame:
    """Labels per split and class of the 64-odd names, as a planner finds them."""
    from boxloom.operators.coverage import coverage, coverage_with_totals, label_counts

    cov = coverage_with_totals(coverage(registry(spark, d), label_counts(labels(spark, d))))
    per_split = F.explode(F.array(*[
        F.struct(F.lit(s).alias("split"), F.col(s).alias("n")) for s in SPLITS]))
    return cov.select("class_id", "name", "total", per_split.alias("_s")).select(
        "_s.split", "class_id", "name", "_s.n", "total")


def registry(spark: SparkSession, d: str) -> DataFrame:
    """The old class list cleaned and extended by all card names; written once, as a registry is."""
    from boxloom.operators.registry import clean_class_list, extend_registry, in_discovery_order

    found = in_discovery_order(cards(spark, d).select(F.col("card_no").alias("pos"), "raw_name"))
    return durable(extend_registry(clean_class_list(known_classes(spark, d)), found).select("class_id", "name"), "registry")


# --- the same views as SQL ---------------------------------------------------------------

_SPLIT = "CASE WHEN img % 10 < 7 THEN 'train' WHEN img % 10 < 9 THEN 'valid' ELSE 'test' END"
_CANON = "regexp_replace(raw_name, '^(.*)_([A-Z]{2,5}\\p{Nd}{1,5})$', '\\1')"


def _part(value: str, size: int) -> str:
    return f"' 0.' || lpad(cast(({value}) * 1000000 // {size} AS varchar), 6, '0')"


SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "boxes": ((), f"""
SELECT img, box, cls, score, bw, bh, x1, y1, x1 + bw AS x2, y1 + bh AS y2 FROM (
  SELECT l_orderkey AS img,
         cast('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, q)), 1, 15) AS bigint) AS box,
         l_partkey AS cls, cents % 1000 AS score, 60 + q * 2 AS bw,
         (60 + q * 2) * (60 + (l_partkey * 7 + l_linenumber * 13) % 140) // 100 AS bh,
         300 + (l_partkey * 37) % 120 AS x1, 200 + (l_suppkey * 53 + l_linenumber * 17) % 120 AS y1
  FROM (SELECT *, cast(l_quantity AS bigint) AS q, cast(round(l_extendedprice * 100) AS bigint) AS cents FROM lineitem))"""),
    "crowded": ((), f"""
SELECT img, box, cls, score, box % 30000 AS x1, box // 30000 % 30000 AS y1, box % 30000 + bw AS x2, box // 30000 % 30000 + bh AS y2
FROM (
  SELECT l_linenumber::bigint AS img, l_partkey AS cls, cents % 1000 AS score, 60 + q * 2 AS bw,
         cast('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, q)), 1, 15) AS bigint) AS box,
         (60 + q * 2) * (60 + (l_partkey * 7 + l_linenumber * 13) % 140) // 100 AS bh
  FROM (SELECT *, cast(l_quantity AS bigint) AS q, cast(round(l_extendedprice * 100) AS bigint) AS cents FROM lineitem))"""),
    "cards": ((), """
SELECT card_no, name, set_code, replace(name, ' ', '_') || '_' || set_code || lpad(cast(card_no % 1000 AS varchar), 3, '0') AS raw_name
FROM (SELECT p_partkey AS card_no, p_name AS name,
             CASE p_partkey % 3 WHEN 0 THEN 'SEA' WHEN 1 THEN 'WTR' ELSE 'HVY' END AS set_code FROM part)"""),
    "printings": (("cards",), """
SELECT card_no, name, row_number() OVER (PARTITION BY card_no ORDER BY i) - 1 AS pos,
       set_id || lpad(cast(card_no % 1000 AS varchar), 3, '0') AS id, set_id,
       CASE WHEN card_no % 7 <> 0 THEN 'u/' || set_id || '/' || cast(card_no AS varchar) END AS image_url
FROM cards CROSS JOIN (VALUES (0, 'SEA'), (1, 'WTR'), (2, 'HVY')) s(i, set_id) WHERE (card_no + i) % 4 <> 0"""),
    "card_files": (("cards",), """
SELECT card_no, 'images/' || set_code || '/' || raw_name ||
       CASE card_no % 11 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' ELSE '.png' END AS path FROM cards"""),
    "named_files": (("card_files",), """
SELECT split_part(path, '/', 2) AS set_code, split_part(path, '/', 3) AS file,
       regexp_replace(split_part(path, '/', 3), '\\.[^.]*$', '') AS raw_name
FROM card_files WHERE lower(path) LIKE '%.png'"""),
    "known_classes": (("cards",), "SELECT card_no AS pos, raw_name FROM cards WHERE set_code <> 'HVY'"),
    "known_registry": (("known_classes",), f"""
SELECT row_number() OVER (ORDER BY p) - 1 AS class_id, name
FROM (SELECT {_CANON} AS name, min(pos) AS p FROM known_classes GROUP BY 1)"""),
    "registry": (("cards", "known_registry"), f"""
SELECT class_id, name FROM known_registry UNION ALL
SELECT (SELECT max(class_id) FROM known_registry) + row_number() OVER (ORDER BY p), name
FROM (SELECT {_CANON} AS name, min(card_no) AS p FROM cards GROUP BY 1)
WHERE name NOT IN (SELECT name FROM known_registry)"""),
    "images": (("boxes",), f"SELECT DISTINCT img, {_SPLIT} AS split, 'img_' || cast(img AS varchar) AS stem FROM boxes"),
    "image_paths": (("images",), """
SELECT img, 'set/' || split || '/images/' || stem ||
       CASE img % 13 WHEN 0 THEN '.JPG' WHEN 1 THEN '.bmp' WHEN 2 THEN '.jpeg' ELSE '.png' END AS path FROM images"""),
    "label_lines": (("boxes",), f"""
SELECT {_SPLIT} AS split, 'img_' || cast(img AS varchar) AS stem, box AS line_no,
       CASE WHEN (img + box % 1000) % 97 = 0 THEN 'x' ELSE cast(cls % 70 AS varchar) END ||
       {_part('x1 + x2', 2 * WIDTH)} || {_part('y1 + y2', 2 * HEIGHT)} || {_part('bw', WIDTH)} ||
       CASE WHEN (img + box % 1000) % 89 = 0 THEN '' ELSE {_part('bh', HEIGHT)} END AS line
FROM boxes"""),
    "tokens": (("label_lines",), "SELECT *, string_split_regex(trim(line), '\\s+') AS t FROM label_lines"),
    "parsed": (("tokens",), """
SELECT split, stem, line_no AS box_no, try_cast(t[1] AS bigint) AS class_id, cast(t[2] AS double) AS cx,
       cast(t[3] AS double) AS cy, cast(t[4] AS double) AS w, cast(t[5] AS double) AS h
FROM tokens WHERE len(t) = 5 AND try_cast(t[1] AS bigint) IS NOT NULL"""),
    "labels": (("boxes",), f"""
SELECT img, {_SPLIT} AS split, 'img_' || cast(img AS varchar) AS stem, box AS box_no, cls % 70 AS class_id,
       (x1 + x2) / {2 * WIDTH} AS cx, (y1 + y2) / {2 * HEIGHT} AS cy, bw / {WIDTH} AS w, bh / {HEIGHT} AS h FROM boxes"""),
    "truth": (("boxes",), "SELECT img, box, cls % 20 AS cls, x1, y1, x2, y2 FROM boxes WHERE box % 3 <> 0"),
    "preds": (("boxes",), """
SELECT img, box, CASE WHEN score % 10 = 0 THEN (cls + 1) % 20 ELSE cls % 20 END AS cls, score,
       x1 + cls % 9 - 4 AS x1, y1 + img % 7 - 3 AS y1, x2 + cls % 9 - 4 AS x2, y2 + img % 7 - 3 AS y2
FROM boxes WHERE score % 8 <> 1"""),
    "crowded_truth": (("crowded",), "SELECT img, box, cls % 2 AS cls, x1, y1, x2, y2 FROM crowded WHERE box % 3 <> 0"),
    "crowded_preds": (("crowded",), """
SELECT img, box, cls % 2 AS cls, score, x1 + cls % 9 - 4 AS x1, y1 + cls % 7 - 3 AS y1, x2 + cls % 9 - 4 AS x2, y2 + cls % 7 - 3 AS y2
FROM crowded WHERE score % 8 <> 1"""),
    "occluders": (("boxes",), """
SELECT img, box AS occ_no, x1 + 5 AS x1, y1 + 5 AS y1, x1 + 5 + bw AS x2, y1 + 5 + bh AS y2 FROM boxes WHERE box % 2 = 0"""),
    "frames": ((), """
SELECT user_id AS session_id, event_id AS frame_no, ts, event_id * 3 // 2 AS img FROM events WHERE event_type = 'view'"""),
    "pointer": ((), """
SELECT user_id AS session_id, event_id, ts, 300 + (event_id * 37) % 200 AS px, 200 + (event_id * 53) % 200 AS py
FROM events WHERE event_type = 'click'"""),
    "run_metrics": ((), """
SELECT o_custkey % 40 AS run, o_orderkey AS epoch, o_orderkey * 1000 + cents % 997 AS time_c, cents % 10000 AS map50
FROM (SELECT *, cast(round(o_totalprice * 100) AS bigint) AS cents FROM orders)"""),
    "label_counts": (("labels",), "SELECT split, class_id, count(*) AS n FROM labels GROUP BY ALL"),
    "coverage": (("registry", "label_counts"), """
SELECT r.class_id, name, s.split, coalesce(n, 0) AS n FROM registry r
CROSS JOIN (VALUES ('train'), ('valid'), ('test')) s(split)
LEFT JOIN label_counts c ON c.class_id = r.class_id AND c.split = s.split"""),
    "counts_so_far": (("coverage",), """
SELECT split, class_id, name, n, cast(sum(n) OVER (PARTITION BY class_id) AS bigint) AS total FROM coverage"""),
    "pointed": (("frames", "pointer"), """
SELECT f.session_id, f.frame_no, f.ts, f.img, coalesce(p.px, 0) AS px, coalesce(p.py, 0) AS py
FROM frames f ASOF LEFT JOIN
  (SELECT session_id, ts, max_by(px, event_id) AS px, max_by(py, event_id) AS py FROM pointer GROUP BY ALL) p
ON f.session_id = p.session_id AND f.ts >= p.ts"""),
}


def overlap_sql(a: str, b: str) -> str:
    """Pixels two boxes share."""
    return (f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * "
            f"greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))")


def area_sql(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def greedy_sql(name: str, source: str, group: str, num: int, den: int) -> str:
    """Recursive greedy removal over ``source``: rank by score, keep if no kept box overlaps more."""
    inter = overlap_sql("b", "k")
    return f"""
{name}_ranked AS (
  SELECT *, {group} AS grp, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, box) AS rn FROM {source}),
{name}_fold AS (
  SELECT grp, rn, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept, true AS ok, box FROM {name}_ranked WHERE rn = 1
  UNION ALL
  SELECT b.grp, b.rn, CASE WHEN ok THEN list_append(kept, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE kept END, ok, box
  FROM (
    SELECT b.*, f.kept, len(list_filter(f.kept, lambda k:
      {inter} * {den} > ({area_sql('b')} + {area_sql('k')} - {inter}) * {num})) = 0 AS ok
    FROM {name}_fold f JOIN {name}_ranked b ON b.grp = f.grp AND b.rn = f.rn + 1) b),
{name} AS (SELECT r.* EXCLUDE (grp) FROM {name}_ranked r JOIN {name}_fold f ON f.grp = r.grp AND f.rn = r.rn WHERE f.ok)"""


def with_views(names: str, body: str, extra: str = "") -> str:
    """``body`` after the named views and whatever they build on; ``extra`` adds more views."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in SQL_VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    parts = [f"{n} AS ({SQL_VIEWS[n][1].strip()})" for n in order]
    if extra:
        parts.append(extra.strip())
    return f"WITH {'RECURSIVE ' if extra else ''}" + ",\n".join(parts) + "\n" + body.strip()
