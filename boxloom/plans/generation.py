"""The whole plan of a balanced dataset as one chain of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import Label, rotate_label
from boxloom.functions.names import digest, output_stem
from boxloom.operators.planning import class_files, class_quota, draw, draw_files, fallback_splits, seated, turn
from boxloom.plans.running import Running, hash_bucket, number_rows, running
from boxloom.plans.skew import small_side
from boxloom.session import durable

IMAGES_PER_BUCKET = 65_536


@dataclass(frozen=True)
class Plan:
    """``images``: image_no, split, template, angle, stem. ``labels``: one row per box."""

    images: DataFrame
    labels: DataFrame


def numbered_templates(templates: DataFrame, seed: str) -> DataFrame:
    """Templates (split, stem) numbered per split in seeded order, with the split's count."""
    marked = templates.select("split", "stem").withColumn("_d", digest(seed, F.col("stem")))
    rows = number_rows(marked, ["split"], hash_bucket(F.col("_d"), 3), [F.col("_d"), F.col("stem")], "_n")
    sizes = templates.groupBy("split").agg(F.count(F.lit(1)).alias("templates"))
    return rows.join(sizes, "split").select(
        "split", F.col("stem").alias("template"), (F.col("_n") - 1).alias("template_no"), "templates")


def _drawn_images(quota: DataFrame, templates: DataFrame, boxes: DataFrame, seed: str) -> DataFrame:
    """New images with template, turn, stem and ``_boxes``; a split without templates gives way to one that has some."""
    pool = numbered_templates(templates, seed)
    sizes = templates.groupBy("split").agg(F.count(F.lit(1)).alias("templates"))
    drawn = draw(fallback_splits(quota, templates), pool, ["split"], "template_no", "templates", f"{seed}-template",
                 ["image_no"], sizes, on_miss="fail")
    own = ["split", "template"]
    filled = drawn.join(boxes.groupBy(*own).agg(F.count(F.lit(1)).alias("_boxes")), own, "left")
    return durable(filled.select(
        "image_no", "split", "template", turn(f"{seed}-turn", F.col("image_no")).alias("angle"),
        output_stem(seed, F.col("image_no"), F.col("template")).alias("stem"),
        F.coalesce("_boxes", F.lit(0)).alias("_boxes")), "planned-images")


def _turned(angle: Column) -> list[Column]:
    places = ("cx", "cy", "w", "h")
    return [c.alias(n) for n, c in zip(places, rotate_label(Label(*[F.col(c) for c in places]), angle))]


def plan_dataset(quota: DataFrame, templates: DataFrame, template_labels: DataFrame, counts: DataFrame, seed: str,
                 makeup_min: int = 0, registry: DataFrame | None = None, files: DataFrame | None = None) -> Plan:
    """New images with their labels, guided by coverage.

    ``quota``: image_no, split. ``templates``: split, stem. ``template_labels``: split,
    stem, box_no, cx, cy, w, h. ``counts``: split, class_id, n, total, one row per class
    that has files. Every box of every drawn template is a slot; slots take classes in
    order of need. With ``registry`` (class_id, name) and card ``files`` a label also carries
    a file of its class; a class without files fails. The same seed gives the same plan.
    """
    boxes = template_labels.withColumnRenamed("stem", "template")
    images = _drawn_images(quota, templates, boxes, seed)

    # Slot numbers: slots before the image, plus the place of the box in its template.
    # Only templates are ranked box by box; images need one running sum.
    own = ["split", "template"]
    ranked = number_rows(
        boxes.withColumn("_d", digest(seed, F.col("box_no"))), own, hash_bucket(F.col("_d"), 2),
        [F.col("_d"), F.col("box_no")], "_place").drop("_d")
    starts = running(images, ["split"], F.floor(F.col("image_no") / IMAGES_PER_BUCKET), [F.col("image_no")],
                     _start=Running("sum", F.col("_boxes"), inclusive=False))
    slots = starts.join(ranked, own).withColumn("slot_no", F.col("_start") + F.col("_place") - 1)
    needed = images.groupBy("split").agg(F.sum("_boxes").cast("bigint").alias("slots"))
    placed = slots.select("image_no", "split", "stem", "box_no", "slot_no", "angle", *_turned(F.col("angle")))
    labels = seated(placed, class_quota(counts, needed, seed), seed, makeup_min).select(
        "image_no", "split", "stem", "box_no", "class_id", "angle", "cx", "cy", "w", "h")
    if files is not None:
        named = labels.join(small_side(registry.select("class_id", "name")), "class_id", "left")
        labels = draw(named, class_files(files, seed), ["name"], "file_no", "files", f"{seed}-file",
                      ["image_no", "box_no"], on_miss="fail").drop("file_no")
    return Plan(images.drop("_boxes"), labels)


def plan_by_files(quota: DataFrame, templates: DataFrame, template_labels: DataFrame,
                  registry: DataFrame, files: DataFrame, seed: str) -> Plan:
    """New images with their labels, every box filled with any of the card files.

    The file decides the class. A file whose class the registry does not hold fails the job.
    """
    boxes = template_labels.withColumnRenamed("stem", "template")
    images = _drawn_images(quota, templates, boxes, seed)
    filled = images.select("image_no", "split", "stem", "template", "angle").join(boxes, ["split", "template"])
    placed = filled.select("image_no", "split", "stem", "box_no", "angle", *_turned(F.col("angle")))
    drawn = draw_files(placed, files, seed, ["image_no", "box_no"])
    known = drawn.join(small_side(registry.select("class_id", "name")), "name", "left")
    unknown = F.raise_error(F.concat(F.lit("card file of an unknown class: "), F.col("file"))).cast("bigint")
    return Plan(images.drop("_boxes"), known.withColumn(
        "class_id", F.when(F.col("class_id").isNull(), unknown).otherwise(F.col("class_id"))).select(
        "image_no", "split", "stem", "box_no", "class_id", "angle", "cx", "cy", "w", "h", "name", "set_code", "file"))
