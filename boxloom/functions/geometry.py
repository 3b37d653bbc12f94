"""Box arithmetic on columns. Pixel boxes are x1, y1, x2, y2; labels are centre and size in [0, 1]."""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted height/width ratios and shares of the image, for slot proposals
# and for live detections (all bounds inclusive).
SLOT_ASPECT, SLOT_AREA = (1.25, 1.55), (0.005, 0.50)
LIVE_ASPECT, LIVE_AREA = (0.6, 2.2), (0.004, 0.15)
# Fixed value: gap in pixels between a hovered box and its preview.
PREVIEW_GAP = 10


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


class Label(NamedTuple):
    cx: Column
    cy: Column
    w: Column
    h: Column


def box(source: Column | None = None, prefix: str = "") -> Box:
    """Corners from a struct column, or from columns with a common prefix."""
    if source is not None:
        return Box(source["x1"], source["y1"], source["x2"], source["y2"])
    return Box(*[F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")])


def area(a: Box) -> Column:
    return (a.x2 - a.x1) * (a.y2 - a.y1)


def intersection(a: Box, b: Box) -> Column:
    wide = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    tall = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((wide > 0) & (tall > 0), wide * tall).otherwise(F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is not positive."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def _compare(a: Box, b: Box, threshold: float, strict: bool) -> Column:
    # inter/(areas - inter) against num/den without division, so integer boxes compare
    # exactly. Boxes that share nothing have a ratio of 0, which passes no threshold here.
    share = Fraction(str(threshold))
    wide = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    tall = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    left = wide * tall * (share.denominator + share.numerator)
    right = (area(a) + area(b)) * share.numerator
    return (wide > 0) & (tall > 0) & ((left > right) if strict else (left >= right))


def overlaps_more(a: Box, b: Box, threshold: float) -> Column:
    """Intersection over union above ``threshold`` (0 or more)."""
    return _compare(a, b, threshold, True)


def overlaps_least(a: Box, b: Box, threshold: float) -> Column:
    """Intersection over union of at least ``threshold`` (above 0)."""
    return _compare(a, b, threshold, False)


def overlap_reaches(overlap: Column, union: Column, percent: Column) -> Column:
    """Overlap over union is at least ``percent``/100, compared without division."""
    return (union > 0) & (overlap * 100 >= union * percent)


def to_label(a: Box, width: Column, height: Column) -> Label:
    return Label(
        (a.x1 + a.x2) / (width * 2), (a.y1 + a.y2) / (height * 2),
        (a.x2 - a.x1) / width, (a.y2 - a.y1) / height,
    )


def to_corners(label: Label, width: Column, height: Column, clamp: bool = True) -> Box:
    """Pixel corners. Size and left/top are cut to whole pixels apart, then clamped."""
    def whole(c: Column) -> Column:
        return c.cast("bigint")

    x1 = whole((label.cx - label.w / 2) * width)
    y1 = whole((label.cy - label.h / 2) * height)
    x2 = x1 + whole(label.w * width)
    y2 = y1 + whole(label.h * height)
    if not clamp:
        return Box(x1, y1, x2, y2)
    return Box(
        F.greatest(F.lit(0), x1), F.greatest(F.lit(0), y1),
        F.least(width.cast("bigint") - 1, x2), F.least(height.cast("bigint") - 1, y2),
    )


def aspect(a: Box) -> Column:
    """Height over width; null for a box without positive sides."""
    return F.when(has_sides(a), (a.y2 - a.y1) / (a.x2 - a.x1))


def area_share(a: Box, width: Column, height: Column) -> Column:
    return area(a) / (width * height)


def has_sides(a: Box) -> Column:
    return (a.x2 > a.x1) & (a.y2 > a.y1)


def shape_within(a: Box, width: Column, height: Column, aspects: tuple[float, float],
                 areas: tuple[float, float]) -> Column:
    wide, tall = a.x2 - a.x1, a.y2 - a.y1
    return (
        (wide > 0) & (tall > 0)
        & F.try_divide(tall, wide).between(*aspects)
        & (wide * tall / (width * height)).between(*areas)
    )


def slot_shape(a: Box, width: Column, height: Column) -> Column:
    return shape_within(a, width, height, SLOT_ASPECT, SLOT_AREA)


def live_shape(a: Box, width: Column, height: Column) -> Column:
    return shape_within(a, width, height, LIVE_ASPECT, LIVE_AREA)


def rotate_label(label: Label, angle: Column) -> Label:
    """Label after a counter-clockwise quarter turn of its image; other angles change nothing."""
    def pick(q90: Column, q180: Column, q270: Column, same: Column) -> Column:
        return F.when(angle == 90, q90).when(angle == 180, q180).when(angle == 270, q270).otherwise(same)

    cx, cy, w, h = label
    return Label(
        pick(cy, 1 - cx, 1 - cy, cx), pick(1 - cx, 1 - cy, cx, cy),
        pick(h, w, h, w), pick(w, h, w, h),
    )


def placement_size(label: Label, width: Column, height: Column, card_w: Column, card_h: Column,
                   target_w: Column, target_h: Column, threshold: Column) -> tuple[Column, Column, Column]:
    """(highlighted, pixel width, pixel height) of a card laid into a box.

    A box above the threshold is filled on its own; all others share the target scale.
    A missing or zero threshold marks no box.
    """
    highlighted = (F.coalesce(threshold, F.lit(0.0)) != 0) & (label.w * label.h > threshold)
    highlighted = F.coalesce(highlighted, F.lit(False))
    box_w = (label.w * width).cast("bigint")
    box_h = (label.h * height).cast("bigint")
    scale = F.when(highlighted, F.least(box_w / card_w, box_h / card_h)).otherwise(
        (target_w / card_w + target_h / card_h) / 2.0)
    return highlighted, (card_w * scale).cast("bigint"), (card_h * scale).cast("bigint")


def preview_corner(a: Box, width: Column, height: Column, card_w: Column, card_h: Column) -> tuple[Column, Column]:
    """Top-left corner of a preview below a box cut to whole pixels, kept inside the canvas."""
    x1, y2 = a.x1.cast("bigint"), a.y2.cast("bigint")
    return (
        F.greatest(F.lit(0), F.least(x1, width - card_w)),
        F.greatest(F.lit(0), F.least(y2 + PREVIEW_GAP, height - card_h)),
    )


def contains(a: Box, px: Column, py: Column) -> Column:
    """Point in box with corners cut to whole pixels, bounds inclusive."""
    x1, y1, x2, y2 = [c.cast("bigint") for c in a]
    return (x1 <= px) & (px <= x2) & (y1 <= py) & (py <= y2)
