"""The sweep over tiles against a bitmap, and against areas known beforehand on huge canvases."""

import random

import numpy as np
import pytest

from boxloom.operators import covered, occlusion

SCHEMA = "img long, box long, x1 long, y1 long, x2 long, y2 long"


def shapes(rng, n, side, size):
    at = [(rng.randrange(-5, side), rng.randrange(-5, side)) for _ in range(n)]
    return np.array([(x, y, x + rng.randrange(0, size), y + rng.randrange(0, size)) for x, y in at], np.int64).reshape(-1, 4)


def by_bitmap(rects, boxes):
    canvas = np.zeros((400, 400), bool)
    for x1, y1, x2, y2 in rects + 10:
        canvas[x1:x2, y1:y2] = True
    return [int(canvas[x1:x2, y1:y2].sum()) for x1, y1, x2, y2 in boxes + 10]


@pytest.mark.parametrize("cells", [1 << 19, 40, 1])
@pytest.mark.parametrize("n, size", [(0, 9), (1, 9), (40, 30), (200, 6), (60, 250)])
def test_sweep_equals_a_bitmap_whatever_the_block(monkeypatch, cells, n, size):
    monkeypatch.setattr(covered, "_CELLS", cells)
    rng = random.Random(n + size)
    rects, boxes = shapes(rng, n, 120, size), shapes(rng, 50, 150, 90)
    assert covered.covered_area(rects, boxes).tolist() == by_bitmap(rects, boxes)


@pytest.mark.parametrize("tile_rects, chunk_boxes", [(512, 16_384), (4, 7), (1, 1)])
def test_tiles_and_chunks_change_nothing(spark, tile_rects, chunk_boxes):
    rng = random.Random(4)
    rows, over, want = [], [], {}
    for img in (None, 1, 2):
        rects, boxes = shapes(rng, 60, 100, 25), shapes(rng, 30, 120, 60)
        rects = np.concatenate([rects, rects[:5]])
        rows += [(img, i, *map(int, b)) for i, b in enumerate(boxes)]
        over += [(img, i, *map(int, r)) for i, r in enumerate(rects)]
        for b, hidden in zip(boxes.tolist(), by_bitmap(rects, boxes)):
            if hidden:
                want[(img, *b)] = hidden
    got = covered.hidden_in_tiles(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(over, SCHEMA), ["img"], tile_rects, chunk_boxes).collect()
    assert {tuple(r)[:-1]: r.hidden for r in got} == want and len(got) == len(want)


def test_the_size_in_pixels_costs_nothing(spark):
    side = 10 ** 9
    boxes = [(1, 0, 0, 0, side, side), (1, 1, 500, 0, 501, 10_000)]
    over = [(1, i, i * 1000, 0, i * 1000 + 700, side) for i in range(300)] + [(1, 301, 0, 0, 300_000, 5), (1, 302, -9, -9, -1, side)]
    got = {r.box: r.hidden for r in occlusion.hidden_area(
        spark.createDataFrame(boxes, SCHEMA), spark.createDataFrame(over, SCHEMA), ["img"], 64).collect()}
    assert got == {0: 300 * 700 * side + 300 * 300 * 5, 1: 10_000}


def test_no_occluders_and_no_boxes(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 1, 0, 0, 5, 5)], SCHEMA)
    assert covered.hidden_in_tiles(some, none, ["img"]).count() == 0
    assert covered.hidden_in_tiles(none, some, ["img"]).count() == 0


@pytest.mark.parametrize("pixels", [None, 40])
def test_small_tiles_do_not_repeat_the_boxes_of_a_dense_canvas(spark, monkeypatch, pixels):
    rng = np.random.default_rng(8)
    low = rng.integers(0, 280, (3_000, 2))
    rects = np.hstack([low, low + rng.integers(60, 90, (3_000, 2))])
    boxes, rects = rects[::2] + 7, rects[:600]
    dealt = []
    plain = covered.durable

    def counted(df, label="step"):
        table = plain(df, label)
        if label == "dealt":
            dealt.append(table.count())
        return table

    monkeypatch.setattr(covered, "durable", counted)
    if pixels:
        monkeypatch.setattr(covered, "_PIXELS", pixels)
    kind = "img long, x1 long, y1 long, x2 long, y2 long"
    frame = lambda rows: spark.createDataFrame([(1, *map(int, r)) for r in rows], kind)
    got = covered.hidden_in_tiles(frame(boxes), frame(rects), ["img"], 4, 100 if pixels else covered.CHUNK_BOXES).collect()
    want = dict(zip(map(tuple, boxes.tolist()), by_bitmap(rects, boxes)))
    assert {(r.x1, r.y1, r.x2, r.y2): r.hidden for r in got} == {k: v for k, v in want.items() if v}
    # Of usual tiles a box is in few; tiles smaller than boxes are in many.
    assert dealt[0] > 6 * len(boxes) if pixels else dealt[0] < 3 * len(boxes)
