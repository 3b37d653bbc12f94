"""Names, geometry and fixed-point text on hand-made rows."""

import random

from pyspark.sql import functions as F

from boxloom.functions import fixed, geometry as G, names as N


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_canonical_names(spark):
    cases = {
        "Quick_Step_WTR159": "Quick_Step", "Lamp_SEA169": "Lamp", "X_WTR159-CF": "X_WTR159-CF",
        "A_B1_WTR1": "A_B1", "A_W1": "A_W1", "A_ABCDEF1": "A_ABCDEF1", "A_WTR123456": "A_WTR123456", "_WTR1": "",
        "plain": "plain", "A_WTR1_SEA2": "A_WTR1", "a_wtr1": "a_wtr1",
    }
    assert column(spark, list(cases), "string", N.canonical_name) == list(cases.values())
    kept = column(spark, ["Lamp_SEA169", "plain"], "string", lambda c: N.canonical_name(c, keep_printings=True))
    assert kept == ["SEA/Lamp", "plain"]


def test_lookup_keys_keep_accents_and_drop_punctuation(spark):
    names = ["  Éclat d'Été! ", "Tale_of Islands", "Rök, the 2nd", None]
    exact = column(spark, names, "string", N.exact_key)
    assert exact == ["éclat d'été!", "tale_of islands", "rök, the 2nd", ""]
    assert column(spark, names, "string", lambda c: N.loose_key(N.exact_key(c))) == [
        "éclat dété", "tale_of islands", "rök the 2nd", ""]
    assert column(spark, ["Deep__Water_ "], "string", N.search_key) == ["deep  water"]


def test_file_names(spark):
    df = spark.createDataFrame([("Hat of Straw!", "WTR1"), (None, None)], "n string, i string")
    got = [r[0] for r in df.select(N.image_file_name(F.col("n"), F.col("i"))).collect()]
    assert got == ["Hat_of_Straw_WTR1.png", "unknown_unknown.png"]


def test_fixed_point_text_equals_python(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(3000)] + [rng.randrange(10 ** 7) / 10 ** 7 for _ in range(3000)]
    values += [(2 * rng.randrange(10 ** 5) + 1) / 2 ** rng.randrange(1, 40) for _ in range(1000)]
    values += [0.0, 1.0, -0.25, 0.9999995, 0.9999996, 5e-7, 2.5e-7, 1.5e-6, 0.0006725, 7.25, -3e-9]
    assert column(spark, values, "double", fixed.fixed6) == [f"{v:.6f}" for v in values]


def labels(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, cx double, cy double, w double, h double")


LABEL = lambda: G.Label(*[F.col(c) for c in ("cx", "cy", "w", "h")])


def test_four_quarter_turns_are_the_identity(spark):
    turned = LABEL()
    for _ in range(4):
        turned = G.rotate_label(turned, F.lit(90))
    rows = [(0.25, 0.5, 0.125, 0.375), (0.75, 0.125, 0.5, 0.25)]
    got = labels(spark, rows).select("i", *turned).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == rows
    back = G.rotate_label(G.rotate_label(LABEL(), F.lit(90)), F.lit(270))
    assert [tuple(r)[1:] for r in labels(spark, rows).select("i", *back).orderBy("i").collect()] == rows


def test_corners_cut_then_clamp(spark):
    rows = [(0.5, 0.5, 0.2, 0.3), (0.0, 0.0, 0.2, 0.2), (1.0, 1.0, 0.33, 0.33), (1.4, -0.4, 0.1, 0.1)]
    def plain(cx, cy, w, h, clamp, W=101, H=77):
        bw, bh = int(w * W), int(h * H)
        x1, y1 = int((cx - w / 2) * W), int((cy - h / 2) * H)
        x2, y2 = x1 + bw, y1 + bh
        return (max(0, x1), max(0, y1), min(W - 1, x2), min(H - 1, y2)) if clamp else (x1, y1, x2, y2)
    for clamp in (True, False):
        got = labels(spark, rows).select(
            "i", *G.to_corners(LABEL(), F.lit(101), F.lit(77), clamp)).orderBy("i").collect()
        assert [tuple(r)[1:] for r in got] == [plain(*r, clamp) for r in rows]


def test_iou_of_degenerate_boxes_is_zero(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (0, 0, 2, 2), (5, 5, 2, 2)], "x1 long, y1 long, x2 long, y2 long")
    got = df.select(G.iou(G.box(), G.box()).alias("v"), G.overlaps_more(G.box(), G.box(), 0.2).alias("m")).collect()
    assert [(r.v, r.m) for r in got] == [(0.0, False), (1.0, True), (0.0, False)]


def test_shape_bounds_are_inclusive(spark):
    rows = [(0, 0, 100, 125), (0, 0, 100, 155), (0, 0, 100, 124), (0, 0, 100, 156), (0, 0, 0, 10)]
    df = spark.createDataFrame(rows, "x1 long, y1 long, x2 long, y2 long")
    got = [r[0] for r in df.select(G.slot_shape(G.box(), F.lit(1000), F.lit(1000))).collect()]
    assert got == [True, True, False, False, False]


def test_highlight_needs_a_threshold(spark):
    df = labels(spark, [(0.5, 0.5, 0.5, 0.5)])
    for threshold, expected in ((None, False), (0.0, False), (0.1, True), (0.25, False)):
        h, w, _ = G.placement_size(LABEL(), F.lit(100), F.lit(100), F.lit(10), F.lit(20), F.lit(30), F.lit(40),
                                   F.lit(threshold).cast("double"))
        row = df.select(h.alias("h"), w.alias("w")).first()
        assert row.h is expected and row.w == (25 if expected else 25)
