"""Groups above the limit take another path; its result must be the same, and right."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import evaluate, layout, occlusion, overlap
from boxloom.operators.suppress import keep_best, kept_per_group
from boxloom.plans.running import Running, exact_median, number_rows, running
from boxloom.plans.skew import split_hot, top_k
from boxloom.sinks.tables import label_texts


def overlap_of(a, b):
    wide = min(a[2], b[2]) - max(a[0], b[0])
    tall = min(a[3], b[3]) - max(a[1], b[1])
    return max(0, wide) * max(0, tall)


def joint_of(a, b):
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return size(a) + size(b) - overlap_of(a, b)


def random_boxes(seed, n_hot, n_cold=60, canvas=900):
    """Rows (img, box, score, x1, y1, x2, y2); image 0 holds ``n_hot`` of them, many with equal scores."""
    rng = random.Random(seed)
    rows = []
    for i in range(n_hot + n_cold):
        img = 0 if i < n_hot else 1 + i % 9
        x, y = rng.randrange(canvas), rng.randrange(canvas)
        rows.append((img, i, rng.randrange(300), x, y, x + rng.randrange(20, 160), y + rng.randrange(20, 160)))
    return rows


SCHEMA = "img long, box long, score long, x1 long, y1 long, x2 long, y2 long"
BY_SCORE = lambda: [-F.col("score"), F.col("box")]


def greedy(rows, num, den):
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        if all(k[0] != r[0] or overlap_of(r[3:], k[3:]) * den <= joint_of(r[3:], k[3:]) * num for k in kept):
            kept.append(r)
    return {(k[0], k[1]) for k in kept}


@pytest.mark.parametrize("limit", [10_000, 50])
def test_greedy_removal_equals_a_plain_loop(spark, limit):
    rows = random_boxes(1, 1_500)
    got = keep_best(spark.createDataFrame(rows, SCHEMA), ["img"], BY_SCORE(), 0.25, group_limit=limit)
    assert {(r.img, r.box) for r in got.collect()} == greedy(rows, 1, 4)


def test_sparse_hot_groups_are_decided_on_pairs(spark, monkeypatch):
    from boxloom.operators import suppress
    monkeypatch.setattr(suppress, "_CHUNK", 5)
    rows = random_boxes(7, 600, canvas=3000)
    got = keep_best(spark.createDataFrame(rows, SCHEMA), ["img"], BY_SCORE(), 0.25, group_limit=20)
    assert {(r.img, r.box) for r in got.collect()} == greedy(rows, 1, 4)
    # A chain in which every box overlaps the next one only.
    chain = [(1, i, 100 - i, 60 * i, 0, 60 * i + 100, 50) for i in range(12)]
    kept = suppress._by_pairs(spark.createDataFrame(chain, SCHEMA), ["img"], BY_SCORE(), 0.2)
    assert {(r.img, r.box) for r in kept.collect()} == greedy(chain, 1, 5)


def test_capped_removal_is_the_same_on_both_paths(spark):
    df = spark.createDataFrame(random_boxes(2, 1_200), SCHEMA)
    usual = keep_best(df, ["img"], BY_SCORE(), 0.5, 25).collect()
    assert sorted(usual) == sorted(keep_best(df, ["img"], BY_SCORE(), 0.5, 25, group_limit=40).collect())
    arrays = kept_per_group(df, ["img"], BY_SCORE(), 0.5, 25)
    peeled = kept_per_group(df, ["img"], BY_SCORE(), 0.5, 25, group_limit=40)
    ids = lambda d: {r.img: [b.box for b in r.kept] for r in d.collect()}
    assert ids(arrays) == ids(peeled)
    assert max(len(v) for v in ids(arrays).values()) == 25


def test_removal_with_null_keys_keeps_their_group(spark):
    rows = [(None, 1, 9, 0, 0, 10, 10), (None, 2, 8, 0, 0, 10, 10), (None, 3, 7, 50, 50, 60, 60), (4, 4, 1, 0, 0, 5, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (100, 1):
        kept = keep_best(df, ["img"], BY_SCORE(), 0.25, group_limit=limit)
        assert sorted(r.box for r in kept.collect()) == [1, 3, 4]


def plain_match(preds, truth, level):
    used, out = set(), {}
    for p in sorted(preds, key=lambda r: (r[0], -r[2], r[1])):
        best = None
        for t in truth:
            if t[0] != p[0] or (t[0], t[1]) in used:
                continue
            i, u = overlap_of(p[3:], t[2:]), joint_of(p[3:], t[2:])
            if i * 100 >= u * level and (best is None or (i / u, -t[1]) > best[0]):
                best = ((i / u, -t[1]), t[1])
        out[(p[0], p[1], level)] = best and best[1]
        if best:
            used.add((p[0], best[1]))
    return out


@pytest.mark.parametrize("limit", [10_000, 40])
def test_matching_equals_a_plain_loop(spark, limit):
    rng = random.Random(5)
    truth, preds = [], []
    for i in range(330):
        img = 0 if i < 250 else 1 + i % 6
        x, y = rng.randrange(500), rng.randrange(500)
        truth.append((img, i, x, y, x + 60, y + 80))
        for j in range(rng.randrange(3)):
            dx, dy = rng.randrange(-15, 16), rng.randrange(-15, 16)
            preds.append((img, i * 10 + j, rng.randrange(100), x + dx, y + dy, x + dx + 60, y + dy + 80))
    p = spark.createDataFrame(preds, SCHEMA).withColumn("cls", F.lit(1))
    t = spark.createDataFrame(truth, "img long, box long, x1 long, y1 long, x2 long, y2 long").withColumn("cls", F.lit(1))
    got = evaluate.match(p, t, (50, 75), group_limit=limit).collect()
    want = plain_match(preds, truth, 50) | plain_match(preds, truth, 75)
    assert {(r.img, r.box, r.level): r.truth for r in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("limit", [10_000, 20])
def test_hidden_area_equals_a_bitmap(spark, limit):
    rng = random.Random(6)
    make = lambda n, img: [
        (img, i, x, y, x + rng.randrange(0, 90), y + rng.randrange(1, 90))
        for i in range(n) for x, y in [(rng.randrange(-20, 200), rng.randrange(-20, 200))]]
    boxes, occluders = make(30, 1) + make(20, 2) + make(3, 3), make(60, 1) + make(5, 2)
    schema = "img long, box long, x1 long, y1 long, x2 long, y2 long"
    got = occlusion.hidden_area(
        spark.createDataFrame(boxes, schema), spark.createDataFrame(occluders, schema), ["img"], limit).collect()
    mask = {}
    for img, _, x1, y1, x2, y2 in occluders:
        mask.setdefault(img, set()).update((x, y) for x in range(x1, x2) for y in range(y1, y2))
    want = {(img, b): sum((x, y) in mask.get(img, ()) for x in range(x1, x2) for y in range(y1, y2))
            for img, b, x1, y1, x2, y2 in boxes}
    assert {(r.img, r.box): r.hidden for r in got} == want


def test_layout_of_large_images_equals_the_array_path(spark):
    rng = random.Random(7)
    rows = [(1 if i < 400 else 2 + i % 5, rng.choice([0.05, 0.06, rng.uniform(0.01, 0.3)]), rng.choice([0.08, rng.uniform(0.01, 0.4)]))
            for i in range(460)]
    boxes = spark.createDataFrame(rows, "img long, w double, h double")
    images = spark.createDataFrame([(i, 1920, 1080) for i in range(1, 9)], "img long, width int, height int")
    usual = layout.layout_stats(images, boxes, ["img"]).orderBy("img").toPandas()
    hot = layout.layout_stats(images, boxes, ["img"], group_limit=30).orderBy("img").toPandas()
    assert list(usual.columns) == list(hot.columns) and len(usual) == 8
    for c in usual.columns:
        assert hot[c].tolist() == pytest.approx(usual[c].tolist(), nan_ok=True), c
    empty = usual[usual.img == 8].iloc[0]
    assert (empty.boxes, empty.target_w, empty.target_h, empty.min_height) == (0, 300, 420, 1.0)


def test_a_text_for_every_image_whatever_its_size(spark):
    rows = [("train", "big", i, f"l{i}") for i in range(2500)] + [("train", "small", i, f"s{i}") for i in range(3)]
    images = spark.createDataFrame([("train", "big"), ("train", "small"), ("test", "bare")], "split string, stem string")
    texts = label_texts(spark.createDataFrame(rows, "split string, stem string, box_no long, line string"), images)
    found = {r.stem: r.text for r in texts.collect()}
    assert found == {"big": "\n".join(f"l{i}" for i in range(2500)), "small": "s0\ns1\ns2", "bare": ""}


def test_null_keys_match_below_and_above_the_limit(spark):
    box = "img long, cls long, box long, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(k, c, i, 0., 0., 10., 10.) for i, (k, c) in enumerate([(1, None), (None, 2), (None, None), (1, 2)])], box)
    preds = truth.withColumn("score", F.lit(0.9))
    for limit in (1000, 0):
        got = {r.box: r.truth for r in evaluate.match(preds, truth, (50,), group_limit=limit).collect()}
        assert got == {0: 0, 1: 1, 2: 2, 3: 3}, limit


def test_fractional_occluders_hide_alike_on_both_paths(spark):
    corners = "img long, x1 double, y1 double, x2 double, y2 double"
    boxes = spark.createDataFrame([(1, 0., 0., 10.9, 10.), (2, 0., 0., 4., 4.)], corners)
    occluders = spark.createDataFrame([(1, 0.5, 0., 5.7, 10.), (1, 4., 0., 6., 5.)], corners)
    both = [sorted((r.img, r.hidden) for r in occlusion.hidden_area(boxes, occluders, ["img"], group_limit=n).collect())
            for n in (64, 1)]
    assert both[0] == both[1] == [(1, 55), (2, 0)]


def test_classes_without_confident_predictions_keep_their_row(spark):
    matches = spark.createDataFrame([(50, 1, 0.9, 7), (50, 1, 0.8, None), (50, 2, 0.1, 8)],
                                    "level int, cls long, score double, truth long")
    truth = spark.createDataFrame([(1,), (2,), (2,)], "cls long")
    got = {r.cls: (r.tp, r.n, r.n_truth, r.precision, r.recall)
           for r in evaluate.operating_point(matches, truth, ["cls"], 0.5, (50,)).collect()}
    assert got == {1: (1, 2, 1, 0.5, 1.0), 2: (0, 0, 2, None, 0.0)}


def test_running_values_equal_plain_windows(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2]), i, rng.choice([None, rng.randrange(50)])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, pos long, v long")
    got = running(df, ["k"], F.floor(F.col("pos") / 37), [F.col("pos")],
                  s=Running("sum", F.col("v")), m=Running("max", F.col("v")),
                  last=Running("last", F.col("v")), before=Running("last", F.col("v"), inclusive=False))
    state, want = {}, {}
    for k, pos, v in sorted(rows, key=lambda r: r[1]):
        s, m, last = state.get(k, (0, None, None))
        before = last
        if v is not None:
            s, m, last = s + v, v if m is None else max(m, v), v
        state[k] = (s, m, last)
        want[pos] = (s, m, last, before)
    assert {r.pos: (r.s, r.m, r.last, r.before) for r in got.collect()} == want
    numbered = number_rows(df, [], F.floor(F.col("pos") / 50), [F.col("pos")])
    assert all(r.row_no == r.pos + 1 for r in numbered.collect())


def test_exact_median_and_top_k(spark):
    rng = random.Random(9)
    rows = [(i % 3, float(rng.randrange(40))) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: r.med for r in exact_median(df, ["k"], "v", "med").collect()}
    import statistics
    assert got == {k: statistics.median(v for kk, v in rows if kk == k) for k in range(3)}
    numbered = df.withColumn("id", F.monotonically_increasing_id())
    plain = top_k(numbered, ["k"], [F.col("v"), F.col("id")], 7)
    salted = top_k(numbered, ["k"], [F.col("v"), F.col("id")], 7, salts=8)
    assert sorted(plain.collect()) == sorted(salted.collect()) and plain.count() == 21


def test_split_hot_loses_no_row(spark):
    df = spark.createDataFrame([(None,)] * 9 + [(1,)] * 3 + [(2,)] * 8, "k long")
    usual, hot = split_hot(df, ["k"], 5)
    assert usual.count() == 3 and hot.count() == 17
    assert split_hot(df, ["k"], 50)[1] is None


@pytest.mark.parametrize("limit", [10_000, 30])
def test_overlapping_pairs_come_once_over_tiles(spark, limit):
    rows = random_boxes(11, 200, 50, canvas=1200)
    df = spark.createDataFrame(rows, SCHEMA)
    got = overlap.overlapping_pairs(df, df, ["img"], "box", "box", once=True, group_limit=limit, tile=64).collect()
    want = {(a[1], b[1]) for a in rows for b in rows
            if a[0] == b[0] and a[1] < b[1] and overlap_of(a[3:], b[3:]) > 0}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


@pytest.mark.parametrize("tile_limit", [24_576, 30])
def test_hot_pairs_are_swept_in_place_of_joined(spark, monkeypatch, tile_limit):
    from boxloom.operators import sweep
    monkeypatch.setattr(sweep, "TILE_LIMIT", tile_limit)
    monkeypatch.setattr(sweep, "TRIED", 64)
    monkeypatch.setattr(sweep, "TILE", 50)
    rows = [(None if r[0] == 0 else r[0], r[1], r[2], *(v - 300 for v in r[3:])) for r in random_boxes(13, 400, 40, 700)]
    # Copies of ids, of corners and of whole rows, a wide and a tall box, boxes that begin or end together.
    rows += rows[:30] + [(None, 1_000 + i, 0, *rows[i][3:]) for i in range(20)]
    rows += [(None, 2_000, 0, -900, 0, 900, 2), (None, 2_001, 0, 40, -900, 42, 900), (None, 2_002, 0, 900, 0, 950, 2)]
    odd = [(None, None, 0, 0, 0, 50, 50), (None, 3_000, 0, 5, 5, 5, 50), (None, 3_001, 0, 50, 0, 0, 50), (None, 3_002, 0, 0, 0, None, 9)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    for least, (num, den) in {None: (0, 1), 0.1: (1, 10), 0.5: (1, 2)}.items():
        got = overlap.overlapping_pairs(df, df, ["img"], "box", "box", least, once=True, group_limit=30)
        want = [(a[0], a[1], b[1], overlap_of(a[3:], b[3:]), joint_of(a[3:], b[3:])) for a in rows for b in rows
                if a[0] == b[0] and a[1] < b[1] and overlap_of(a[3:], b[3:]) > 0
                and overlap_of(a[3:], b[3:]) * den >= joint_of(a[3:], b[3:]) * num]
        found = got.collect()
        assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
        assert all(r.iou == r.overlap / r.joint for r in found)
    # On the grid every box of a tile was tried with every other.
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().toString()


def test_sides_whose_areas_pass_a_bigint_and_fractions_stay_on_the_grid(spark):
    rows = [(1, i, 0, i, 0, (1 << 33) + i, 1) for i in range(4)]
    big = spark.createDataFrame(rows, SCHEMA)
    got = overlap.overlapping_pairs(big, big, ["img"], "box", "box", 0.1, once=True, group_limit=2).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    some = spark.createDataFrame(random_boxes(14, 90, 0, 300), SCHEMA)
    halves = some.select("img", "box", *[(F.col(k) / 2).alias(k) for k in ("x1", "y1", "x2", "y2")])
    pairs = lambda d: sorted((r.a, r.b) for r in overlap.overlapping_pairs(
        d, d, ["img"], "box", "box", 0.1, once=True, group_limit=20).collect())
    assert pairs(halves) == pairs(some)


@pytest.mark.parametrize("limit", [10_000, 40])
def test_all_levels_in_one_pass_equal_each_level_alone(spark, limit):
    rng = random.Random(12)
    truth = [(i % 3, i, x, y, x + 50 + rng.randrange(20), y + 60) for i in range(240)
             for x, y in [(rng.randrange(300), rng.randrange(300))]]
    preds = [(t[0], t[1] * 10 + j, rng.randrange(40), *(v + rng.randrange(-9, 10) for v in t[2:])) for t in truth for j in range(3)]
    p = spark.createDataFrame(preds, SCHEMA).withColumn("cls", F.lit(1))
    t = spark.createDataFrame(truth, "img long, box long, x1 long, y1 long, x2 long, y2 long").withColumn("cls", F.lit(1))
    got = {(r.img, r.box): r.truths for r in evaluate.match_levels(p, t, group_limit=limit).collect()}
    assert len(got) == len(preds)
    for k, level in enumerate(evaluate.LEVELS):
        want = plain_match(preds, truth, level)
        assert {key: truths[k] for key, truths in got.items()} == {key[:2]: v for key, v in want.items()}, level


def test_value_buckets_follow_the_rows_and_rise_with_the_value(spark):
    from boxloom.plans.running import value_bucket

    rows = [(None if i % 50 == 0 else float(i * 7919 % 1000),) for i in range(2_000)]
    df = spark.createDataFrame(rows, "v double")
    got = df.select("v", value_bucket(df, F.col("v"), rows=100).alias("b")).collect()
    by = sorted((r.v is not None, r.v or 0, r.b) for r in got)
    assert [b for *_, b in by] == sorted(b for *_, b in by) and by[0][2] == -1
    assert 12 <= len({r.b for r in got if r.v is not None}) <= 20
    assert df.select(value_bucket(df, F.col("v"), rows=5_000).alias("b")).distinct().count() == 1


def test_a_chain_takes_rounds_by_blocks_not_by_links(spark, monkeypatch):
    from boxloom.operators import suppress
    labels = []
    plain = suppress.durable
    monkeypatch.setattr(suppress, "durable", lambda df, label: labels.append(label) or plain(df, label))
    chain = [(1, i, 20_000 - i, 60 * i, 0, 60 * i + 100, 50) for i in range(10_000)]
    kept = suppress._by_pairs(spark.createDataFrame(chain, SCHEMA), ["img"], BY_SCORE(), 0.2)
    assert {r.box for r in kept.collect()} == set(range(0, 10_000, 2))
    assert labels.count("decided") < 20


def test_the_query_on_crowded_canvases_equals_a_plain_loop(spark):
    import numpy as np

    import __spark_entry__ as entry
    from workload import views as V

    sf = "/root/testdata/sf0.001"
    rows = V.crowded(spark, sf).select("img", "box", "score", "x1", "y1", "x2", "y2").toPandas()
    want = set()
    for img, page in rows.sort_values(["score", "box"], ascending=[False, True]).groupby("img"):
        kept = np.zeros((0, 4))
        for box, corners in zip(page["box"], page[["x1", "y1", "x2", "y2"]].to_numpy(float)):
            wide = np.minimum(kept[:, 2:], corners[2:]) - np.maximum(kept[:, :2], corners[:2])
            both = np.clip(wide, 0, None).prod(axis=1)
            joint = (kept[:, 2:] - kept[:, :2]).prod(axis=1) + (corners[2:] - corners[:2]).prod() - both
            if not (both * 4 > joint).any():
                kept = np.vstack([kept, corners])
                want.add((img, box))
    assert {(r.img, r.box) for r in entry.queries()["crowded_slots"](spark, sf).collect()} == want


def test_dense_canvas_is_thinned_before_pairs(spark, monkeypatch):
    from boxloom.operators import suppress
    edges = []
    plain = suppress.durable

    def counted(df, label="step"):
        table = plain(df, label)
        if label == "suppressing":
            edges.append(table.count())
        return table

    monkeypatch.setattr(suppress, "durable", counted)
    monkeypatch.setattr(suppress, "_CHUNK", 20)
    rows = random_boxes(11, 4_000, n_cold=0)
    rows += [(0, 5_000, 299, 0, 0, 900, 40), (0, 5_001, 150, 5, 2, 880, 41), (0, 5_002, 1, 30, 30, 30, 20), *rows[:40]]
    got = keep_best(spark.createDataFrame(rows, SCHEMA), ["img"], BY_SCORE(), 0.25, group_limit=50)
    assert {(r.img, r.box) for r in got.collect()} == greedy(rows, 1, 4)
    assert sum(edges) < 3 * len(rows)


def test_matching_in_blocks_equals_a_plain_loop(spark, monkeypatch):
    from boxloom.operators import match_blocks
    monkeypatch.setattr(match_blocks, "BLOCK", 60)
    monkeypatch.setattr(match_blocks, "TRIED", 50)
    rng = random.Random(12)
    truth, preds = [], []
    for i in range(700):
        x, y, w, h = rng.randrange(700), rng.randrange(700), rng.randrange(40, 90), rng.randrange(40, 120)
        truth.append((i % 2, i, x, y, x + w, y + h))
        dx, dy = rng.randrange(-12, 13), rng.randrange(-12, 13)
        preds.append((i % 2, 1000 + i, rng.randrange(40), x + dx, y + dy, x + w + dx, y + h + dy))
    preds += [(0, 5_000, 41, 0, 0, 700, 700), (1, 5_001, 3, 9, 9, 9, 30)]
    truth += [(0, 6_000, 5, 5, 650, 720)]
    twice = (preds + preds[:30], truth + truth[:30])
    for scale in (1, 0.5):
        cut = lambda rows, n: [(*r[:n], *[c * scale for c in r[n:]]) for r in rows]
        kind = "long" if scale == 1 else "double"
        corners = ", ".join(f"{c} {kind}" for c in ("x1", "y1", "x2", "y2"))
        p = spark.createDataFrame(cut(twice[0], 3), f"img long, box long, score long, {corners}")
        t = spark.createDataFrame(cut(twice[1], 2), f"img long, box long, {corners}")
        got = match_blocks.match_in_blocks(p, t, ["img"], (50, 75)).collect()
        assert len(got) == len(twice[0])
        for k, level in enumerate((50, 75)):
            want = plain_match(preds, truth, level)
            assert {(r.img, r.box, level): r.truths[k] for r in got} == want


def test_a_chain_of_displaced_predictions_takes_few_rounds(spark, monkeypatch):
    from boxloom.operators import match_blocks
    written = []
    for module in (evaluate, match_blocks):
        plain = module.durable
        monkeypatch.setattr(module, "durable", lambda df, label="step", plain=plain: written.append(label) or plain(df, label))
    monkeypatch.setattr(match_blocks, "BLOCK", 100)
    # Every prediction likes its own truth box best and loses it to the one before.
    truth = [(0, i, 60 * i, 0, 60 * i + 100, 50) for i in range(1, 151)]
    preds = [(0, i, 1_000 - i, 60 * i + 29, 0, 60 * i + 129, 50) for i in range(150)]
    got = evaluate.match_levels(
        spark.createDataFrame(preds, SCHEMA), spark.createDataFrame(truth, SCHEMA.replace("score long, ", "")), (50,), ("img",), 20)
    assert {r.box: r.truths[0] for r in got.collect()} == {i: i + 1 for i in range(150)}
    assert len(written) < 40


@pytest.mark.parametrize(("levels", "scale"), [((50, 75, 95), 1), ((75, 30), 0.37), ((100,), 1), ((5,), 0.5)])
def test_near_pairs_leave_none_out(levels, scale):
    import numpy as np

    from boxloom.operators import match_blocks
    rng = np.random.default_rng(7)

    def some(n):
        low = rng.integers(0, 200, (n, 2))
        return np.hstack([low, low + np.exp(rng.uniform(0, 4, (n, 2))).astype(int) + 1]) * scale

    preds, truth = some(500), some(500)
    truth[:200] = preds[:200] + rng.integers(0, 2, (200, 1)) * scale
    wide = np.minimum(preds[:, None, 2:], truth[None, :, 2:]) - np.maximum(preds[:, None, :2], truth[None, :, :2])
    both = np.where((wide > 0).all(axis=2), wide.prod(axis=2), 0)
    area = [(b[:, 2:] - b[:, :2]).prod(axis=1) for b in (preds, truth)]
    joint = area[0][:, None] + area[1][None, :] - both
    bits = sum(((both > 0) & (both * 100 >= joint * v)).astype(int) << k for k, v in enumerate(levels))
    got = set()
    for _, _, p, t, b in match_blocks.near_pairs(preds, truth, np.arange(500), levels):
        got |= set(zip(p.tolist(), t.tolist(), b.tolist()))
    assert got == {(p, t, bits[p, t]) for p, t in zip(*np.nonzero(bits))}


def test_few_predictions_wait_for_other_blocks(spark, monkeypatch):
    from boxloom.operators import match_blocks
    waiting = []
    plain = match_blocks.durable

    def counted(df, label="step"):
        table = plain(df, label)
        if label == "settled":
            waiting.append(table.filter("NOT done").count())
        return table

    monkeypatch.setattr(match_blocks, "durable", counted)
    monkeypatch.setattr(match_blocks, "BLOCK", 400)
    rng = random.Random(3)
    # Dense: every prediction has its own truth box, and several others in reach of it.
    truth = [(0, i, x, y, x + 100, y + 100) for i in range(2_000)
             for x, y in [(rng.randrange(1_500), rng.randrange(1_500))]]
    preds = [(0, i, rng.randrange(1_000), *corners) for _, i, *corners in truth]
    p = spark.createDataFrame(preds, SCHEMA)
    t = spark.createDataFrame(truth, SCHEMA.replace("score long, ", ""))
    got = match_blocks.match_in_blocks(p, t, ["img"], (50, 75)).collect()
    for k, level in enumerate((50, 75)):
        assert {(r.img, r.box, level): r.truths[k] for r in got} == plain_match(preds, truth, level)
    assert waiting[0] < 0.25 * len(preds)


def test_truth_rows_given_twice_count_once_with_long_ids(spark):
    from boxloom.operators import match_blocks
    # Numbers that differ in the last bit only, on one spot, with fractional corners.
    first = 1 << 60
    truth = [(0, first + i, 0.5, 0.5, 90.5, 90.5) for i in (0, 1, 1, 0)]
    preds = [(0, i, 10 - i, 0.5, 0.5, 90.5, 90.5) for i in range(3)]
    corners = "x1 double, y1 double, x2 double, y2 double"
    got = match_blocks.match_in_blocks(
        spark.createDataFrame(preds, f"img long, box long, score long, {corners}"),
        spark.createDataFrame(truth, f"img long, box long, {corners}"), ["img"], (50,)).collect()
    assert {r.box: r.truths[0] for r in got} == {0: first, 1: first + 1, 2: None}
