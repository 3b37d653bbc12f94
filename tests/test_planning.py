"""Planning against plain loops, and evaluation against worked cases."""

import random

import pytest

from pyspark.sql import functions as F

from boxloom.operators import evaluate, planning, registry as R, runs
from boxloom.plans.generation import plan_by_files, plan_dataset
from boxloom.sources import training_logs  # noqa: F401


def test_exact_split_sizes(spark):
    for n, sizes in ((51, (35, 10, 6)), (90, (62, 18, 10)), (3, (2, 0, 1))):
        files = spark.createDataFrame([(f"f{i}",) for i in range(n)], "file string")
        got = planning.split_files(files, "file", "s")
        counts = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
        assert tuple(counts.get(s, 0) for s in ("train", "valid", "test")) == sizes
        assert sorted(got.collect()) == sorted(planning.split_files(files.repartition(7), "file", "s").collect())


def test_split_quota_equals_a_greedy_loop(spark):
    rng = random.Random(3)
    for case in range(8):
        counts = {s: rng.randrange(40) for s in ("train", "valid", "test")}
        opened = ("train", "valid", "test") if case < 5 else tuple(rng.sample(["train", "valid", "test"], 2))
        n = rng.randrange(1, 90)
        got = planning.split_quota(spark, n, counts, opened).orderBy("image_no").collect()
        assert [r.image_no for r in got] == list(range(n))
        step, state, want = {"train": 2, "valid": 7, "test": 14}, dict(counts), []
        for _ in range(n):
            s = min((s for s in step if s in opened), key=lambda s: (state[s] * step[s], list(step).index(s)))
            state[s] += 1
            want.append(s)
        assert [r.split for r in got] == want
    assert planning.split_quota(spark, 5, {}, ()).count() == 0


def test_class_quota_levels_the_lowest_classes(spark):
    rng = random.Random(4)
    rows, slots = [], []
    for split in ("train", "valid", "test"):
        slots.append((split, rng.randrange(1, 120)))
        rows += [(split, c, rng.randrange(15), rng.randrange(60)) for c in range(23)]
    counts = spark.createDataFrame(rows, "split string, class_id long, n long, total long")
    quota = planning.class_quota(counts, spark.createDataFrame(slots, "split string, slots long"), "s").collect()
    for split, wanted in slots:
        have = {c: n for s, c, n, _ in rows if s == split}
        plain = sorted(have.values())
        for _ in range(wanted):
            plain[0] += 1
            plain.sort()
        given = {r.class_id: r.quota for r in quota if r.split == split}
        assert sum(given.values()) == wanted
        assert sorted(n + given.get(c, 0) for c, n in have.items()) == plain


def test_seats_follow_need_and_mark_the_minimum(spark):
    quotas = spark.createDataFrame([("train", 1, 0, 5, 3), ("train", 2, 2, 1, 2)], "split string, class_id long, n long, total long, quota long")
    got = planning.class_seats(quotas, "s", makeup_min=2).orderBy("slot_no").collect()
    assert [(r.slot_no, r.class_id, r.level, r.makeup) for r in got] == [
        (0, 1, 0, True), (1, 1, 1, True), (2, 2, 2, False), (3, 1, 2, False), (4, 2, 3, False)]


def test_a_plan_reruns_alike_and_fills_every_slot(spark):
    templates = spark.createDataFrame([("train", "a"), ("train", "b"), ("valid", "c"), ("test", "e")], "split string, stem string")
    labels = spark.createDataFrame(
        [(s, t, i, .1 * i, .5, .1, .2) for s, t, n in (("train", "a", 3), ("train", "b", 2), ("valid", "c", 4)) for i in range(n)],
        "split string, stem string, box_no long, cx double, cy double, w double, h double")
    counts = spark.createDataFrame([(s, c, 0, 0) for s in ("train", "valid", "test") for c in range(3)], "split string, class_id long, n long, total long")
    quota = planning.split_quota(spark, 20, {})

    def run(parts):
        plan = plan_dataset(quota.repartition(parts), templates, labels.repartition(parts), counts, "seed")
        return sorted(plan.images.collect()), sorted(plan.labels.collect())

    images, boxes = run(1)
    assert (images, boxes) == run(5)
    size = {"a": 3, "b": 2, "c": 4, "e": 0}
    assert len(images) == 20 and len(boxes) == sum(size[r.template] for r in images)
    per_class = {}
    for r in boxes:
        if r.split == "train":
            per_class[r.class_id] = per_class.get(r.class_id, 0) + 1
    assert max(per_class.values()) - min(per_class.values()) <= 1


def test_registry_keeps_ids_and_appends(spark):
    known = spark.createDataFrame([(0, "b"), (4, "a")], "class_id long, name string")
    found = spark.createDataFrame([(7, "z"), (3, "a"), (5, "y")], "pos long, name string")
    got = R.extend_registry(known, found).collect()
    assert {r.name: (r.class_id, r.added) for r in got} == {
        "b": (0, False), "a": (4, False), "y": (5, True), "z": (6, True)}


def test_first_usable_printing_falls_to_the_next(spark):
    rows = [(1, "n", 0, "A", "SEA", "u0", False), (1, "n", 1, "B", "SEA", "u1", True), (1, "n", 2, "C", "SEA", "u2", True),
            (2, "m", 0, "D", "SEA", "", True), (2, "m", 1, "E", "WTR", "u", True), (3, "k", 0, "F", "SEA", None, True)]
    df = spark.createDataFrame(rows, "card_no long, name string, pos int, id string, set_id string, image_url string, ok boolean")
    got = planning.first_usable_printing(df, "sea", F.col("ok")).collect()
    assert [(r.card_no, r.id, r.name) for r in got] == [(1, "B", "n")]
    assert planning.first_usable_printing(df, "sea").first().id == "A"


def test_images_without_labels_are_carried(spark):
    assigned = spark.createDataFrame([("a", "train"), ("b", "test")], "stem string, split string")
    labels = spark.createDataFrame([("a", 1), ("a", 2)], "stem string, class_id long")
    got = planning.carry_labels(assigned, labels).collect()
    assert sorted((r.stem, r.split, r.class_id or 0) for r in got) == [("a", "train", 1), ("a", "train", 2), ("b", "test", 0)]


def test_carried_labels_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    assigned = spark.createDataFrame([(f"i{n}", "train") for n in range(9)] + [(None, "test")], "stem string, split string")
    labels = spark.createDataFrame([(f"i{n % 6}", n) for n in range(60)] + [("else", 60), (None, 61)], "stem string, class_id long")
    got = planning.carry_labels(assigned, labels.mapInPandas(counted, labels.schema)).collect()
    assert read.value == 62
    want = [(f"i{n % 6}", "train", n) for n in range(60)] + [(f"i{n}", "train", None) for n in (6, 7, 8)] + [(None, "test", 61)]
    assert sorted(map(str, want)) == sorted(str((r.stem, r.split, r.class_id)) for r in got)


def test_average_precision_of_a_worked_case(spark):
    # Four truths; hits at ranks 1, 3 and 4: precision 1, 2/3, 3/4, envelope 1, 3/4, 3/4.
    truth = spark.createDataFrame([(i, 1) for i in range(4)] + [(9, 2)], "box long, cls long")
    matches = spark.createDataFrame(
        [(50, 1, .9, 0), (50, 1, .8, None), (50, 1, .7, 1), (50, 1, .6, 2), (50, 1, .5, None)],
        "level int, cls long, score double, truth long")
    got = evaluate.average_precision(matches, truth, ["cls"], levels=(50,))
    assert {r.cls: r.ap for r in got.collect()} == {1: (1 + .75 + .75) / 4, 2: 0.0}
    points = evaluate.curve(matches, truth, ["cls"])
    best = evaluate.best_threshold(points, ["cls"]).first()
    assert (best.score, round(best.f1, 9)) == (.6, .75)


def test_run_reports(spark):
    rows = [("r", e, float(t), m) for e, t, m in ((1, 10, .1), (2, 25, .5), (3, 31, .4), (4, 50, .5))]
    df = spark.createDataFrame(rows, "run string, epoch int, time double, map50 double")
    got = runs.epoch_report(df, "time", "map50").orderBy("epoch").collect()
    assert [(r.epoch_time, r.best_so_far) for r in got] == [(10, .1), (15, .5), (6, .5), (19, .5)]
    best = runs.best_epochs(df, ["map50"]).first()
    assert (best.epoch, best.value) == (2, .5)


def test_seats_by_number_equal_seats_by_sort(spark, monkeypatch):
    rng = random.Random(9)
    for case in range(3):
        counts = spark.createDataFrame(
            [(s, c, rng.randrange(12), rng.randrange(40)) for s in ("train", "test") for c in range(1 + 17 * case)],
            "split string, class_id long, n long, total long")
        slots = spark.createDataFrame([("train", rng.randrange(1, 300)), ("test", 3)], "split string, slots long")
        quotas = planning.class_quota(counts, slots, "s")
        got = sorted(planning.class_seats(quotas, "s", makeup_min=7).collect())
        monkeypatch.setattr(planning, "seat_index", lambda *a: None)
        want = sorted(planning.class_seats(quotas, "s", makeup_min=7).collect())
        monkeypatch.undo()
        assert got == want and len(got) == sum(r.slots for r in slots.collect())
    assert planning.class_seats(quotas.limit(0), "s").count() == 0


def test_drawing_loses_no_row_without_a_pool(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id long, k string")
    pool = spark.createDataFrame([("a", n, f"p{n}", 3) for n in range(3)], "k string, no long, what string, size long")
    pick = lambda on_miss: planning.draw(rows, pool, ["k"], "no", "size", "s", ["id"], on_miss=on_miss)
    kept = {r.id: r.what for r in pick("keep").collect()}
    assert len(kept) == 10 and all((w is None) == (i % 2 == 1) for i, w in kept.items())
    assert pick("drop").count() == 5
    with pytest.raises(Exception, match="nothing to draw from"):
        pick("fail").collect()


def test_images_of_a_split_without_templates_are_planned_elsewhere(spark):
    templates = spark.createDataFrame([("valid", "c"), ("test", "e")], "split string, stem string")
    boxes = spark.createDataFrame([("valid", "c", i, .1, .2, .3, .4) for i in range(4)] + [("test", "e", 0, .5, .5, .1, .1)],
                                  "split string, stem string, box_no long, cx double, cy double, w double, h double")
    registry = spark.createDataFrame([(5, "Ab"), (6, "Cd"), (7, "unused")], "class_id long, name string")
    files = spark.createDataFrame([("SEA", "Ab_SEA001.png"), ("WTR", "Ab_WTR001.png"), ("SEA", "Cd_SEA002.png"), ("SEA", "Cd.jpg")],
                                  "set_code string, file string")
    plan = plan_by_files(planning.split_quota(spark, 60, {}), templates, boxes, registry, files, "s")
    images, labels = plan.images.collect(), plan.labels.collect()
    assert sorted(r.image_no for r in images) == list(range(60)) and {r.split for r in images} == {"valid", "test"}
    size = {r.image_no: 4 if r.template == "c" else 1 for r in images}
    assert len(labels) == sum(size.values())
    named = {"Ab_SEA001.png": 5, "Ab_WTR001.png": 5, "Cd_SEA002.png": 6}
    assert {r.file for r in labels} == set(named) and all(named[r.file] == r.class_id for r in labels)
    with pytest.raises(ValueError):
        planning.fallback_splits(plan.images, templates.limit(0))
    with pytest.raises(Exception, match="unknown class"):
        plan_by_files(planning.split_quota(spark, 60, {}), templates, boxes, registry.limit(1), files, "s").labels.collect()
