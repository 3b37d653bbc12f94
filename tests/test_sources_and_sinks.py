"""Readers on small written files, bad lines, and writers read back."""

import json

import pytest
from pyspark.sql import functions as F

from boxloom.functions.geometry import Label
from boxloom.operators import coverage as C, labels as L, lookup, registry as R
from boxloom.sinks import tables as S
from boxloom.sources import catalog, class_lists, detections, images, label_files, training_logs


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


@pytest.fixture
def dataset(tmp_path):
    good = "0 0.5439447628973423 0.18 0.08 0.11"
    put(tmp_path / "train/labels/a b+c.txt", f"{good}\n3 0.1 0.2 0.3 0.4")
    put(tmp_path / "train/labels/bad.TXT", f"1 .1 .2 .3 .4\r\n  \r\n5 1 2 3\r\nx .1 .2 .3 .4\r\n+2 .5 .5 .5 .5\r\n")
    put(tmp_path / "train/labels/empty.txt", "")
    put(tmp_path / "train/labels/notes.md", good)
    put(tmp_path / "test/labels/t.rf.0.txt", "1_0 .1 .2 .3 .4\n-1 .1 .2 .3 .4\n")
    return tmp_path


def ids(df):
    return sorted((r.split, r.stem, r.box_no, r.class_id) for r in df.collect())


def test_label_scan_modes(spark, dataset):
    root = str(dataset)
    base = [("test", "t.rf.0", 1, 10), ("test", "t.rf.0", 2, -1), ("train", "a b+c", 1, 0), ("train", "a b+c", 2, 3)]
    assert ids(label_files.read_labels(spark, root)) == base + [("train", "bad", 1, 1), ("train", "bad", 5, 2)]
    assert ids(label_files.read_labels(spark, root, "abort_file")) == base + [("train", "bad", 1, 1)]
    with pytest.raises(Exception, match="bad class"):
        label_files.read_labels(spark, root, "failfast").collect()
    lax = label_files.read_labels(spark, root, "failfast", splits=("test", "valid"))
    assert ids(lax) == base[:2]
    first = label_files.read_labels(spark, root).filter("stem = 'a b+c' AND box_no = 1").first()
    assert first.cx == 0.5439447628973423


def test_large_label_files_are_numbered_like_small_ones(spark, dataset):
    root = str(dataset)
    key = lambda df: sorted((r.split, r.stem, r.line_no, r.line) for r in df.collect() if r.line.strip())
    whole = key(label_files.read_label_lines(spark, root))
    assert key(label_files.read_label_lines(spark, root, whole_bytes=10)) == whole
    assert len(whole) == 8


def test_label_file_list_counts_empty_files(spark, dataset):
    files = label_files.label_file_list(spark, str(dataset))
    assert sorted((r.split, r.stem) for r in files.collect()) == [
        ("test", "t.rf.0"), ("train", "a b+c"), ("train", "bad"), ("train", "empty")]
    stats = C.split_stats(files, label_files.read_label_lines(spark, str(dataset)))
    assert {r.split: (r.files, r.labels) for r in stats.collect()} == {"train": (3, 6), "test": (1, 2)}


def test_missing_dataset_is_empty(spark, tmp_path):
    assert label_files.read_labels(spark, str(tmp_path / "none")).count() == 0
    assert label_files.label_file_list(spark, str(tmp_path / "none")).count() == 0


def test_catalog_keeps_order_and_skips_cards_without_printings(spark, tmp_path):
    cards = [{"name": "B", "printings": [{"id": "X1", "set_id": "WTR"}, {"id": "X2", "image_url": "u2"}]},
             {"name": "A"}, {"name": "C", "printings": [], "other": 1}, {"printings": [{"id": "X3"}]}]
    put(tmp_path / "card.json", json.dumps(cards))
    got = catalog.read_cards(spark, str(tmp_path / "card.json"))
    assert [(r.card_no, r.name) for r in got.orderBy("card_no").collect()] == [(0, "B"), (1, "A"), (2, "C"), (3, None)]
    flat = catalog.printings(got).orderBy("card_no", "pos").collect()
    assert [(r.card_no, r.pos, r.id, r.set_id, r.image_url) for r in flat] == [
        (0, 0, "X1", "WTR", None), (0, 1, "X2", None, "u2"), (3, 0, "X3", None, None)]


def test_catalog_order_decides_between_exact_and_loose_match(spark):
    schema = "card_no long, name string, printings array<struct<id:string,set_id:string,image_url:string>>"
    cards = spark.createDataFrame([
        (0, "Hunter's Eye", []), (1, "Hunters Eye!", [("a", "S", "loose")]),
        (2, "Hunters Eye", [("b", "S", "exact")]), (3, "Only URL-less", [("c", "S", None), ("d", "S", "second")]),
        (4, "Été", [("e", "S", "accent")])], schema)
    names = spark.createDataFrame([("Hunters_Eye",), ("Only_URL-less",), ("été",), ("Ete",)], "name string")
    got = {r.name: (r.card_no, r.image_url) for r in lookup.urls_by_name(names, cards).collect()}
    assert got == {"Hunters_Eye": (1, "loose"), "Only_URL-less": (3, None), "été": (4, "accent"), "Ete": (None, None)}


def test_class_list_import(spark, tmp_path):
    put(tmp_path / "c.json", json.dumps({"names": ["A_WTR1", "B", "A_SEA2", "C"]}))
    got = class_lists.read_class_list(spark, str(tmp_path / "c.json"))
    assert sorted(map(tuple, got.collect())) == [(0, "A"), (1, "B"), (2, "C")]
    put(tmp_path / "d.json", json.dumps({"nc": 3}))
    assert class_lists.read_class_list(spark, str(tmp_path / "d.json"), "empty").count() == 0
    with pytest.raises(Exception, match="no names"):
        class_lists.read_class_list(spark, str(tmp_path / "d.json")).collect()


def test_training_logs(spark, tmp_path):
    header = ",".join(training_logs.METRIC_COLUMNS)
    put(tmp_path / "train1/results.csv", header + "\n1,674.894,0.4,3.4,0.8,0.02,0.39,0.04,0.043,0.3,3.3,0.8,1.4e-05,1.4e-05,1.4e-05\n")
    put(tmp_path / "train2/results.csv", header + "\n" + "\n".join(f"{i},{i * 2},1,1,1,.5,.5,.5,.5,1,1,1,0,0,0" for i in (1, 2, 3)))
    metrics = training_logs.read_metrics(spark, str(tmp_path / "*/results.csv"))
    assert metrics.columns[:3] == ["run", "epoch", "time"] and "metrics_map50_95" in metrics.columns
    first = metrics.filter("run = 'train1'").first()
    assert (first.time, first.metrics_map50, first.lr_pg2) == (674.894, 0.04, 1.4e-05)
    put(tmp_path / "train1/args.yaml", "task: detect\ntime: null\nepochs: 100\nempty: \nlr0: 0.01\n  nested: 1\n")
    rows = training_logs.read_settings(spark, str(tmp_path / "*/args.yaml"))
    assert {r.key: r.value for r in rows.collect()} == {
        "task": "detect", "time": None, "epochs": "100", "empty": "", "lr0": "0.01"}
    typed = training_logs.typed_settings(rows, {"epochs": "int", "lr0": "double", "time": "int"}).first()
    assert (typed.run, typed.epochs, typed.lr0, typed.time) == ("train1", 100, 0.01, None)


def test_image_inventory(spark, tmp_path):
    for name in ("train/images/a.PNG", "train/images/b.jpeg", "test/images/c.txt", "SEA/x_SEA1.png", "SEA/y.jpg"):
        put(tmp_path / name, "x")
    paths = images.list_files(spark, [str(tmp_path)])
    assert paths.columns == ["path", "bytes"]
    assert sorted(map(tuple, images.split_images(paths).collect())) == [("train", "a", "a.PNG"), ("train", "b", "b.jpeg")]
    assert list(map(tuple, images.set_images(paths, ("SEA",)).collect())) == [("SEA", "x_SEA1.png")]
    counted = C.images_per_split(images.split_images(paths))
    assert {r.split: r.n for r in counted.collect()} == {"train": 2, "valid": 0, "test": 0}


def test_written_tables_read_back(spark, tmp_path):
    labels = spark.createDataFrame([("train", "a", 1, 3, .5, .5, .25, .125), ("train", "a", 0, 1, .1, .2, .3, .4), ("test", "b", 0, 2, 1., 0., .5, .5)],
                                   "split string, stem string, box_no long, class_id long, cx double, cy double, w double, h double")
    images = labels.select("split", "stem").union(spark.createDataFrame([("valid", "bare")], "split string, stem string"))
    S.write_labels(labels, images, str(tmp_path / "l"))
    texts = spark.read.parquet(str(tmp_path / "l"))
    assert [r.text for r in texts.filter("stem = 'bare'").collect()] == [""]
    lines = texts.select("split", "stem", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    again = L.parse_lines(lines).select(labels.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, labels.collect()))

    registry = spark.createDataFrame([(1, "b"), (0, "a")], "class_id long, name string")
    S.write_manifest(S.manifest(registry, "C:\\x\\y"), str(tmp_path / "m"))
    row = spark.read.json(str(tmp_path / "m")).first()
    assert (row.val, row.nc, row.names) == ("C:/x/y/valid/images", 2, ["a", "b"])

    target = S.write_registry(registry, str(tmp_path / "r"), "1")
    assert sorted(map(tuple, class_lists.read_registry(spark, target).collect())) == [(0, "a"), (1, "b")]
    with pytest.raises(Exception):
        S.write_registry(registry, str(tmp_path / "r"), "1")

    cov = C.coverage(registry, C.label_counts(labels))
    S.write_coverage(cov, str(tmp_path / "c"))
    S.write_coverage(cov.filter("split = 'train'").withColumn("n", F.lit(9).cast("bigint")), str(tmp_path / "c"))
    stored = {(r.class_id, r.split): r.n for r in class_lists.read_coverage(spark, str(tmp_path / "c")).collect()}
    assert stored == {(0, "train"): 9, (1, "train"): 9, (0, "valid"): 0, (1, "valid"): 0, (0, "test"): 0, (1, "test"): 0}

    usage = R.class_usage(registry, spark.createDataFrame([(1,)], "class_id long"))
    S.write_usage_report(S.usage_report(usage), str(tmp_path / "u"))
    rows = spark.read.csv(str(tmp_path / "u"), header=True).collect()
    assert [(r.status, r.name, r.total, r.n_used) for r in rows] == [("used", "b", "2", "1"), ("unused", "a", "2", "1")]

    boxes = spark.createDataFrame([("i", 1, 0., 1., 2., 3.), ("i", 0, 5., 5., 6., 6.)], "image string, slot int, x1 double, y1 double, x2 double, y2 double")
    every = spark.createDataFrame([("i",), ("empty",)], "image string")
    S.write_slot_records(S.slot_records(boxes, every, "image", "slot"), str(tmp_path / "s"))
    recs = {r.image: r for r in spark.read.json(str(tmp_path / "s")).collect()}
    assert recs["i"].slots == recs["i"].candidates == [[5., 5., 6., 6.], [0., 1., 2., 3.]]
    assert recs["empty"].slots == recs["empty"].candidates == []


def test_unturned_lines_keep_their_tokens(spark):
    lines = spark.createDataFrame([("train", "a", i, x) for i, x in enumerate(
        ["3 0.1 .25 1e-1 0.20000000000000001", "odd line", "9 0.1 0.1 0.1 0.1", "3 a b c d"])],
        "split string, stem string, line_no long, line string")
    ids = spark.createDataFrame([(3, 70)], "old_id long, class_id long")
    got = {r.box_no: r.line for r in S.rewritten_lines(lines, ids).collect()}
    assert got == {0: "70 0.1 .25 1e-1 0.20000000000000001", 1: "odd line", 3: "3 a b c d"}
    turned = {r.box_no: r.line for r in S.rewritten_lines(lines, ids, 90).collect()}
    assert turned[0] == "70 0.250000 0.900000 0.200000 0.100000" and turned[1] == "odd line"


def test_class_ids_beyond_bigint_do_not_stop_a_file(spark):
    lines = spark.createDataFrame([("train", "a", i, x) for i, x in enumerate(
        ["1 0 0 1 1", "99999999999999999999 0 0 1 1", "2 0 0 1 1", "x 0 0 1 1", "3 0 0 1 1"])],
        "split string, stem string, line_no long, line string")
    assert [r.class_id for r in L.parse_lines(lines).orderBy("box_no").collect()] == [1, 2, 3]
    assert [r.class_id for r in L.parse_lines(lines, "abort_file").orderBy("box_no").collect()] == [1, 2]
    with pytest.raises(Exception, match="bad class"):
        L.parse_lines(lines, "failfast").collect()


def test_strict_class_check_fails_on_unknown_and_negative_ids(spark):
    registry = spark.createDataFrame([(0, "a"), (1, "b")], "class_id long, name string")
    for bad in (2, -1):
        labels = spark.createDataFrame([(0,), (bad,)], "class_id long")
        assert [r.class_id for r in L.unknown_class_ids(labels, registry).collect()] == [bad]
        with pytest.raises(Exception, match="out of range"):
            L.reject_unknown_classes(labels, registry).collect()
    none = C.used_id_range(spark.createDataFrame([], "class_id long")).first()
    assert (none.n_ids, none.min_id, none.max_id) == (0, None, None)


def test_detections_read_by_schema(spark, tmp_path):
    from boxloom.schemas import DETECTION
    spark.createDataFrame([], DETECTION).write.parquet(str(tmp_path / "d"))
    assert detections.read_detections(spark, str(tmp_path / "d")).schema == DETECTION
    assert detections.stream_detections(spark, str(tmp_path / "d"), 1).isStreaming


def test_lines_of_white_space_are_no_labels(spark):
    files = spark.createDataFrame([("train", "a"), ("test", "b")], "split string, stem string")
    lines = spark.createDataFrame([("train", "a", 1, "\t"), ("train", "a", 2, " \x0b\f "), ("train", "a", 3, "\t1 2")],
                                  "split string, stem string, line_no long, line string")
    assert {r.split: (r.files, r.labels) for r in C.split_stats(files, lines).collect()} == {"train": (1, 1), "test": (1, 0)}
