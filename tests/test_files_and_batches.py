"""Label files, large catalogs, batch scoring and merged counts."""

import json
import random
from pathlib import Path

import pytest

from boxloom.operators import coverage as C
from boxloom.sinks.label_files import LabelFileWriter, write_label_files
from boxloom.sources import catalog, label_files
from boxloom.streaming import counting, scoring

TEXTS = "split string, stem string, text string"


def files_below(path):
    return {str(p.relative_to(path)): p.read_text() for p in Path(path).rglob("*") if p.is_file()}


def test_label_files_are_written_and_read_again(spark, tmp_path):
    texts = [("train", "a b+c", "1 0.5 0.5 0.1 0.2\n2 0.1 0.1 0.1 0.1"), ("test", "bare", ""), ("valid", "é", "3 0.5 0.5 0.5 0.5")]
    write_label_files(spark.createDataFrame(texts, TEXTS).repartition(3), str(tmp_path / "d"))
    assert files_below(tmp_path / "d") == {
        "train/labels/a b+c.txt": texts[0][2] + "\n", "test/labels/bare.txt": "", "valid/labels/é.txt": texts[2][2] + "\n"}
    got = {(r.split, r.stem, r.box_no, r.class_id) for r in label_files.read_labels(spark, str(tmp_path / "d")).collect()}
    assert got == {("train", "a b+c", 1, 1), ("train", "a b+c", 2, 2), ("valid", "é", 1, 3)}
    write_label_files(spark.createDataFrame([("test", "bare", "9 0 0 0 0")], TEXTS), str(tmp_path / "d"))
    assert files_below(tmp_path / "d")["test/labels/bare.txt"] == "9 0 0 0 0\n"


def test_a_failed_job_leaves_no_label_file(spark, tmp_path):
    texts = [("train", f"s{i}", f"{i}") for i in range(40)] + [("train", "no/name", "x")]
    with pytest.raises(Exception, match="no file name"):
        write_label_files(spark.createDataFrame(texts, TEXTS).coalesce(1), str(tmp_path / "d"))
    assert files_below(tmp_path / "d") == {}


def test_an_aborted_job_takes_back_what_its_tasks_wrote(tmp_path):
    writer = LabelFileWriter(str(tmp_path))
    done = writer.write(iter([{"split": "train", "stem": "a", "text": "1"}, {"split": "test", "stem": "b", "text": None}]))
    assert done.files == 2 and (tmp_path / "train/labels/a.txt").exists()
    writer.abort([done, None])
    assert files_below(tmp_path) == {}


def test_a_large_catalog_is_read_in_blocks(spark, tmp_path):
    rng = random.Random(6)
    odd = ['plain', 'brace } in {', 'quote " here', 'back \\ slash', 'both \\" }', '] , [', "", "é漢}"]
    cards = [{"name": rng.choice(odd), "other": {"deep": [{"x": "}"}, 1]},
              **({"printings": [{"id": f"I{i}", "set_id": rng.choice(odd), "image_url": None} for _ in range(rng.randrange(3))]} if i % 5 else {})}
             for i in range(300)]
    for k, part in enumerate((cards[:200], cards[200:], [])):
        (tmp_path / f"c{k}.json").write_text(json.dumps(part, indent=[None, 2, None][k], ensure_ascii=k == 0))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = catalog.read_large_cards(spark, str(tmp_path))
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
        rows = found.orderBy("card_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.card_no for r in rows] == list(range(300))
    assert [r.name for r in rows] == [c["name"] for c in cards]
    assert [None if r.printings is None else [p.asDict() for p in r.printings] for r in rows] == [c.get("printings") for c in cards]
    plain = catalog.read_cards(spark, str(tmp_path)).orderBy("card_no").collect()
    assert [(r.card_no, r.name, r.printings) for r in plain] == [(r.card_no, r.name, r.printings) for r in rows]


def calls_in(path):
    return sum(len(p.read_text().splitlines()) for p in Path(path).iterdir())


def counted_model(folder):
    def load():
        import os
        import uuid
        name = f"{folder}/{uuid.uuid4().hex}"

        def predict(contents):
            with open(name, "a") as out:
                out.write("call\n")
            if any(c == "boom" for c in contents):
                raise RuntimeError("model failed")
            assert os.path.exists(name)
            return [None if c == "?" else [(0, 0, len(c), 1, 7, .5)] for c in contents]
        return predict
    return load


def test_models_get_whole_batches_and_a_bad_image_is_found_by_halving(spark, tmp_path):
    rows = [(i, "boom" if i == 70 else "?" if i == 3 else None if i == 5 else "x" * i) for i in range(128)]
    df = spark.createDataFrame(rows, "image_id long, content string").coalesce(1)
    (tmp_path / "a").mkdir()
    got = scoring.score_batches(df, counted_model(str(tmp_path / "a")), "empty", 32).collect()
    assert {r.image_id: r.x2 for r in got} == {i: float(len(c)) for i, c in rows if c not in (None, "?", "boom")}
    # 127 images in 4 batches; the failing one is halved five times.
    assert calls_in(tmp_path / "a") == 4 + 2 * 5
    with pytest.raises(Exception, match="model failed"):
        scoring.score_batches(df, counted_model(str(tmp_path / "a")), "fail", 32).collect()
    with pytest.raises(Exception, match="2 images"):
        scoring.score_batches(df, lambda: lambda contents: [None], "fail", 2).collect()


def test_a_repeated_batch_changes_no_count(spark, tmp_path):
    rng = random.Random(1)
    rows = [[(rng.choice(["train", "test"]), rng.randrange(4)) for _ in range(30)] for _ in range(5)]
    path = str(tmp_path / "counts")
    frame = lambda part: spark.createDataFrame(part, "split string, class_id long")
    assert counting.latest_counts(spark, path).count() == 0
    for batch, part in enumerate(rows):
        counting.merge_batch(frame(part), batch, path)
        counting.merge_batch(frame(part), batch, path)
        want = C.label_counts(frame(sum(rows[:batch + 1], [])))
        got = counting.latest_counts(spark, path)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("split", "class_id", "n").collect()))
        assert len(list(Path(path).iterdir())) <= 2


def test_many_label_files_are_read_by_tasks_that_follow_the_cores(spark, tmp_path):
    folder = tmp_path / "train" / "labels"
    folder.mkdir(parents=True)
    for i in range(1_200):
        (folder / f"s {i}+.{'TXT' if i % 2 else 'txt'}").write_bytes(f"{i} 0 0 0 1\r\n{i} 0 0 0 2".encode())
    for name in ("_hidden.txt", ".hidden.txt", "other.csv"):
        (folder / name).write_text("1 0 0 0 0")
    (folder / "empty.txt").write_text("")
    (folder / "long.txt").write_text("7 0 0 0 0\n" * 30)
    lines = label_files.read_label_lines(spark, str(tmp_path), whole_bytes=100)
    got = {(r.stem, r.line_no, r.line) for r in lines.collect()}
    assert got == {(f"s {i}+", n, f"{i} 0 0 0 {n}") for i in range(1_200) for n in (1, 2)} | {
        ("long", n, "7 0 0 0 0") for n in range(1, 31)}
    usual = label_files.read_label_lines(spark, str(tmp_path))
    assert usual.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
