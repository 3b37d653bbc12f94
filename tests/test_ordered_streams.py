"""Streams whose rows come in any order and any cut into batches."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boxloom.operators.lookup import last_known
from boxloom.streaming import frames as FR
from boxloom.streaming import live, ordered
from boxloom.streaming.drain import drain, use_rocksdb
from tests.test_streaming import FRAMES, H, W, make_frames, plain_overlay

START = datetime(2024, 1, 1)


def written(spark, rows, schema, path, files, seed, end=None):
    """Shuffled rows in several files, and a last file that only moves the time."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.05)  # files are taken in order of their time stamp
    if end:
        spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(path)


def streamed(spark, schema, path, per_batch):
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


@pytest.mark.parametrize("per_batch", [1, None])
def test_overlay_of_shuffled_frames_is_the_same_under_any_batching(spark, tmp_path, per_batch):
    use_rocksdb(spark)
    rows = make_frames(3)
    end = (99, None, START + timedelta(days=2), None, None, None)
    written(spark, rows, FRAMES, str(tmp_path / "in"), 3, 5, end)
    frames = streamed(spark, FRAMES, str(tmp_path / "in"), per_batch).withColumn("shown", live.frame_boxes(F.col("boxes"), W, H))
    rule = live.OverlayMemory(frozenset({0, 1}), W, H)
    got = drain(ordered.overlay_in_order(frames, rule, "1 day"), "o").collect()
    spot = lambda r: None if r.overlay_x is None else (r.overlay_x, r.overlay_y)
    assert {(r.session_id, r.frame_no): (r.n_seen, r.n_hidden, r.box_no, spot(r)) for r in got} == plain_overlay(rows, {0, 1})
    assert sum(r.n_hidden for r in got) > 0 and sum(r.late for r in got) == 0


POINTER = "session_id long, event_id long, ts timestamp, px long, py long"
BEAT = "session_id long, frame_no long, ts timestamp"


@pytest.mark.parametrize("per_batch", [1, None])
def test_streamed_pointer_equals_the_table_form(spark, tmp_path, per_batch):
    use_rocksdb(spark)
    rng = random.Random(2)
    when = lambda: START + timedelta(seconds=rng.randrange(300))
    pointers = [(i % 3, i, when(), rng.randrange(99), rng.randrange(99)) for i in range(80)]
    frames = [(i % 4, i, when()) for i in range(90)]
    end = (99, None, START + timedelta(days=2))
    written(spark, pointers, POINTER, str(tmp_path / "p"), 2, 1, (*end, None, None))
    written(spark, frames, BEAT, str(tmp_path / "f"), 2, 2, end)
    got = drain(ordered.pointer_at_frames(
        streamed(spark, BEAT, str(tmp_path / "f"), per_batch), streamed(spark, POINTER, str(tmp_path / "p"), per_batch), "1 day"), "a")
    want = last_known(spark.createDataFrame(frames, BEAT), spark.createDataFrame(pointers, POINTER), "session_id", "ts",
                      {"px": 0, "py": 0}, rows=20).select("session_id", "frame_no", "px", "py")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 90


ROWS = "session_id long, frame_no long, ts timestamp, box_no long, class_id long, score double, x1 double, y1 double, x2 double, y2 double"
BEATS = "session_id long, frame_no long, ts timestamp, n_boxes long"


@pytest.mark.parametrize("per_batch", [1, None])
def test_newest_and_empty_frames_come_out_under_any_batching(spark, tmp_path, per_batch):
    use_rocksdb(spark)
    at = lambda n: START + timedelta(seconds=n)
    boxes = [(s, n, at(n), b, 1, .5, 0., 0., 1., 2.) for s in (1, 2) for n in range(12) for b in range(n % 4)]
    beats = [(s, n, at(n), n % 4) for s in (1, 2) for n in range(12)]
    written(spark, boxes + boxes[:5], ROWS, str(tmp_path / "b"), 2, 3)
    written(spark, beats, BEATS, str(tmp_path / "h"), 2, 4)
    got = drain(FR.assemble_frames(streamed(spark, ROWS, str(tmp_path / "b"), per_batch),
                                   streamed(spark, BEATS, str(tmp_path / "h"), per_batch), "1 hour"), "f").collect()
    assert len(got) == 24 and all(r.complete for r in got)
    assert {(r.session_id, r.frame_no): [b.box_no for b in r.boxes] for r in got} == {
        (s, n): list(range(n % 4)) for s in (1, 2) for n in range(12)}
    assert {r.ts for r in got if r.frame_no == 11} == {at(11)}


def test_frames_that_stay_incomplete_come_out_with_the_watermark(spark, tmp_path):
    use_rocksdb(spark)
    written(spark, [(1, 5, START, 0, 1, .5, 0., 0., 1., 1.)], ROWS, str(tmp_path / "b"), 1, 0)
    written(spark, [(1, 5, START, 3), (1, 6, START, 0), (7, 7, START + timedelta(hours=9), 0)], BEATS, str(tmp_path / "h"), 1, 0)
    got = drain(FR.assemble_frames(streamed(spark, ROWS, str(tmp_path / "b"), None),
                                   streamed(spark, BEATS, str(tmp_path / "h"), None), "1 hour"), "f").collect()
    assert sorted((r.frame_no, r.complete, len(r.boxes)) for r in got) == [(5, False, 1), (6, True, 0), (7, True, 0)]


@pytest.mark.parametrize("per_batch", [1, None])
def test_frames_share_a_bucket_and_keep_their_own_state(spark, tmp_path, per_batch):
    use_rocksdb(spark)
    at = lambda n: START + timedelta(seconds=n)
    big = (1 << 58) + 1
    boxes = [(s, n, at(n), big + b, 1, .5, 0., 0., 1., 2.) for s in (1, 2) for n in range(9) for b in range(n % 4)]
    beats = [(s, n, at(n), n % 4 + (n == 7)) for s in (1, 2) for n in range(9)] + [(3, 99, START + timedelta(hours=9), 0)]
    written(spark, boxes, ROWS, str(tmp_path / "b"), 2, 3)
    written(spark, beats, BEATS, str(tmp_path / "h"), 2, 4)
    got = drain(FR.assemble_frames(streamed(spark, ROWS, str(tmp_path / "b"), per_batch),
                                   streamed(spark, BEATS, str(tmp_path / "h"), per_batch), "30 days" if per_batch else "1 hour", buckets=2), "f").collect()
    groups = {(r.session_id, r.frame_no): (r.complete, [b.box_no for b in r.boxes]) for r in got}
    want = {(s, n): (n != 7, [big + b for b in range(n % 4)]) for s in (1, 2) for n in range(9)} | {(3, 99): (True, [])}
    if per_batch:  # the watermark does not get to the incomplete ones
        want = {k: v for k, v in want.items() if v[0]}
    assert groups == want and len(got) == len(want)
