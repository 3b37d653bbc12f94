"""Streams against tables and plain loops, over several micro-batches."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boxloom.operators import coverage as C
from boxloom.streaming import counting, live, scoring
from boxloom.streaming.drain import drain, use_rocksdb

W, H = 1000, 800
FRAMES = f"session_id long, frame_no long, ts timestamp, px long, py long, boxes {live.BOXES}"


def make_frames(seed, n=60):
    rng, rows = random.Random(seed), []
    for i in range(n):
        boxes = []
        for b in range(rng.randrange(7)):
            x, y = rng.randrange(600), rng.randrange(400)
            boxes.append((b, rng.randrange(3), rng.randrange(50, 100) / 100, float(x), float(y),
                          float(x + rng.randrange(60, 200)), float(y + rng.randrange(80, 240))))
        rows.append((i % 3, i // 3, datetime(2024, 1, 1) + timedelta(seconds=i),
                     rng.randrange(800), rng.randrange(640), boxes if i % 10 else None))
    return rows


@pytest.fixture
def frame_files(spark, tmp_path):
    rows = make_frames(1)
    for i in range(4):
        part = rows[i * 15:(i + 1) * 15]
        spark.createDataFrame(part, FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time stamp
    return str(tmp_path / "in"), rows


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def names(spark):
    return spark.createDataFrame([(0, "A_One"), (1, "B_Two")], "class_id long, name string")


def cards(spark):
    return spark.createDataFrame(
        [(0, "A one", [("i", "s", "u/a")]), (1, "B Two", [("j", "s", "u/b")])],
        "card_no long, name string, printings array<struct<id:string,set_id:string,image_url:string>>")


def overlap(a, b):
    return max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))


def plain_shown(boxes):
    kept = []
    size = lambda b: (b[5] - b[3]) * (b[6] - b[4])
    for b in sorted((b for b in boxes or [] if b[2] >= .69), key=lambda b: (-b[2], b[0])):
        if all(k[1] != b[1] or overlap(b, k) <= .5 * (size(b) + size(k) - overlap(b, k)) for k in kept):
            kept.append(b)
    return [b for b in kept if .6 <= (b[6] - b[4]) / (b[5] - b[3]) <= 2.2 and .004 <= size(b) / (W * H) <= .15]


def test_live_stream_equals_table_and_loop(spark, frame_files):
    path, rows = frame_files
    stream = drain(live.live_view(stream_of(spark, path, FRAMES), names(spark), W, H), "v").collect()
    batch = live.live_view(spark.createDataFrame(rows, FRAMES), names(spark), W, H).collect()
    key = lambda r: (r.session_id, r.frame_no)
    assert sorted(stream, key=key) == sorted(batch, key=key) and len(stream) == 60
    for r in stream:
        _, _, _, px, py, boxes = next(f for f in rows if f[:2] == (r.session_id, r.frame_no))
        shown = plain_shown(boxes)
        hit = next((b for b in shown if b[3] <= px <= b[5] and b[4] <= py <= b[6]), None)
        assert r.n_shown == len(shown) and r.box_no == (hit and hit[0])
        assert r.label == (hit and {0: "A_One", 1: "B_Two"}.get(hit[1], str(hit[1])))


def test_preview_links_and_first_uses(spark, frame_files):
    path, rows = frame_files
    def linked(frames):
        return live.preview_links(live.live_view(frames, names(spark), W, H), names(spark), cards(spark))
    batch = linked(spark.createDataFrame(rows, FRAMES))
    stream = drain(linked(stream_of(spark, path, FRAMES)), "p")
    cols = ["session_id", "frame_no", "label", "image_url"]
    assert sorted(stream.select(cols).collect()) == sorted(batch.select(cols).collect())
    uses = drain(live.first_uses(linked(stream_of(spark, path, FRAMES)), "1 day"), "f").collect()
    kept = drain(live.first_uses(linked(stream_of(spark, path, FRAMES))), "g").collect()
    assert sorted(r.image_url for r in kept) == ["u/a", "u/b"]
    once = live.first_uses(batch, "1 day").collect()
    assert sorted(r.image_url for r in uses) == sorted(r.image_url for r in once) == ["u/a", "u/b"]


def test_a_url_is_fetched_once_however_late_it_comes_again(spark, tmp_path):
    schema = "image_url string, ts timestamp"
    for day, url in enumerate(["u/a", "u/b", None, "u/a", "u/a"]):
        when = datetime(2024, 1, 1) + timedelta(days=day * 100)
        spark.createDataFrame([(url, when)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "uses"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "uses"))
    assert sorted(r.image_url for r in drain(live.first_uses(stream), "h").collect()) == ["u/a", "u/b"]


def plain_overlay(rows, linked):
    out, state, late = {}, {}, 0
    for s, n, _, px, py, boxes in sorted(rows, key=lambda r: (r[0], r[1])):
        rect = state.get(s)
        shown = plain_shown(boxes)
        def share(b):
            x, y, w, h = rect
            return (max(0, min(b[5], x + w, W) - max(b[3], x)) * max(0, min(b[6], y + h, H) - max(b[4], y))
                    / ((b[5] - b[3]) * (b[6] - b[4])))
        seen = [b for b in shown if not (rect and share(b) >= .5)]
        hit = next((b for b in seen if b[3] <= px <= b[5] and b[4] <= py <= b[6]), None)
        spot = None
        if hit and hit[1] in linked:
            spot = (max(0, min(int(hit[3]), W - 300)), max(0, min(int(hit[6]) + 10, H - 420)))
            state[s] = (*spot, 300, 420)
        out[s, n] = (len(seen), len(shown) - len(seen), hit and hit[0], spot)
    return out


def test_overlay_memory_equals_a_loop_over_several_batches(spark, frame_files):
    path, rows = frame_files
    use_rocksdb(spark)
    frames = stream_of(spark, path, FRAMES).withColumn("shown", live.frame_boxes(F.col("boxes"), W, H))
    got = drain(live.remember_overlay(frames, live.OverlayMemory(frozenset({0, 1}), W, H)), "o").collect()
    spot = lambda r: None if r.overlay_x is None else (r.overlay_x, r.overlay_y)
    assert {(r.session_id, r.frame_no): (r.n_seen, r.n_hidden, r.box_no, spot(r)) for r in got} == plain_overlay(rows, {0, 1})
    assert sum(r.n_hidden for r in got) > 0 and sum(r.late for r in got) == 0


def test_late_frames_are_dropped_and_counted(spark, tmp_path):
    use_rocksdb(spark)
    def at(n):
        return (1, n, datetime(2024, 1, 1) + timedelta(seconds=n), 0, 0, None)
    for part in ([at(5), at(3)], [at(4), at(6)]):
        spark.createDataFrame(part, FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    frames = stream_of(spark, str(tmp_path / "in"), FRAMES).withColumn("shown", live.frame_boxes(F.col("boxes"), W, H))
    got = drain(live.remember_overlay(frames, live.OverlayMemory(frozenset(), W, H)), "o").collect()
    assert sorted((r.frame_no, r.late) for r in got) == [(3, 0), (5, 0), (6, 1)]


def test_masking_off_keeps_all_boxes(spark):
    memory = live.OverlayMemory(frozenset({0}), W, H, masking=False)
    class Frame:
        px, py = 15, 25
        shown = [{"box_no": 1, "class_id": 0, "x1": 10.0, "y1": 20.0, "x2": 100.0, "y2": 120.0}]
    row, rect = memory.one_frame(Frame, (0, 0, 300, 420))
    assert row == (1, 0, 1, 0, 10, 130) and rect is None


def test_frames_from_rows_wait_for_the_watermark(spark, tmp_path):
    schema = "session_id long, frame_no long, ts timestamp, box_no long, class_id long, score double, x1 double, y1 double, x2 double, y2 double"
    rows = [(1, i // 2, datetime(2024, 1, 1) + timedelta(seconds=10 * (i // 2)), i % 2, 0, .9, 0., 0., 1., 1.) for i in range(20)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "d"))
    stream = drain(live.collect_frames(spark.readStream.schema(schema).parquet(str(tmp_path / "d")), "5 seconds"), "c")
    batch = live.collect_frames(spark.createDataFrame(rows, schema), "5 seconds")
    sizes = {r.frame_no: len(r.boxes) for r in batch.collect()}
    assert sizes == {i: 2 for i in range(10)}
    closed = {r.frame_no: len(r.boxes) for r in stream.collect()}
    assert closed and all(closed[k] == 2 for k in closed) and 9 not in closed


def test_streamed_counts_equal_a_recount(spark, tmp_path):
    rows = [(s, c) for i in range(90) for s, c in [(("train", "valid", "test")[i % 3], i % 4)]]
    for i in range(3):
        spark.createDataFrame(rows[i * 30:(i + 1) * 30], "split string, class_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_of(spark, str(tmp_path / "in"), "split string, class_id long")
    counting.write_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = counting.latest_counts(spark, str(tmp_path / "out"))
    want = C.label_counts(spark.createDataFrame(rows, "split string, class_id long"))
    assert sorted(map(tuple, got.select("split", "class_id", "n").collect())) == sorted(map(tuple, want.collect()))


def test_scoring_modes(spark):
    def model():
        def predict(content):
            if content == "boom":
                raise RuntimeError("model failed")
            return None if content == "?" else [(0, 0, len(content), 1, 7, .5)] * (content != "none")
        return predict
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "?"), (4, "boom"), (5, "none")], "image_id long, content string")
    got = scoring.score(df, model, "empty").collect()
    assert [(r.image_id, r.box_no, r.class_id, r.x2) for r in got] == [(1, 1, 7, 3.0)]
    with pytest.raises(Exception, match="model failed"):
        scoring.score(df, model).collect()
