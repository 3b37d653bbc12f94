"""Batch scoring of images with a caller's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCORED = (
    "image_id bigint, box_no bigint, class_id bigint, score double, "
    "x1 double, y1 double, x2 double, y2 double")
_NAMES = [c.strip().split()[0] for c in SCORED.split(",")]
#: Images that a model gets at a time.
BATCH = 32

# A model takes the contents of one image; it gives rows (x1, y1, x2, y2, class, score),
# or None for an image it cannot read.
Predict = Callable[[object], list[tuple] | None]
# A model of batches does so for a list of contents, in their order.
PredictBatch = Callable[[list], list[list[tuple] | None]]


def predicted(predict: PredictBatch, contents: list, on_error: str) -> list[list[tuple] | None]:
    """What the model finds. A batch that fails is halved until the bad image is alone, whose
    failure is raised, or is no result with ``on_error="empty"``."""
    try:
        found = list(predict(contents))
    except Exception:
        if len(contents) == 1:
            if on_error == "fail":
                raise
            return [None]
        half = len(contents) // 2
        return predicted(predict, contents[:half], on_error) + predicted(predict, contents[half:], on_error)
    if len(found) != len(contents):
        raise ValueError(f"the model gave {len(found)} results for {len(contents)} images")
    return found


def score_batches(images: DataFrame, make_predict: Callable[[], PredictBatch], on_error: str = "fail",
                  batch_size: int = BATCH) -> DataFrame:
    """Detections of ``images`` (image_id, content) by a model that takes whole batches.

    ``make_predict`` runs once per task, so a model loads once and serves many batches.
    Unreadable images give no rows. With ``on_error="empty"`` an image whose prediction
    fails gives no rows either and the job goes on.
    """
    if on_error not in ("fail", "empty"):
        raise ValueError(f"unknown on_error {on_error}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        waiting: list[tuple] = []

        def scored(part: list[tuple]) -> pd.DataFrame:
            found = predicted(predict, [content for _, content in part], on_error)
            return pd.DataFrame(
                [(image_id, i, cls, sc, x1, y1, x2, y2) for (image_id, _), boxes in zip(part, found)
                 for i, (x1, y1, x2, y2, cls, sc) in enumerate(boxes or [], 1)], columns=_NAMES)

        for batch in batches:
            waiting += [r for r in zip(batch["image_id"], batch["content"]) if r[1] is not None]
            while len(waiting) >= batch_size:
                yield scored(waiting[:batch_size])
                waiting = waiting[batch_size:]
        if waiting:
            yield scored(waiting)

    return images.select("image_id", "content").mapInPandas(run, SCORED)


def score(images: DataFrame, make_predict: Callable[[], Predict], on_error: str = "fail") -> DataFrame:
    """``score_batches`` with a model that takes one image at a time."""
    def one_by_one() -> PredictBatch:
        predict = make_predict()
        return lambda contents: [predict(c) for c in contents]

    return score_batches(images, one_by_one, on_error, 1)
