"""Models in name only, for the scoring queries."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Sent to workers with the code, which need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stand_in():
    """A model in name only: boxes from the length of the content."""
    def predict(content):
        n = len(content)
        if n % 10 == 4:
            return None
        first = (n % 300, n % 200, n % 300 + 60 + n % 50, n % 200 + 90 + n % 70, n % 10, n % 1000 / 1000)
        return [first] if n % 2 else [first, (10, 20, 110, 160, 1, 0.5)]

    return predict


def failing_stand_in():
    predict = stand_in()

    def sometimes(content):
        if len(content) % 10 == 3:
            raise RuntimeError("prediction failed")
        return predict(content)

    return sometimes


def batched(make):
    """The same for a list of contents at a time."""
    def load():
        predict = make()
        return lambda contents: [predict(c) for c in contents]

    return load
