"""Where a caller brings code of their own: depth predictors, strategies with callbacks, layers of kept results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class DepthPredictor(Protocol):
    """Gives (depth in metres, whether it is valid) for a batch of measured depths, colours (0 to 1) and lenses fx, fy, cx, cy as shares of the image."""

    def __call__(self, depth: np.ndarray, colour: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


def predicted(frames: DataFrame, key: str, predictor: DepthPredictor, width: int, height: int) -> DataFrame:
    """(key, depth, valid) of frames (key, depth, colour, lens): arrays by rows of width * height depths, three times as many colours and four numbers.

    The predictor travels to the workers once and sees an Arrow batch of frames at a time. What it gives must have the frames' shape, else the scan fails.
    """
    size = width * height
    kind = frames.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            depth, colour, lens = (np.array(b.column(i).to_pylist(), dtype=np.float64) for i in (1, 2, 3))
            found, valid = predictor(depth.reshape(-1, height, width), colour.reshape(-1, height, width, 3), lens)
            if found.shape != (b.num_rows, height, width) or valid.shape != found.shape:
                raise ValueError("a predictor's result has another shape than its frames")
            valid = valid & np.isfinite(found) & (found > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(valid, found, 0).reshape(-1, size).tolist(), pa.list_(pa.float64())), pa.array(valid.reshape(-1, size).tolist(), pa.list_(pa.bool_()))], names=[key, "depth", "valid"])

    return frames.select(key, "depth", "colour", "lens").mapInArrow(run, f"`{key}` {kind}, depth array<double>, valid array<boolean>")


def by_strategy(df: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]], choice: str = "auto", on_fallback: Callable[[str, Exception], None] | None = None, on_done: Callable[[str], None] | None = None) -> DataFrame:
    """The result of the strategy of that name, or, with "auto", of the first in order that plans and yields rows without an error.

    on_fallback hears which strategy failed and why; on_done which one was taken.
    """
    names = list(strategies) if choice == "auto" else [choice]
    last: Exception = ValueError("no strategy")
    for name in names:
        try:
            out = strategies[name](df)
            out.limit(1).collect()
        except Exception as e:  # whatever a caller's code raises is a reason to go on
            last = e
            if on_fallback is not None:
                on_fallback(name, e)
            continue
        if on_done is not None:
            on_done(name)
        return out
    raise last


def invalidated(wanted: DataFrame, stored: DataFrame, key: str, layer: str, fingerprint: str) -> DataFrame:
    """(key, layer, state): kept, or rebuild: a layer whose fingerprint is not the stored one, and all layers behind it (R2). layer orders the layers of a key."""
    s = stored.select(key, layer, F.col(fingerprint).alias("_have"))
    x = wanted.select(key, layer, F.col(fingerprint).alias("_want")).join(s, [key, layer], "left")
    w = Window.partitionBy(key).orderBy(layer).rowsBetween(Window.unboundedPreceding, 0)
    broken = F.max((~F.col("_want").eqNullSafe(F.col("_have"))).cast("int")).over(w)
    return x.withColumn("_b", broken).select(key, layer, F.when(F.col("_b") == 1, "rebuild").otherwise("kept").alias("state"))
