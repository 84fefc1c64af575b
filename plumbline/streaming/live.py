"""Streaming operators: bounded latest-wins queues and a stateful tracker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_wins(batch: DataFrame, key: str, order: str, capacity: int, drop_newest: bool = False) -> DataFrame:
    """Of a micro-batch at most `capacity` rows of each key, the oldest dropped (or the newest), with `dropped`, how many were."""
    by = F.col(order) if drop_newest else F.desc(order)
    w = Window.partitionBy(key)
    ranked = batch.withColumn("_r", F.row_number().over(w.orderBy(by))).withColumn("dropped", F.greatest(F.count("*").over(w) - capacity, F.lit(0)))
    return ranked.where(F.col("_r") <= capacity).drop("_r")


def integrate(state: tuple | None, rows: list[tuple], step: float, after: int) -> tuple[tuple | None, list[tuple]]:
    """The fold behind `tracker`: rows (t, event_id, value) in order; a row is integrated if it is first, has moved by `step`, or `after` has passed since the last integrated one."""
    out = []
    for t, event, value in rows:
        due = state is None or abs(value - state[1]) > step or t - state[0] >= after
        if due:
            state = (t, value)
        out.append((event, due))
    return state, out


def tracker(frames: DataFrame, key: str, step: float, after: int) -> DataFrame:
    """(key, event_id, integrated) of a stream of (key, t, event_id, value): the gate keyed on the last integrated pose (T5).

    A micro-batch's frames of a take are folded in time order; the state is one pose a take.
    """

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["t", "event_id"])
        now, out = integrate(tuple(state.get) if state.exists else None, list(zip(rows["t"], rows["event_id"], rows["value"])), step, after)
        if now is not None:
            state.update((int(now[0]), float(now[1])))
        yield pd.DataFrame({key: [k[0]] * len(out), "event_id": [e for e, _ in out], "integrated": [bool(d) for _, d in out]})

    return frames.groupBy(key).applyInPandasWithState(fold, f"`{key}` long, event_id long, integrated boolean", "t long, value double", "append", GroupStateTimeout.NoTimeout)
