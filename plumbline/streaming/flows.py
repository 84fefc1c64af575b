"""Streaming flows around the tracker: reset markers, throttles, side outputs, counters, and a media keyframer with look-back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the keyframer: seconds, shares of tracked points, shares of the image.
LEAST_GAP, LONGEST_GAP, OVERLAP, HARD_OVERLAP, MOTION, PARALLAX, CHANGE, SHARP = 0.125, 2.0, 0.72, 0.50, 0.055, 0.12, 0.12, 0.70


@dataclass
class Motion:
    """How a frame differs from a reference: the share of points still tracked, the median and the 90th percentile of their motion, the distance of the descriptors."""

    reliable: bool
    overlap: float
    median: float
    p90: float
    change: float


def reason(elapsed: float, motion: Motion, gap: float = LEAST_GAP) -> str | None:
    """Why a frame becomes a keyframe, if it does (F31): never too soon, always after a long gap, else for what has moved."""
    if elapsed < gap:
        return None
    if elapsed >= LONGEST_GAP:
        return "maximum_gap"
    rules = (("tracked_overlap", motion.overlap <= OVERLAP), ("camera_motion", motion.median >= MOTION), ("parallax", motion.p90 >= PARALLAX)) if motion.reliable else (("visual_change", motion.change >= CHANGE),)
    return next((name for name, holds in rules if holds), None)


class Keyframer:
    """Chooses keyframes of one source (T9). measure(reference, frame) gives their Motion; frames are dicts with `t` in seconds and `sharpness`.

    The last frame that was not chosen waits: it is taken instead where the next one has lost
    the reference, or is blurred against it, and at the end.
    """

    def __init__(self, measure: Callable[[dict, dict], Motion], gap: float = LEAST_GAP):
        self.measure, self.gap = measure, gap
        self.reference: dict | None = None
        self.waiting: tuple[dict, Motion] | None = None

    def _ready(self) -> bool:
        return self.waiting is not None and self.waiting[0]["t"] - self.reference["t"] >= self.gap

    def _take(self, frame: dict, why: str, motion: Motion | None) -> tuple[dict, str, Motion | None]:
        self.reference, self.waiting = frame, None
        return frame, why, motion

    def push(self, frame: dict) -> Iterator[tuple[dict, str, Motion | None]]:
        if self.reference is None:
            yield self._take(frame, "first_frame", None)
            return
        motion = self.measure(self.reference, frame)
        if motion.reliable and motion.overlap < HARD_OVERLAP and self._ready():
            yield self._take(self.waiting[0], "overlap_guard", self.waiting[1])
            motion = self.measure(self.reference, frame)
        why = reason(frame["t"] - self.reference["t"], motion, self.gap)
        if why and self._ready() and self.waiting[1].reliable and self.waiting[1].overlap >= HARD_OVERLAP and frame["sharpness"] < SHARP * self.waiting[0]["sharpness"]:
            yield self._take(self.waiting[0], "sharpness_guard", self.waiting[1])
            motion = self.measure(self.reference, frame)
            why = reason(frame["t"] - self.reference["t"], motion, self.gap)
        if why:
            yield self._take(frame, why, motion)
        else:
            self.waiting = (frame, motion)

    def end(self) -> Iterator[tuple[dict, str, Motion | None]]:
        if self.reference is not None and self._ready():
            yield self._take(self.waiting[0], "last_frame", self.waiting[1])


def keyframes(frames: DataFrame, source: str, columns: list[str], measure: Callable[[dict, dict], Motion]) -> DataFrame:
    """(source, columns[0], reason, overlap) of the keyframes of each source (T9, F31). columns: the frame's id, `t`, `sharpness` and what `measure` reads; a source is folded in order of time in one task."""

    def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        chooser, chosen = Keyframer(measure), []
        for f in part.sort_values(["t", columns[0]]).to_dict("records"):
            chosen += chooser.push(f)
        chosen += chooser.end()
        return pd.DataFrame([(key[0], f[columns[0]], why, None if m is None else m.overlap) for f, why, m in chosen], columns=[source, columns[0], "reason", "overlap"])

    kind = lambda c: frames.schema[c].dataType.simpleString()
    return frames.select(source, *columns).groupBy(source).applyInPandas(choose, f"`{source}` {kind(source)}, `{columns[0]}` {kind(columns[0])}, reason string, overlap double")


def frame_statistics(frames: DataFrame, chosen: DataFrame, source: str) -> DataFrame:
    """(source, evaluated, selected, redundant, reasons, median_overlap, least_overlap)."""
    per = chosen.groupBy(source, "reason").agg(F.count("*").alias("n"))
    reasons = per.groupBy(source).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))).alias("reasons"))
    overlaps = chosen.groupBy(source).agg(F.count("*").alias("selected"), F.median("overlap").alias("median_overlap"), F.min("overlap").alias("least_overlap"))
    x = frames.groupBy(source).agg(F.count("*").alias("evaluated")).join(overlaps, source, "left").join(reasons, source, "left")
    return x.select(source, "evaluated", F.coalesce("selected", F.lit(0)).alias("selected"), (F.col("evaluated") - F.coalesce("selected", F.lit(0))).alias("redundant"), "reasons", "median_overlap", "least_overlap")


def after_reset(rows: DataFrame, key: str, order: list[str], marker: Column) -> DataFrame:
    """Rows behind the last marker of their key; all rows of a key without one."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_m", F.max(F.coalesce(marker, F.lit(False)).cast("int")).over(w)).where("_m = 0").drop("_m")


def throttled(rows: DataFrame, key: str, time: str, interval: float) -> DataFrame:
    """What a throttled output emits (T11): the first row, then the first at or after each emitted one plus the interval, and the last."""
    from plumbline.operators.motion import due_rows

    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), F.xxhash64(*rows.columns)))).where("_r = 1").drop("_r")
    return due_rows(rows, key, time, interval).unionByName(last).distinct()


def newest(packets: DataFrame, kind: str, sequence: str, payload: str, seen: dict[str, int]) -> DataFrame:
    """(kind, sequence, payload): the newest packet of each kind, if the caller has not had it yet."""
    top = packets.groupBy(kind).agg(F.max(sequence).alias(sequence), F.max_by(payload, sequence).alias(payload))
    known = F.lit(None).cast("long")
    for k, s in seen.items():
        known = F.when(F.col(kind) == k, F.lit(s)).otherwise(known)
    return top.where(~F.col(sequence).eqNullSafe(known))


def to_sides(folder: str, kind: str, kinds: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a micro-batch's rows to a table for each kind under folder, once a batch however often it is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for k in kinds:
                batch.where(F.col(kind) == k).drop(kind).write.mode("overwrite").parquet(f"{folder}/{k}/batch={number}")
        finally:
            batch.unpersist()

    return write


def counters(frames: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """Running totals of a session, of a batch or of a stream (T16): processed, and how many rows each flag holds for."""
    return frames.groupBy(key).agg(F.count("*").alias("processed"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def telemetry(rows: DataFrame, key: str, order: list[str], begins: Column, value: str) -> DataFrame:
    """rows with solve, attempts and best: the largest value so far of the solve that a row belongs to, which begins anew with an event."""
    w = Window.partitionBy(key).orderBy(*order)
    x = rows.withColumn("solve", F.sum(F.coalesce(begins, F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(key, "solve").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("attempts", F.count("*").over(own)).withColumn("best", F.max(value).over(own))


def to_journal(folder: str, key: str, order: str, capacity: int = 512) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends a micro-batch's rows as JSON lines, at most `capacity` of each key, the oldest dropped (K9). A repeated batch replaces itself."""
    from plumbline.streaming.live import latest_wins

    def write(batch: DataFrame, number: int) -> None:
        kept = latest_wins(batch, key, order, capacity).drop("dropped")
        kept.select(F.to_json(F.struct(*kept.columns)).alias("value")).write.mode("overwrite").text(f"{folder}/batch={number}")

    return write


def until(run, flag: Callable[[], bool], seconds: float = 0.2) -> bool:
    """Waits for a streaming query; stops it when the flag is raised (T19). Whether it ended by itself."""
    while not run.awaitTermination(seconds):
        if flag():
            run.stop()
            return False
    return True


class Heartbeat:
    """While it is open, `beat` is called every so often with the seconds so far, from a thread of its own."""

    def __init__(self, beat: Callable[[float], None], seconds: float = 1.0):
        import threading

        self._beat, self._seconds, self._done = beat, seconds, threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        import time

        began = time.monotonic()
        while not self._done.wait(self._seconds):
            self._beat(time.monotonic() - began)

    def __enter__(self) -> Heartbeat:
        self._thread.start()
        return self

    def __exit__(self, *error: object) -> None:
        self._done.set()
        self._thread.join()
