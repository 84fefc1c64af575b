"""Selections that depend on what was selected before, and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import _written

#: References in a block of a nearest-neighbour search, and candidates of a greedy selection.
MAX_REFERENCES, MAX_CANDIDATES = 16_384, 20_000


def _block(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)
    return np.array([r[0] for r in rows], dtype=np.int64), base, (base * base).sum(1)


def nearest_references(rows: DataFrame, references: DataFrame, key: str, vector: str, k: int | None, score: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key, ref, rank, dist): the k (None: all) nearest references of each row by Euclidean distance, ties by key, a row's own key left out.

    J9, J16: a stated set of references against all rows, any number of them. They travel in blocks of
    MAX_REFERENCES; a task holds one block at a time and merges the nearest of each. score(squared
    distances, keys of the rows as a column, keys of the references) gives another order, least first.
    """
    context = rows.sparkSession.sparkContext
    shared, held = [], []
    for r in references.select(key, vector).orderBy(key).toLocalIterator():
        held.append(r)
        if len(held) == MAX_REFERENCES:
            shared.append(context.broadcast(_block(held)))
            held = []
    if held or not shared:
        shared.append(context.broadcast(_block(held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            parts = [whole.slice(i, 512) for i in range(0, whole.num_rows, 512)]
            owns = [b.column(0).to_numpy() for b in parts]
            xs = [np.array(b.column(1).to_pylist(), dtype=np.float64) for b in parts]
            best: list = [None] * len(parts)
            for block in shared:
                ids, base, square = block.value
                for i, (own, x) in enumerate(zip(owns, xs) if len(ids) else ()):
                    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ base.T + square, 0)
                    s = np.round(d, 9) if score is None else score(d, own[:, None], ids[None, :])
                    s[own[:, None] == ids[None, :]] = np.inf
                    refs = np.broadcast_to(ids, d.shape)
                    if k is not None and s.shape[1] > 4 * k + 64:  # what may be among the k stays, ties of the last included
                        last = np.partition(s, k, axis=1)[:, k]
                        width = int((s <= last[:, None]).sum(1).max())
                        near = np.argpartition(s, width - 1, axis=1)[:, :width]
                        refs, d, s = (np.take_along_axis(v, near, 1) for v in (refs, d, s))
                    if best[i] is not None:
                        refs, d, s = (np.hstack([a, b]) for a, b in zip(best[i], (refs, d, s)))
                    order = np.lexsort((refs, s), axis=1)[:, :k]
                    best[i] = tuple(np.take_along_axis(v, order, 1) for v in (refs, d, s))
                if len(shared) > 1:
                    del ids, base, square
                    vars(block).pop("_value", None)  # read again for the next batch
            for own, found in zip(owns, best):
                if found is not None:
                    ref, dist = found[0], np.sqrt(found[1])
                    m, keep = ref.shape[1], np.isfinite(found[2]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, m)[keep]), pa.array(ref.ravel()[keep]), pa.array(np.tile(np.arange(1, m + 1), len(own))[keep]), pa.array(dist.ravel()[keep])], names=[key, "ref", "rank", "dist"])

    return rows.select(F.col(key).cast("long"), vector).mapInArrow(run, f"`{key}` long, ref long, rank long, dist double")


def farthest_points(rows: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """(key, step): farthest-point selection that begins with the first and the last row in key order, ties by key (L4).

    Up to MAX_CANDIDATES rows are selected from on the driver, more of them in place, a round a point; the result is the same.
    """
    got = rows.select(key, vector).orderBy(key).limit(MAX_CANDIDATES + 1).toArrow()
    if got.num_rows > MAX_CANDIDATES:
        return _farthest_in_place(rows.select(F.col(key).cast("long").alias(key), vector), key, vector, keep)
    ids, x = got.column(0).to_pylist(), np.array(got.column(1).to_pylist(), dtype=np.float64)
    chosen = list(dict.fromkeys([0, len(ids) - 1]))[: min(keep, len(ids))] if ids else []
    if chosen:
        least = np.min([((x - x[c]) ** 2).sum(1) for c in chosen], axis=0)
        while len(chosen) < min(keep, len(ids)):
            least[chosen] = -1
            c = int(least.argmax())
            chosen.append(c)
            least = np.minimum(least, ((x - x[c]) ** 2).sum(1))
    return rows.sparkSession.createDataFrame([(ids[c], i) for i, c in enumerate(chosen)], f"`{key}` long, step int")


def _farthest_in_place(rows: DataFrame, key: str, vector: str, keep: int, every: int = 16) -> DataFrame:
    """Each round is one pass over the rows, against the points chosen since least distances were last written to the shared folder."""
    held = _written(rows.withColumn("_least", F.lit(float("inf"))))
    ends = held.agg(F.min_by(F.struct(key, vector), key).alias("a"), F.max_by(F.struct(key, vector), key).alias("b")).first()
    chosen, new = [ends["a"], ends["b"]][:keep], [ends["a"], ends["b"]][:keep]
    out = held.schema

    def nearer(points: list) -> Callable:
        base = np.array([p[1] for p in points], dtype=np.float64)
        own = np.array([p[0] for p in points])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, least = np.array(b.column(1).to_pylist(), dtype=np.float64), b.column(2).to_numpy().copy()
                    for p in base:
                        least = np.minimum(least, ((x - p) ** 2).sum(1))
                    least[np.isin(b.column(0).to_numpy(), own)] = -1
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least)], names=b.schema.names)

        return run

    while len(chosen) < keep:
        now = held.mapInArrow(nearer(new), out)
        if len(new) >= every:
            held, new = _written(now), []
            now = held
        top = now.agg(F.max_by(F.struct(key, vector, "_least"), F.struct("_least", (-F.col(key)).alias("k"))).alias("t")).first()["t"]
        if top["_least"] < 0:
            break
        chosen.append(top)
        new = [*new, top]
    return rows.sparkSession.createDataFrame([(c[0], i) for i, c in enumerate(chosen)], f"`{key}` long, step int")


def greedy_coverage(scores: DataFrame, view: str, item: str, score: str, keep: int) -> list[tuple[int, float]]:
    """(view, gain) of at most `keep` views, each adding most to the sum of best scores.

    The best score of each item stays distributed; a round is one aggregate over the scores.
    """
    best, chosen = None, []
    for _ in range(keep):
        now = scores if best is None else scores.join(best, item, "left")
        have = F.lit(0.0) if best is None else F.coalesce("best", F.lit(0.0))
        gain = now.groupBy(view).agg(F.round(F.sum(F.greatest(F.col(score), have) - have), 9).alias("gain"))
        top = gain.orderBy(F.desc("gain"), view).first()
        if top is None or top["gain"] <= 1e-8:
            break
        chosen.append((top[view], top["gain"]))
        picked = scores.where(F.col(view).isin([v for v, _ in chosen]))
        best = picked.groupBy(item).agg(F.max(score).alias("best"))
    return chosen
