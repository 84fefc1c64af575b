"""Raster and mesh operators: quadtree cells, label smoothing, polygon clipping, packed splats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import _written

SPLAT = np.dtype([("position", "<f4", 3), ("scale", "<f4", 3), ("colour", "u1", 4), ("turn", "u1", 4)])


def quadtree(pixels: DataFrame, size: int, least: int, variance: float) -> DataFrame:
    """(x0, y0, size, n, mean) of an adaptive quadtree over (x, y, v).

    From cells of `size` on, a cell is split while it is larger than `least` and its values vary
    by more than `variance` or it is not covered wholly. A level is one aggregate and a join
    of the pixels whose cells go on; there are log2(size / least) of them.
    """
    done, rest = None, pixels.select("x", "y", "v")
    while True:
        cell = [(F.floor(F.col(c) / size) * size).cast("long").alias(f"{c}0") for c in "xy"]
        cells = rest.groupBy(*cell).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("var")).withColumn("size", F.lit(size).cast("long"))
        split = F.lit(size > least) & ((F.col("var") > variance) | (F.col("n") < size * size))
        cells = _written(cells.withColumn("split", split))
        ended = cells.where("NOT split").select("x0", "y0", "size", "n", "mean")
        done = ended if done is None else done.unionByName(ended)
        if size <= least:
            return done
        keyed = rest.withColumns({f"{c}0": (F.floor(F.col(c) / size) * size).cast("long") for c in "xy"})
        rest = _written(keyed.join(cells.where("split").select("x0", "y0"), ["x0", "y0"], "left_semi").select("x", "y", "v"))
        size //= 2


def smooth_labels(scores: DataFrame, edges: DataFrame, weight: float = 0.42, passes: int = 5) -> DataFrame:
    """(node, label): iterated modes on the two halves of a graph (nodes of even and odd id) in turn.

    scores: (node, label, score); edges: (u, v, w), both ways. A node takes the label of the greatest
    score plus weight times the weights of the neighbours that have it, the least label of equals.
    Ends after `passes` passes or when a pass changes nothing; each half is written to the shared folder.
    """
    best = F.max_by("label", F.struct(F.round("s", 9), -F.col("label"))).alias("label")
    now = _written(scores.withColumn("s", F.col("score")).groupBy("node").agg(best))
    for _ in range(passes):
        before = now
        for half in (0, 1):
            near = edges.join(now.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node"), "label").agg(F.sum("w").alias("near"))
            scored = scores.where(F.pmod("node", F.lit(2)) == half).join(near, ["node", "label"], "left").withColumn("s", F.col("score") + weight * F.coalesce("near", F.lit(0.0)))
            now = _written(scored.groupBy("node").agg(best).unionByName(now.where(F.pmod("node", F.lit(2)) != half)))
        if now.join(before.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty():
            break
    return now


def clip_polygon(corners: list[tuple], low: list[float], high: list[float]) -> list[tuple]:
    """The polygon inside the box; attributes behind the first three numbers of a corner are interpolated with them."""
    for axis in range(len(low)):
        for bound, sign in ((low[axis], 1.0), (high[axis], -1.0)):
            out = []
            for a, b in zip(corners[-1:] + corners[:-1], corners):
                da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
                if (da >= 0) != (db >= 0):
                    f = da / (da - db)
                    out.append(tuple(p + f * (q - p) for p, q in zip(a, b)))
                if db >= 0:
                    out.append(b)
            corners = out
    return corners


def clip_triangles(triangles: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """(tid, part, a, b, c): triangles (tid, a, b, c arrays of numbers) cut to a box and fanned out again."""
    kind = "tid long, part int, a array<double>, b array<double>, c array<double>"
    point = pa.list_(pa.float64())
    schema = pa.schema({"tid": pa.int64(), "part": pa.int32(), "a": point, "b": point, "c": point})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, *corners in zip(*(c.to_pylist() for c in b.columns)):
                p = clip_polygon([tuple(c) for c in corners], low, high)
                rows += [(t, i - 1, list(p[0]), list(p[i]), list(p[i + 1])) for i in range(1, len(p) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)

    return triangles.select(F.col("tid").cast("long"), *[F.col(c).cast("array<double>") for c in "abc"]).mapInArrow(run, kind)


def packed_splats(splats: DataFrame) -> DataFrame:
    """(sid, packed): 32 bytes a splat from position, log scale, opacity logit, colour (0 to 1) and a w, x, y, z quaternion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, position, scale, opacity, colour, turn = (c if i == 0 else np.array(c.to_pylist(), dtype=np.float64) for i, c in enumerate(b.columns))
            out = np.zeros(b.num_rows, dtype=SPLAT)
            if b.num_rows:
                out["position"], out["scale"] = position, np.exp(scale)
                out["colour"][:, :3] = np.rint(np.clip(colour, 0, 1) * 255)
                out["colour"][:, 3] = np.rint(255 / (1 + np.exp(-opacity)))
                turn = turn / np.maximum(np.linalg.norm(turn, axis=1)[:, None], 1e-12)
                out["turn"] = np.rint(np.clip(turn * 128 + 128, 0, 255))
            raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([sid, pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], type=pa.binary())], names=["sid", "packed"])

    return splats.select(F.col("sid").cast("long"), "position", "scale", "opacity", "colour", "turn").mapInArrow(run, "sid long, packed binary")


def unpacked_splats(packed: DataFrame) -> DataFrame:
    """(sid, position, scale, colour, turn) of packed_splats: scales as they are, colour and opacity as four bytes, the turn as four bytes (M14). A record of another length fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            if any(len(r) != SPLAT.itemsize for r in raw):
                raise ValueError("a splat has 32 bytes")
            x = np.frombuffer(b"".join(raw), dtype=SPLAT)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[c].astype(np.float64 if c in ("position", "scale") else np.int32).tolist(), pa.list_(pa.float64() if c in ("position", "scale") else pa.int32())) for c in SPLAT.names]], names=["sid", *SPLAT.names])

    return packed.select("sid", "packed").mapInArrow(run, "sid long, position array<double>, scale array<double>, colour array<int>, turn array<int>")
