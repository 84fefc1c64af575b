"""Operators over colour rasters, observations of vertices, and meshes that carry labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geom, rigid
from plumbline.operators.graph import _written
from plumbline.operators.quantiles import quantiles
from plumbline.operators.surface import half_edges, placed


def bilinear(samples: DataFrame, raster: DataFrame, keys: list[str], u: str, v: str, size: tuple[int, int], values: list[str], linear: bool = False) -> DataFrame:
    """samples with `values` read from raster (keys, x, y, values) between its pixels.

    Each sample meets its four pixels in one equi-join and is summed up with their weights; beyond
    the last column or row the last counts. linear: sRGB values (0 to 255) are made linear first.
    A sample off the raster, or one of whose pixels is missing, is left out.
    """
    s = samples.withColumn("_id", F.struct(*[F.col(c) for c in samples.columns]))
    left, top = F.floor(F.col(u)), F.floor(F.col(v))
    inside = (F.col(u) >= 0) & (F.col(u) <= size[0] - 1) & (F.col(v) >= 0) & (F.col(v) <= size[1] - 1)
    fx, fy = F.col(u) - left, F.col(v) - top
    corner = lambda i, j, w: F.struct(F.least(left + i, F.lit(size[0] - 1)).cast("long").alias("x"), F.least(top + j, F.lit(size[1] - 1)).cast("long").alias("y"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))
    four = s.where(inside).withColumn("_q", F.explode(corners)).select(*keys, "_id", F.col("_q.x").alias("_x"), F.col("_q.y").alias("_y"), F.col("_q.w").alias("_w"))
    read = (lambda c: geom.srgb_to_linear(F.col(c) / 255.0)) if linear else F.col
    r = raster.select(*keys, F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y"), *[read(c).alias(f"_v{i}") for i, c in enumerate(values)])
    found = four.join(r, [*keys, "_x", "_y"]).groupBy("_id").agg(F.count("*").alias("_n"), *[F.sum(F.col("_w") * F.col(f"_v{i}")).alias(c) for i, c in enumerate(values)])
    return found.where("_n = 4").select("_id.*", *values)


def calibrated(pixels: DataFrame, gains: DataFrame, field: DataFrame, frame: str, size: tuple[int, int], grid: tuple[int, int]) -> DataFrame:
    """(frame, x, y, v): a value (sRGB, 0 to 255) made linear, times the frame's gain, plus its bias and the spatial field between the cells of a small grid, as sRGB again.

    gains: (frame, gain, bias); field: (frame, x, y, bias_xy) over the grid.
    """
    at = [(F.col(c) / max(n - 1, 1) * (g - 1)).alias(a) for c, n, g, a in (("x", size[0], grid[0], "_u"), ("y", size[1], grid[1], "_g"))]
    p = bilinear(pixels.select(frame, "x", "y", "v", *at), field.select(frame, "x", "y", "spatial"), [frame], "_u", "_g", grid, ["spatial"])
    linear = geom.srgb_to_linear(F.col("v") / 255.0) * F.col("gain") + F.col("bias") + F.col("spatial")
    return p.join(gains, frame).select(frame, "x", "y", F.rint(geom.linear_to_srgb(linear) * 255).cast("int").alias("v"))


def smoothed_fields(cells: DataFrame, frame: str, size: int = 16, rounds: int = 24, most: float = 0.08) -> DataFrame:
    """(frame, x, y, spatial): a field over a small grid, held to its data and drawn to its four neighbours, which wrap around, in a fixed number of rounds.

    cells: (frame, x, y, mean, n). A frame's grid of size * size numbers is relaxed in one task.
    """

    def relax(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        data, count = np.zeros((size, size)), np.zeros((size, size))
        data[part["y"], part["x"]], count[part["y"], part["x"]] = part["mean"], part["n"]
        weight, now = np.minimum(count / 8.0, 4.0), data
        for _ in range(rounds):
            around = sum(np.roll(now, s, axis=a) for s in (1, -1) for a in (0, 1)) / 4
            now = (weight * data + 1.5 * around) / (weight + 1.5)
        y, x = np.divmod(np.arange(size * size), size)
        return pd.DataFrame({frame: k[0], "x": x, "y": y, "spatial": np.clip(now, -most, most).ravel()})

    return cells.groupBy(frame).applyInPandas(relax, f"`{frame}` {cells.schema[frame].dataType.simpleString()}, x int, y int, spatial double")


def edge_weights(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(t1, t2, lo, hi, weight) of faces that share an edge (G9): the fourth power of the cosine between them, times the edge's length over the median of all, cut to 0.25 and 4."""
    from pyspark.sql import Window

    e = half_edges(triangles).select("tid", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).where("lo <> hi").distinct()
    pairs = e.withColumn("t1", F.lag("tid").over(Window.partitionBy("lo", "hi").orderBy("tid"))).where("t1 IS NOT NULL").select("t1", F.col("tid").alias("t2"), "lo", "hi")
    p = placed(triangles, vertices)
    normal = rigid.unit(rigid.cross(*[[F.col(c)[i] - F.col("pa")[i] for i in range(3)] for c in ("pb", "pc")]))
    n = p.select("tid", F.array(*normal).alias("n"))
    at = vertices.select("vid", F.array("x", "y", "z").alias("p"))
    x = pairs.join(n.select(F.col("tid").alias("t1"), F.col("n").alias("n1")), "t1").join(n.select(F.col("tid").alias("t2"), F.col("n").alias("n2")), "t2")
    x = x.join(at.select(F.col("vid").alias("lo"), F.col("p").alias("pl")), "lo").join(at.select(F.col("vid").alias("hi"), F.col("p").alias("ph")), "hi")
    length = geom.norm(*[F.col("ph")[i] - F.col("pl")[i] for i in range(3)])
    x = x.withColumn("_l", length).withColumn("_c", F.pow(geom.clip(rigid.dot([F.col("n1")[i] for i in range(3)], [F.col("n2")[i] for i in range(3)]), 0.0, 1.0), 4))
    x = _written(x.select("t1", "t2", "lo", "hi", "_l", "_c"))
    middle = max(quantiles(x, F.col("_l"), [0.5])[0] or 0.0, 1e-8)
    return x.select("t1", "t2", "lo", "hi", (F.col("_c") * geom.clip(F.col("_l") / middle, 0.25, 4.0)).alias("weight"))


def label_switches(pairs: DataFrame, labels: DataFrame) -> Column | DataFrame:
    """One row, `percent`: how many of the pairs (t1, t2) of labelled faces (tid, label) change the label (G10); labels under 0 are none."""
    known = labels.where("label >= 0").select("tid", "label")
    x = pairs.join(known.select(F.col("tid").alias("t1"), F.col("label").alias("a")), "t1").join(known.select(F.col("tid").alias("t2"), F.col("label").alias("b")), "t2")
    return x.agg(F.coalesce(100.0 * F.avg((F.col("a") != F.col("b")).cast("int")), F.lit(0.0)).alias("percent"))


def observations(seen: DataFrame, view: str, focal: float, size: tuple[int, int]) -> DataFrame:
    """seen with `strict` and `loose`, how far a vertex's colour in a view is to be trusted.

    seen: view, u, v (place in the image), facing (cosine to the camera, signed), distance,
    residual and tolerance of depth. Facing is turned round for a view that sees most of its vertices from behind.
    """
    inside = (F.col("u") >= 0) & (F.col("u") <= size[0] - 1.001) & (F.col("v") >= 0) & (F.col("v") <= size[1] - 1.001)
    valid = F.coalesce(inside & F.col("residual").isNotNull(), F.lit(False))
    near = valid & (F.col("residual") <= F.col("tolerance"))
    sign = seen.groupBy(view).agg(F.when(F.coalesce(F.avg(F.when(near, (F.col("facing") > 0).cast("int"))), F.lit(1.0)) < 0.35, -1.0).otherwise(1.0).alias("_sign"))
    border = geom.clip(F.least("u", "v", size[0] - 1.0 - F.col("u"), size[1] - 1.0 - F.col("v")) / 24.0, 0.0, 1.0)
    base = F.pow(F.greatest(geom.clip(F.col("facing") * F.col("_sign"), 0.0, 1.0), F.lit(0.02)), 2) * border * (focal / 1000.0) / F.greatest("distance", F.lit(0.5))
    fall = lambda wide: F.exp(-F.pow(F.col("residual") / F.greatest(F.col("tolerance") * wide, F.lit(1e-6)), 2))
    return seen.join(sign, view).select(*seen.columns, F.when(near, base * fall(1.0)).otherwise(0.0).alias("strict"), F.when(valid, base * fall(4.0)).otherwise(0.0).alias("loose"))


def reduced_zbuffer(points: DataFrame, view: str, u: str, v: str, z: str, size: tuple[int, int], most: int = 1024) -> DataFrame:
    """(view, x, y, z): the nearest depth in each cell of a raster of at most `most` cells a side."""
    scale = min(1.0, most / max(size))
    w, h = max(1, round(size[0] * scale)), max(1, round(size[1] * scale))
    x, y = (F.rint((F.col(c) + 0.5) * (n / full) - 0.5).cast("long") for c, n, full in ((u, w, size[0]), (v, h, size[1])))
    p = points.where(F.col(z) > 0).select(view, x.alias("x"), y.alias("y"), F.col(z).alias("z"))
    return p.where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1)).groupBy(view, "x", "y").agg(F.min("z").alias("z"))


def surface_frames(pixels: DataFrame, keys: list[str], lens: tuple[float, float, float, float]) -> DataFrame:
    """(keys, x, y, qw, qx, qy, qz): the quaternion of tangent, cotangent and normal at each pixel with depth z.

    Tangents are central differences where all four neighbours are there, else those of a wall
    that faces the camera; the normal looks to the camera.
    """
    from pyspark.sql import Window

    fx, fy, cx, cy = lens
    p = pixels.where("z > 0").withColumn("_p", F.array((F.col("x") - cx) * F.col("z") / fx, (F.col("y") - cy) * F.col("z") / fy, F.col("z").cast("double")))
    for along, across, name in (("x", "y", "_tx"), ("y", "x", "_ty")):
        w = Window.partitionBy(*keys, across).orderBy(along)
        before, after = (F.when(f(along).over(w) == F.col(along) + s, f("_p").over(w)) for f, s in ((F.lag, -1), (F.lead, 1)))
        p = p.withColumn(name + "0", before).withColumn(name + "1", after)
    full = F.col("_tx0").isNotNull() & F.col("_tx1").isNotNull() & F.col("_ty0").isNotNull() & F.col("_ty1").isNotNull()
    tx = [F.when(full, F.col("_tx1")[i] - F.col("_tx0")[i]).otherwise(F.col("z") / fx if i == 0 else F.lit(0.0)) for i in range(3)]
    ty = [F.when(full, F.col("_ty1")[i] - F.col("_ty0")[i]).otherwise(F.col("z") / fy if i == 1 else F.lit(0.0)) for i in range(3)]
    p = p.withColumn("_t", F.array(*tx)).withColumn("_n", F.array(*rigid.unit(rigid.cross(tx, ty), 1e-8)))
    t, n, q = ([F.col(c)[i] for i in range(3)] for c in ("_t", "_n", "_p"))
    p = p.withColumn("_n", F.when(rigid.dot(n, q) > 0, F.transform("_n", lambda v: -v)).otherwise(F.col("_n")))
    p = p.withColumn("_t", F.array(*rigid.unit([a - rigid.dot(t, n) * b for a, b in zip(t, n)], 1e-8)))
    c = rigid.unit(rigid.cross(n, t), 1e-8)
    turn = rigid.quaternion_of([e for i in range(3) for e in (t[i], c[i], n[i])])
    return p.withColumn("_q", turn).select(*keys, "x", "y", *[F.col("_q")[i].alias(f"q{m}") for i, m in enumerate("wxyz")])


def edited_splats(splats: DataFrame, key: str, linear: list[float]) -> DataFrame:
    """splats (key, scale of three, turn w x y z) under a linear map of nine numbers (P14): scale and turn of the image of the ellipsoid.

    A turn with one scale only multiplies; else the axes are those of the mapped covariance.
    """
    a = np.array(linear, dtype=np.float64).reshape(3, 3)
    out = pa.schema({key: pa.int64(), "scale": pa.list_(pa.float64()), "turn": pa.list_(pa.float64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = np.array(b.column(1).to_pylist(), dtype=np.float64)
            w, x, y, z = np.array(b.column(2).to_pylist(), dtype=np.float64).T
            r = np.moveaxis(np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]), -1, 0)
            half = a @ r * s[:, None, :]
            values, axes = np.linalg.eigh(half @ half.transpose(0, 2, 1))
            axes[np.linalg.det(axes) < 0, :, 0] *= -1
            q = np.stack([_quaternion(m) for m in axes])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.sqrt(np.maximum(values, 0)).tolist(), out[1].type), pa.array(q.tolist(), out[2].type)], schema=out)

    return splats.select(key, "scale", "turn").mapInArrow(run, f"`{key}` long, scale array<double>, turn array<double>")


def _quaternion(m: np.ndarray) -> np.ndarray:
    """w, x, y, z of a rotation: the dominant eigenvector of the symmetric 4 x 4 matrix of its entries."""
    (a, b, c), (d, e, f), (g, h, i) = m
    k = np.array([[a + e + i, h - f, c - g, d - b], [h - f, a - e - i, b + d, c + g], [c - g, b + d, e - a - i, f + h], [d - b, c + g, f + h, i - a - e]])
    q = np.linalg.eigh(k)[1][:, -1]
    return q if q[0] >= 0 else -q


def flat_scales(scale: str, share: float = 0.08, least: float = 5e-4) -> Column:
    """Log scales with the third as thin as a share of the smaller of the first two."""
    s = [F.exp(F.col(scale)[i]) for i in range(2)]
    return F.array(F.col(scale)[0], F.col(scale)[1], F.log(F.greatest(F.least(*s) * share, F.lit(least))))


def first_opacity(confidence: Column) -> Column:
    """The logit of 0.45 times the confidence, kept off its ends."""
    p = geom.clip(geom.clip(confidence, 0.0, 1.0) * 0.45, 1e-4, 1 - 1e-4)
    return F.log(p / (1 - p))


def renumbered(triangles: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triangles and the vertices they use, numbered from 0 in order of vid."""
    from plumbline.operators.relational import _numbered

    corner = triangles.select("tid", F.posexplode(F.array("a", "b", "c")).alias("k", "vid"))
    kept = _numbered(vertices.join(corner.select("vid").distinct(), "vid", "left_semi"), ["vid"]).withColumnRenamed("_i", "n").drop("_n")
    t = corner.join(kept.select("vid", "n"), "vid").groupBy("tid").agg(*[F.max(F.when(F.col("k") == i, F.col("n"))).alias(c) for i, c in enumerate("abc")])
    return t.where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"), kept.drop("vid").withColumnRenamed("n", "vid")


def information(pairs: DataFrame, key: str) -> DataFrame:
    """(key, n, m): the 6 x 6 information of matched points x, y, z (the upper triangle by rows): sums of products of the rows [1 0 0 0 z -y], [0 1 0 -z 0 x], [0 0 1 y -x 0]."""
    zero, one = F.lit(0.0), F.lit(1.0)
    x, y, z = (F.col(c) for c in "xyz")
    rows = [[one, zero, zero, zero, z, -y], [zero, one, zero, -z, zero, x], [zero, zero, one, y, -x, zero]]
    return pairs.groupBy(key).agg(F.count("*").alias("n"), F.array(*[F.sum(sum((r[i] * r[j] for r in rows[1:]), rows[0][i] * rows[0][j])) for i in range(6) for j in range(i, 6)]).alias("m"))


def undistorted(raster: DataFrame, frame: str, size: tuple[int, int], lens: tuple[float, float, float, float], k: tuple[float, float, float], p: tuple[float, float], values: list[str]) -> DataFrame:
    """(frame, x, y, values): a raster as a lens without distortion would have seen it (P7, P23). Pixels that look beyond the raster are left out: the rest is the valid mask."""
    fx, fy, cx, cy = lens
    px = raster.select(frame).distinct().withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size[0] * size[1] - 1).cast("long"))))
    px = px.withColumn("x", F.col("_i") % size[0]).withColumn("y", F.expr(f"_i div {size[0]}")).drop("_i")
    u, v = geom.brown_lens((F.col("x") - cx) / fx, (F.col("y") - cy) / fy, k, p)
    at = px.withColumn("_u", u * fx + cx).withColumn("_g", v * fy + cy)
    return bilinear(at, raster, [frame], "_u", "_g", size, values).select(frame, "x", "y", *values)


def transformed_mesh(triangles: DataFrame, vertices: DataFrame, matrix: list[float], shift: list[float]) -> tuple[DataFrame, DataFrame]:
    """Triangles and vertices under a linear map of nine numbers and a shift (P13); a map that mirrors turns the winding round."""
    m = np.array(matrix, dtype=np.float64).reshape(3, 3)
    moved = geom.apply_rigid([F.lit(float(v)) for v in m.ravel()], [F.lit(float(v)) for v in shift], [F.col(c) for c in "xyz"])
    v = vertices.select("vid", *[c.alias(n) for c, n in zip(moved, "xyz")])
    return (triangles.select("tid", "a", F.col("c").alias("b"), F.col("b").alias("c")) if np.linalg.det(m) < 0 else triangles), v


def seeds(pixels: DataFrame, lens: tuple[float, float, float, float], size: int = 16, least: int = 2, variance: float = 48.0, voxel: float = 0.01) -> DataFrame:
    """(x, y, z, scale_x, scale_y, scale_z, qw, qx, qy, qz): the seeds of one frame of pixels (x, y, z, v).

    An adaptive quadtree over v gives cells; the pixel nearest to a cell's middle, the first of
    equals, is its seed, with the frame of the surface there and scales of half the cell.
    """
    from plumbline.operators.raster import quadtree

    fx, fy = lens[:2]
    cells = quadtree(pixels.where("z > 0"), size, least, variance)
    spread = cells.withColumn("dx", F.explode(F.expr("sequence(0L, size - 1)"))).withColumn("dy", F.explode(F.expr("sequence(0L, size - 1)")))
    inside = spread.select("x0", "y0", "size", (F.col("x0") + F.col("dx")).alias("x"), (F.col("y0") + F.col("dy")).alias("y")).join(pixels.where("z > 0").select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "z"), ["x", "y"])
    off = sum(((F.col(c) - F.col(f"{c}0") - (F.col("size") - 1) / 2) * (F.col(c) - F.col(f"{c}0") - (F.col("size") - 1) / 2) for c in "y"), (F.col("x") - F.col("x0") - (F.col("size") - 1) / 2) * (F.col("x") - F.col("x0") - (F.col("size") - 1) / 2))
    middle = inside.groupBy("x0", "y0", "size").agg(F.min(F.struct(off.alias("o"), "y", "x", "z")).alias("m")).select("size", "m.x", "m.y", "m.z")
    scales = [F.greatest(F.col("z") * F.col("size") * 0.5 / f, F.lit(voxel * 0.35)) for f in (fx, fy)]
    turned = surface_frames(pixels.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "z"), [], lens)
    s = middle.select("x", "y", "z", scales[0].alias("scale_x"), scales[1].alias("scale_y"), F.greatest(F.least(*scales) * 0.08, F.lit(5e-4)).alias("scale_z"))
    return s.join(turned, ["x", "y"])
