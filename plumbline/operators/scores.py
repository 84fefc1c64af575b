"""Scores and limits: alignments, photos, poses, scales, loss weights; as column expressions with their constants as defaults."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geom


def alignment_score(fitness: Column, source: Column, target: Column, rmse: Column, colour_error: Column, tilt: Column) -> Column:
    """0 to 100, of saturating shares of geometry (85) and orientation (15). colour_error: the median distance of matched colours, 0 to the root of 3; null counts half."""
    colour = F.coalesce(geom.clip(1 - colour_error / math.sqrt(3.0), 0.0, 1.0), F.lit(0.5))
    shape = 0.25 * F.least(fitness / 0.50, F.lit(1.0)) + 0.25 * F.least(source / 0.45, F.lit(1.0)) + 0.15 * F.least(target / 0.20, F.lit(1.0)) + 0.20 * geom.clip(1 - rmse / 0.06, 0.0, 1.0) + 0.15 * colour
    upright = geom.clip(1 - F.greatest(F.lit(0.0), tilt - 20.0) / 35.0, 0.0, 1.0)
    return geom.clip(F.rint(85.0 * shape + 15.0 * upright), 0.0, 100.0).cast("int")


def photo_quality(inliers: Column, pairs: Column, rmse: Column, distance: Column) -> tuple[Column, Column]:
    """A score of 0 to 100 and its label."""
    fall = lambda x, most: F.greatest(F.lit(0.0), 1 - x / most)
    score = F.rint(100 * (0.4 * F.least(F.lit(1.0), inliers / 24.0) + 0.2 * F.least(F.lit(1.0), pairs / 40.0) + 0.3 * fall(rmse, 6.0) + 0.1 * fall(distance, 2.0))).cast("int")
    return score, F.when(score >= 75, "Excellent").when(score >= 55, "Good").when(score >= 35, "Usable").otherwise("Weak")


def pose_confidence(inliers: Column, rmse: Column) -> Column:
    """The weight of a localized photo in training."""
    return F.round(F.greatest(F.lit(0.2), 0.55 * geom.saturating(inliers, 120.0) + 0.45 * geom.clip((4.0 - rmse) / 3.5, 0.0, 1.0)), 4)


def scale_limits(splats: DataFrame, group: str, a: str, b: str, scene: Column) -> DataFrame:
    """(group, surface, prior): the largest scale that a splat may grow to.

    surface: twice the 99.5th percentile of both scales (the largest of fewer than 100 splats);
    prior: 1.25 times the 95th percentile of the larger scale; neither under a share of the scene.
    """
    both = splats.select(group, F.explode(F.array(a, b)).alias("_s"))
    robust = both.groupBy(group).agg(F.when(F.count("*") >= 200, F.percentile("_s", 0.995)).otherwise(F.max("_s")).alias("_u"))
    large = splats.groupBy(group).agg(F.percentile(F.greatest(a, b), 0.95).alias("_p"))
    return robust.join(large, group).select(group, F.greatest(F.col("_u") * 2.0, scene * 0.015).alias("surface"), F.greatest(F.col("_p") * 1.25, scene * 0.003).alias("prior"))


def depth_weight(step: Column, steps: Column, start: float = 0.2, end: float = 0.02) -> Column:
    """Falls in a line over the first 65 percent of a training, then stays."""
    done = geom.clip(step / F.greatest(steps * 0.65, F.lit(1.0)), 0.0, 1.0)
    return start * (1 - done) + end * done


def boundary_distance(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """the distance from a point to the nearest edge of a polygon."""
    off = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        ex, ey = bx - ax, by - ay
        long = ex * ex + ey * ey
        at = geom.clip(((x - ax) * ex + (y - ay) * ey) / long, 0.0, 1.0) if long > 1e-20 else F.lit(0.0)
        off.append(geom.norm(x - ax - at * ex, y - ay - at * ey))
    return F.least(*off) if len(off) > 1 else off[0]


def robust_offsets(rows: DataFrame, keys: list[str], value: str, floor: float = 0.04, wide: float = 3.5) -> DataFrame:
    """(keys, offset, inliers): the median of what is within 3.5 median deviations of the median."""
    x = rows.select(*keys, value)
    x = x.join(x.groupBy(*keys).agg(F.median(value).alias("_m")), keys)
    x = x.withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    x = x.join(x.groupBy(*keys).agg(F.median("_d").alias("_mad")), keys).where(F.col("_d") <= F.greatest(F.lit(floor), wide * F.col("_mad")))
    return x.groupBy(*keys).agg(F.median(value).alias("offset"), F.count("*").alias("inliers"))


def loop_candidates(frames: DataFrame, key: str, node: str, at: str, place: str, radius: float, gap: int = 6, every: int = 3, keep: int = 2) -> DataFrame:
    """(key, src, dst, off): for every third node of a take and its last, the nearest nodes at least `gap` places back within a radius, two at most.

    place is a position on a line; nodes meet by bands of the radius, an equi-join.
    """
    last = Window.partitionBy(key)
    r = frames.select(key, F.col(node).alias("_id"), F.col(at).alias("_i"), F.col(place).alias("_v")).withColumn("_n", F.max("_i").over(last))
    asked = r.where((F.col("_i") % every == 0) | (F.col("_i") == F.col("_n"))).where(F.col("_i") >= gap).select(key, F.col("_id").alias("src"), F.col("_i").alias("_a"), F.col("_v").alias("_x"), F.explode(F.array(*[F.floor(F.col("_v") / radius) + k for k in (-1, 0, 1)])).alias("_b"))
    there = r.select(key, F.col("_id").alias("dst"), F.col("_i").alias("_c"), F.col("_v").alias("_y"), F.floor(F.col("_v") / radius).alias("_b"))
    pairs = asked.join(there, [key, "_b"]).withColumn("off", F.abs(F.col("_x") - F.col("_y"))).where((F.col("_a") - F.col("_c") >= gap) & (F.col("off") <= radius))
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(key, "src").orderBy("off", "dst"))).where(F.col("_r") <= keep).select(key, "src", "dst", "off")


def gyro_sessions(samples: DataFrame, key: str, time: str, step_us: int = 80_000, most_angle: float = 0.7) -> DataFrame:
    """(key, session, samples, rotation): rotations integrated between resets.

    A gap over `step_us`, or a time that does not go on, begins a session; a step that turns by
    more than `most_angle` radians is passed over. rotation: nine numbers from the earlier camera to the later one.
    """
    from plumbline.operators.motion import IDENTITY, _times, _turn

    w = Window.partitionBy(key).orderBy(time, "x", "y", "z")
    x = samples.withColumn("_dt", F.col(time) - F.lag(time).over(w))
    for c in "xyz":
        x = x.withColumn(f"_{c}", (F.col(c) + F.lag(c).over(w)) / 2 * F.col("_dt") / 1e6)
    fresh = F.coalesce((F.col("_dt") <= 0) | (F.col("_dt") > step_us), F.lit(True))
    x = x.withColumn("_new", fresh).withColumn("session", F.sum(F.col("_new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    angle = geom.norm(*[F.col(f"_{c}") for c in "xyz"])
    counts = F.coalesce(~F.col("_new") & (angle <= most_angle) & (angle > 1e-9), F.lit(False))
    step = F.when(counts, F.struct(F.col(time).alias("t"), *[F.col(f"_{c}").alias(c) for c in "xyz"]))
    s = x.groupBy(key, "session").agg(F.count("*").alias("samples"), F.array_sort(F.collect_list(step)).alias("_v"))
    s = s.withColumn("_r", F.expr(f"aggregate(transform(_v, v -> {_turn('v')}), {IDENTITY}, (m, r) -> {_times('m', 'r')})"))
    return s.select(key, "session", "samples", F.array(*[F.col("_r")[3 * j + i] for i in range(3) for j in range(3)]).alias("rotation"))


def rebased(splats: DataFrame, scale: float, turn: list[float], shift: list[float]) -> DataFrame:
    """splats (x, y, z, scale, turn w x y z) under a similarity (P20): places moved, scales multiplied, turns composed. turn: a unit quaternion w, x, y, z."""
    from plumbline.functions import rigid

    q = [F.lit(float(v)) for v in turn]
    m = [scale * v for v in rigid.rotation_of(q)]
    moved = geom.apply_rigid(m, [F.lit(float(v)) for v in shift], [F.col(c) for c in "xyz"])
    composed = geom.quaternion_product(q, [F.col("turn")[i] for i in range(4)])
    return splats.withColumns({c: v for c, v in zip("xyz", moved)} | {"scale": F.transform("scale", lambda s: s * scale), "turn": F.array(*composed)})
