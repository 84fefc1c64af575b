"""Operators over poses, gyroscope samples, depth rasters and the frames of a take."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geom, rigid
from plumbline.operators.relational import interval_join

#: Views in a block of a search for neighbours, and rows of a block that are compared at once.
VIEWS, ROWS = 4096, 128

IDENTITY = "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D)"


def _times(a: str, b: str) -> str:
    """SQL for the product of two 3 x 3 matrices held as arrays by rows."""
    return "array(" + ", ".join(" + ".join(f"{a}[{3 * i + k}] * {b}[{3 * k + j}]" for k in range(3)) for i in range(3) for j in range(3)) + ")"


def _turn(v: str) -> str:
    """SQL for the rotation about the vector v (fields x, y, z) by its length."""
    angle = f"sqrt({v}.x * {v}.x + {v}.y * {v}.y + {v}.z * {v}.z)"
    n = "s"
    entries = []
    for i in range(3):
        for j in range(3):
            a, b = f"{n}.u[{i}]", f"{n}.u[{j}]"
            skew = {(0, 1): "- s.u[2]", (0, 2): "+ s.u[1]", (1, 0): "+ s.u[2]", (1, 2): "- s.u[0]", (2, 0): "- s.u[1]", (2, 1): "+ s.u[0]"}.get((i, j))
            entries.append(f"(1 - cos(s.a)) * {a} * {b}" + (f" {skew} * sin(s.a)" if skew else " + cos(s.a)"))
    unit = f"transform(array({v}.x, {v}.y, {v}.z), c -> c / greatest({angle}, 1e-300D))"
    return f"transform(array(named_struct('a', {angle}, 'u', {unit})), s -> array({', '.join(entries)}))[0]"


def gyro_prior(samples: DataFrame, windows: DataFrame, key: str, time: str, begin: str, end: str, longest_us: int = 500_000, step_us: int = 80_000, most_degrees: float = 65.0, bucket: int = 500_000) -> DataFrame:
    """windows with `rotation` (nine numbers by rows, from the earlier camera to the later one) and `angle` in degrees.

    samples: key, time in microseconds, x, y, z in radians a second. Rates are integrated by
    trapezoids, the first and the last held to the window's ends, as an ordered product of
    rotations. Null: a window that is empty or longer than `longest_us`, fewer than two samples, a
    gap over `step_us` between samples or to an end, a turn over `most_degrees`. Samples of a
    window come together as one array; a window's length bounds them.
    """
    columns = windows.columns
    asked = windows.where(F.col(end) - F.col(begin) <= longest_us).select(key, begin, end).distinct()
    inside = interval_join(samples.select(key, F.col(time).alias("_t"), "x", "y", "z"), asked, key, "_t", begin, end, bucket)
    x = inside.groupBy(key, begin, end).agg(F.array_sort(F.collect_list(F.struct(F.col("_t").alias("t"), *[F.col(c).cast("double").alias(c) for c in "xyz"]))).alias("_s"))
    x = x.where(f"`{end}` > `{begin}` AND size(_s) >= 2")
    x = x.withColumn("_s", F.expr(f"concat(array(named_struct('t', `{begin}`, 'x', _s[0].x, 'y', _s[0].y, 'z', _s[0].z)), _s, array(named_struct('t', `{end}`, 'x', _s[size(_s) - 1].x, 'y', _s[size(_s) - 1].y, 'z', _s[size(_s) - 1].z)))"))
    x = x.withColumn("_v", F.expr("transform(slice(_s, 2, size(_s) - 1), (b, i) -> named_struct('dt', b.t - _s[i].t, 'x', (_s[i].x + b.x) / 2 * (b.t - _s[i].t) / 1e6D, 'y', (_s[i].y + b.y) / 2 * (b.t - _s[i].t) / 1e6D, 'z', (_s[i].z + b.z) / 2 * (b.t - _s[i].t) / 1e6D))"))
    x = x.where(F.forall("_v", lambda v: v["dt"] <= step_us))
    x = x.withColumn("_r", F.expr(f"aggregate(transform(_v, v -> {_turn('v')}), {IDENTITY}, (m, r) -> {_times('m', 'r')})"))
    x = x.withColumn("angle", geom.rotation_angle(F.col("_r")[0] + F.col("_r")[4] + F.col("_r")[8])).where((F.col("angle") <= most_degrees) & F.forall("_r", lambda v: ~F.isnan(v)))
    back = F.array(*[F.col("_r")[3 * j + i] for i in range(3) for j in range(3)])
    found = x.select(F.col(key).alias("_k"), F.col(begin).alias("_b"), F.col(end).alias("_e"), back.alias("rotation"), "angle")
    return windows.join(found, (F.col(key).eqNullSafe(F.col("_k"))) & (F.col(begin) == F.col("_b")) & (F.col(end) == F.col("_e")), "left").select(*columns, "rotation", "angle")


def captured_trajectory(frames: DataFrame, key: str, order: list[str], t_us: str, pose: str, most_speed: float = 2.4, most_mean: float = 1.35, most_turn: float = 190.0) -> DataFrame:
    """(key, frames, path, mean_speed, peak_speed, peak_turn, sound, confidence) of each take.

    pose: 16 numbers by rows. sound: every rotation is one (determinant and squareness), no
    number is missing, and no speed is over its limit; steps take a thirtieth of a second at least.
    """
    w = Window.partitionBy(key).orderBy(*order)
    m = [F.get(pose, F.lit(i)) for i in range(16)]
    r = [m[4 * i + j] for i in range(3) for j in range(3)]
    square = [sum((r[3 * k + i] * r[3 * k + j] for k in range(1, 3)), r[i] * r[j]) - float(i == j) for i in range(3) for j in range(3)]
    finite = F.coalesce((F.size(pose) == 16) & F.forall(pose, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    rotation = finite & (F.abs(rigid.determinant(r) - 1) <= 0.035) & (F.sqrt(sum((s * s for s in square[1:]), square[0] * square[0])) <= 0.06)
    x = frames.withColumn("_was", F.lag(pose).over(w)).withColumn("_dt", F.greatest((F.col(t_us) - F.lag(t_us).over(w)) / 1e6, F.lit(1.0 / 30))).withColumn("_ok", F.coalesce(rotation, F.lit(False)))
    p = [F.get("_was", F.lit(i)) for i in range(16)]
    step = geom.norm(*[m[4 * i + 3] - p[4 * i + 3] for i in range(3)])
    trace = sum((p[4 * i + j] * m[4 * i + j] for i in range(3) for j in range(3) if i or j), p[0] * m[0])
    x = x.withColumn("_step", step).withColumn("_turn", geom.rotation_angle(trace))
    a = x.groupBy(key).agg(
        F.count("*").alias("frames"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path"),
        F.coalesce(F.max(F.col("_step") / F.col("_dt")), F.lit(0.0)).alias("peak_speed"),
        F.coalesce(F.max(F.col("_turn") / F.col("_dt")), F.lit(0.0)).alias("peak_turn"),
        F.greatest((F.max(t_us) - F.min(t_us)) / 1e6, F.lit(0.1)).alias("_time"),
        F.every("_ok").alias("_ok"),
    )
    a = a.withColumn("mean_speed", F.col("path") / F.col("_time"))
    sound = F.col("_ok") & (F.col("peak_speed") <= most_speed) & (F.col("mean_speed") <= most_mean) & (F.col("peak_turn") <= most_turn)
    loss = 12 * geom.saturating(F.col("peak_speed"), most_speed) + 8 * geom.saturating(F.col("mean_speed"), most_mean) + 5 * geom.saturating(F.col("peak_turn"), most_turn)
    return a.select(key, "frames", "path", "mean_speed", "peak_speed", "peak_turn", sound.alias("sound"), F.greatest(F.lit(65), F.rint(96 - loss)).cast("int").alias("confidence"))


def depth_correspondences(source: DataFrame, target: DataFrame, pair: list[str], x: str, y: str, depth: str, motion: Column, lens: tuple[float, float, float, float], size: tuple[int, int], front: float = 0.05) -> DataFrame:
    """(pair, x, y, z, u, v, seen) of the source's pixels whose projection falls into the target's raster.

    Pixels are lifted, moved by `motion` (16 numbers by rows), projected and rounded to a target
    pixel; the lookup is an equi-join on pair and pixel. seen: the target's depth there, null if none.
    """
    fx, fy, cx, cy = lens
    d = F.col(depth)
    lifted = [(F.col(x) - cx) * d / fx, (F.col(y) - cy) * d / fy, d]
    moved = source.withColumn("_m", motion).withColumns({f"_q{i}": c for i, c in enumerate(geom.apply_rigid([F.col("_m")[4 * i + j] for i in range(3) for j in range(3)], [F.col("_m")[4 * i + 3] for i in range(3)], lifted))})
    u, v = F.rint(fx * F.col("_q0") / F.col("_q2") + cx), F.rint(fy * F.col("_q1") / F.col("_q2") + cy)
    ahead = moved.where(F.col("_q2") > front).select(*pair, x, y, F.col("_q2").alias("z"), u.cast("long").alias("u"), v.cast("long").alias("v"))
    inside = ahead.where(F.col("u").between(0, size[0] - 1) & F.col("v").between(0, size[1] - 1))
    there = target.select(*pair, F.col(x).cast("long").alias("u"), F.col(y).cast("long").alias("v"), F.col(depth).alias("seen"))
    return inside.join(there, [*pair, "u", "v"], "left")


def projective_support(found: DataFrame, least: float = 0.035, share: float = 0.02) -> Column:
    """Whether the target's depth agrees within 35 mm or 2 percent."""
    return F.coalesce(F.abs(F.col("seen") - F.col("z")) <= F.greatest(F.lit(least), F.col("z") * share), F.lit(False))


def alignment_quality(found: DataFrame, sources: DataFrame, pair: list[str], threshold: float = 0.05, least: int = 350, overlap: float = 0.28, inliers: float = 0.65, rmse_share: float = 0.62) -> DataFrame:
    """(pair, samples, matched, overlap, inliers, rmse, accepted, reason) from correspondences and the source's pixels."""
    off = F.abs(F.col("seen") - F.col("z"))
    per = found.groupBy(*pair).agg(F.count("seen").alias("matched"), F.count_if(off <= threshold).alias("_in"), F.sqrt(F.avg(F.when(off <= threshold, off * off))).alias("rmse"))
    x = sources.groupBy(*pair).agg(F.count("*").alias("samples")).join(per, pair, "left").fillna(0, ["matched", "_in"])
    x = x.withColumn("overlap", F.col("matched") / F.col("samples")).withColumn("inliers", F.when(F.col("matched") > 0, F.col("_in") / F.col("matched")).otherwise(0.0))
    reason = (
        F.when(F.col("samples") < least, "too few samples")
        .when(F.col("matched") < least // 2, "too little overlap with the target")
        .when(F.col("overlap") < overlap, "low overlap")
        .when(F.col("inliers") < inliers, "low agreement")
        .when(F.coalesce(F.col("rmse") > threshold * rmse_share, F.lit(True)), "high residual")
        .otherwise("accepted")
    )
    return x.select(*pair, "samples", "matched", "overlap", "inliers", "rmse", (reason == "accepted").alias("accepted"), reason.alias("reason"))


def view_score(distance: Column, forward_dot: Column, same_phase: Column, apart: Column) -> Column:
    """How far two views are from each other; lower is nearer. Null for views from the same place in the same direction, which tell nothing new."""
    score = distance + 0.35 * (1 - forward_dot) + F.when(same_phase, F.least(F.abs(apart), F.lit(1000)) * 1e-4 - 0.25).otherwise(0.0)
    return F.when(~((distance < 0.012) & (forward_dot > 0.9999)), score)


def _nearest_views(mine: pa.Table, others: pa.Table, centre: int, k: int) -> pa.Table:
    """The k nearest of `others` for each of `mine`: tables of project, _k (key), _p (phase), _i (index), _v (numbers, of them `centre` a place)."""
    others = others.take(pc.sort_indices(others["_k"]))  # columns by key, so that ties go by key
    keys, phases = (pa.chunked_array([*mine[c].chunks, *others[c].chunks], mine[c].type).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() for c in ("_k", "_p"))
    n, m, width = mine.num_rows, others.num_rows, len(mine["_v"][0]) if mine.num_rows else 0
    v, w = (np.array(t["_v"].to_pylist(), dtype=np.float64).reshape(t.num_rows, width) for t in (mine, others))
    i, j = (t["_i"].to_numpy() for t in (mine, others))
    found: list[tuple] = []
    for at in range(0, n if m else 0, ROWS):
        x, own = v[at : at + ROWS], slice(at, min(at + ROWS, n))
        distance = (w[:, 0] - x[:, :1]) ** 2
        for c in range(1, centre):
            distance += (w[:, c] - x[:, c : c + 1]) ** 2
        distance = np.sqrt(distance)
        dot = x[:, centre : centre + 1] * w[:, centre]
        for c in range(centre + 1, width):
            dot += x[:, c : c + 1] * w[:, c]
        dot = np.where(np.isnan(dot), 1.0, np.clip(dot, -1.0, 1.0))  # as least and greatest have it
        apart = np.abs(i[own, None] - j)
        near = np.where(apart < 1000, apart, 1000) * 1e-4 - 0.25
        same = (phases[own, None] == phases[n:]) & (phases[n:] >= 0)
        score = distance + 0.35 * (1 - dot) + np.where(same, near, 0.0)
        place = np.copysign(np.floor(np.abs(score) * 1e9 + 0.5), score)
        place[np.isnan(place)] = np.inf
        place[((distance < 0.012) & (dot > 0.9999)) | (keys[own, None] == keys[n:])] = np.nan
        last = np.partition(place, k - 1, axis=1)[:, k - 1 : k] if m > k else np.full((len(x), 1), np.nan)
        row, col = np.nonzero(place <= np.where(np.isnan(last), np.inf, last))  # ties of the last included
        order = np.lexsort((col, place[row, col], row))
        row, col = row[order], col[order]
        held = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[held], col[held]
        found.append((row + at, col, score[row, col], place[row, col]))
    row, col, score, place = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
    return pa.table([mine.column(0).take(pa.array(row)), mine["_k"].take(pa.array(row)), others["_k"].take(pa.array(col)), pa.array(score), pa.array(place)], names=[mine.column_names[0], "_k", "_ref", "score", "_place"])


def view_neighbours(frames: DataFrame, project: str, key: str, phase: str, index: str, centre: list[str], forward: list[str], k: int = 4) -> DataFrame:
    """(project, key, ref, rank, score): the k nearest views of each frame of a project.

    The order is that of `view_score` at nine places, then of the key. A project's views meet in blocks of about VIEWS, each
    pair of blocks in arrays of one task, and a block's best k travel on: pairs are never rows. Work grows with the square of a
    project, which is the method; the shuffle with its frames times its blocks.
    """
    sizes = frames.groupBy(project).agg(F.ceil(F.count("*") / VIEWS).cast("int").alias("_n"))
    there = F.col(project).isNotNull() & F.col(key).isNotNull()
    for c in centre:
        there = there & F.col(c).isNotNull()
    numbers = F.array(*[F.col(c).cast("double") for c in [*centre, *forward]])
    v = frames.where(there).select(project, F.col(key).alias("_k"), F.col(phase).alias("_p"), F.col(index).alias("_i"), numbers.alias("_v")).join(F.broadcast(sizes), project)
    block, every = F.pmod(F.xxhash64("_k"), F.col("_n")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    by = [project, "_a", "_b"]
    mine, others = v.withColumn("_a", block).withColumn("_b", every).drop("_n"), v.toDF(*v.columns).withColumn("_b", block).withColumn("_a", every).drop("_n")
    kinds = {f.name: f.dataType.simpleString() for f in v.schema}
    at = len(centre)
    near = mine.groupBy(*by).cogroup(others.groupBy(*by)).applyInArrow(lambda a, b: _nearest_views(a, b, at, k), f"`{project}` {kinds[project]}, _k {kinds['_k']}, _ref {kinds['_k']}, score double, _place double")
    w = Window.partitionBy(project, "_k").orderBy("_place", "_ref")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(project, F.col("_k").alias(key), F.col("_ref").alias("ref"), "rank", "score")


def pair_scales(poses: DataFrame, key: str, order: str, source: list[str], target: list[str]) -> DataFrame:
    """(key, pairs, scale): the median ratio of the steps between consecutive centres in two systems (A44); 1 without a sound pair."""
    w = Window.partitionBy(key).orderBy(order)

    def step(cs: list[str]) -> Column:
        return geom.norm(*[F.col(c) - F.lag(c).over(w) for c in cs])

    x = poses.select(key, step(source).alias("_s"), step(target).alias("_t"))
    sound = (F.col("_s") > 1e-6) & (F.col("_t") > 1e-6)
    return x.groupBy(key).agg(F.count_if(sound).alias("pairs"), F.coalesce(F.median(F.when(sound, F.col("_t") / F.col("_s"))), F.lit(1.0)).alias("scale"))


def due_rows(rows: DataFrame, key: str, time: str, interval: float) -> DataFrame:
    """rows that are evaluated at a fixed rate (T10): the first of each key, then the first at or after the last evaluated one plus the interval.

    What is due depends on what was evaluated: pointers to the next due row, doubled, mark the
    chain from the first row in rounds that grow with the logarithm of the longest take.
    """
    import math

    from plumbline.operators.graph import _written

    w = Window.partitionBy(key).orderBy(time, "_tie")
    x = rows.withColumn("_tie", F.xxhash64(*rows.columns)).withColumn("_i", F.row_number().over(w))
    ranged = Window.partitionBy(key).orderBy(F.col(time)).rangeBetween(interval, Window.unboundedFollowing)
    x = _written(x.withColumn("_next", F.min("_i").over(ranged)).withColumn("_on", F.col("_i") == 1))
    longest = x.agg(F.max("_i")).first()[0] or 1
    chain = x.select(key, "_i", F.col("_next"), "_on")
    for _ in range(math.ceil(math.log2(longest)) + 1):
        reached = chain.where("_on AND _next IS NOT NULL").select(key, F.col("_next").alias("_i")).distinct().withColumn("_hit", F.lit(True))
        jump = chain.select(key, F.col("_i").alias("_next"), F.col("_next").alias("_after"))
        chain = _written(chain.join(reached, [key, "_i"], "left").join(jump, [key, "_next"], "left").select(key, "_i", F.col("_after").alias("_next"), (F.col("_on") | F.coalesce("_hit", F.lit(False))).alias("_on")))
    return x.drop("_on", "_next").join(chain.where("_on").select(key, "_i"), [key, "_i"], "left_semi").select(rows.columns)
