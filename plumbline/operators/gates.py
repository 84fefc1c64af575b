"""Gates: predicates and clamps over quality columns, with the limits as parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geom import clip


@dataclass(frozen=True)
class AlignmentLimits:
    """The least fitness and overlap, the largest residual in metres, and what else a kind of alignment must hold (F9). None: no limit."""

    fitness: float
    overlap: float
    rmse: float
    colour: float | None = None
    score: float | None = None
    tilt: float | None = None
    shift: float | None = None
    turn: float | None = None


# The limits of consecutive fragments of a trajectory, of phases, and of loop closures.
TRAJECTORY = AlignmentLimits(0.07, 0.08, 0.045, shift=1.2, turn=35.0)
PHASE = AlignmentLimits(0.10, 0.10, 0.04, score=48, tilt=45.0)
LOOP = AlignmentLimits(0.12, 0.12, 0.035, colour=0.52, score=55, shift=0.75, turn=20.0)


def alignment_acceptable(limits: AlignmentLimits, fitness: Column, overlap: Column, rmse: Column, colour: Column | None = None, score: Column | None = None, tilt: Column | None = None, shift: Column | None = None, turn: Column | None = None) -> Column:
    """F9. A null in a measure that counts is not acceptable."""
    holds = (fitness >= limits.fitness) & (overlap >= limits.overlap) & (rmse <= limits.rmse)
    for least, measure in ((limits.colour, colour), (limits.score, score)):
        holds = holds if least is None else holds & (measure >= least)
    for most, measure in ((limits.tilt, tilt), (limits.shift, shift), (limits.turn, turn)):
        holds = holds if most is None else holds & (measure <= most)
    return F.coalesce(holds, F.lit(False))


def planar(diameter: Column, residual: Column, coherence: Column, voxel: float) -> Column:
    """planar or freeform."""
    flat = (F.coalesce(residual, F.lit(float("inf"))) <= F.greatest(F.lit(voxel), F.greatest(F.coalesce(diameter, F.lit(0.0)), F.lit(voxel)) * 0.03)) & (F.coalesce(coherence, F.lit(0.0)) >= 0.70)
    return F.when(flat, "planar").otherwise("freeform")


def largest_hole(voxel: float, given: float | None = None) -> float:
    """The largest diameter that is filled, in metres."""
    return max(0.0, given) if given is not None else min(max(12.0 * voxel, 0.04), 0.15)


def hole_decision(supported: Column, free: Column, occluded: Column, views: Column, diameter: Column, coherence: Column, residual: Column, voxel: float, fill_inferred: bool = False, support: float = 0.60, free_space: float = 0.01, least_views: int = 2, largest: float | None = None) -> Column:
    """What becomes of a hole, from its boundary's evidence: the first of six outcomes that holds.

    supported, free, occluded: numbers of samples over all views; views: those that support enough samples.
    """
    every = F.greatest(supported + free + occluded, F.lit(1))
    inferred = F.lit(fill_inferred) & (coherence >= 0.85) & (residual <= F.greatest(F.lit(2.0 * voxel), diameter * 0.04)) & (free == 0)
    return (
        F.when(free / every > free_space, "preserve_opening")
        .when(F.coalesce(diameter, F.lit(float("inf"))) > largest_hole(voxel, largest), "preserve_too_large")
        .when((supported / every >= support) & (views >= least_views), "fill_measured")
        .when((occluded / every >= 0.25) & (supported / every < support), "preserve_occluded")
        .when(inferred, "fill_inferred")
        .otherwise("preserve_unknown")
    )


def repair_summary(decisions: DataFrame, decision: str, applied: str) -> DataFrame:
    """One row of counts (A17). applied: whether the repair really filled what the decision authorised."""
    fills = F.col(decision).startswith("fill_")
    counted = {"holes_filled": fills & F.col(applied), "authorized_skipped": fills & ~F.col(applied), **{f"{name}_preserved": F.col(decision) == f"preserve_{kind}" for name, kind in (("openings", "opening"), ("occluded", "occluded"), ("unknown", "unknown"), ("large", "too_large"))}}
    return decisions.agg(*[F.count_if(c).alias(n) for n, c in counted.items()])


def reliable_points(points: DataFrame, group: str, error: str, track: str, most: float = 4.0, least_track: int = 2, survivors: int = 100) -> DataFrame:
    """points of small error and enough observations; a group with too few of them has none."""
    sound = points.where((F.col(error) <= most) & ~F.isnan(error) & (F.col(track) >= least_track))
    enough = sound.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= survivors).select(group)
    return sound.join(enough, group, "left_semi")


def useful_registrations(images: Column) -> Column:
    """how many images must be registered."""
    return F.greatest(F.lit(3), F.ceil(images * 0.45)).cast("long")


def similarity_acceptable(cameras: Column, inliers: Column, residual: Column, turn: Column) -> Column:
    """F23."""
    return F.coalesce((cameras >= 6) & (inliers >= F.greatest(F.lit(6), F.ceil(cameras * 0.6))) & (residual <= 0.08) & (turn <= 12.0), F.lit(False))


def photo_localized(inliers: Column, points: Column, rmse: Column, distance: Column) -> Column:
    """of a hypothesis that places a photo by its matches with a reference."""
    return F.coalesce((inliers >= 8) & (inliers / points >= 0.55) & (rmse <= 6.0) & (distance <= 2.0), F.lit(False))


def seed_filter(pixels: DataFrame, frame: str, x: str, y: str, depth: str, confidence: str, least: float = 1.5, continuity: float = 0.12, cap: float = 0.997, stride: int = 2, border: int = 1) -> DataFrame:
    """pixels that may become seeds.

    Confidence at least `least` and the frame's median; depth within `continuity` of all four
    neighbours that are there, and not over the frame's percentile `cap`; on the stride's grid and not in the border.
    """
    per = pixels.groupBy(frame).agg(F.median(confidence).alias("_c"), F.percentile(depth, cap).alias("_d"), F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    p = pixels
    for along, across in ((x, y), (y, x)):
        w = Window.partitionBy(frame, across).orderBy(along)
        for step, f in ((-1, F.lag), (1, F.lead)):
            near = F.when(f(along).over(w) == F.col(along) + step, f(depth).over(w))
            p = p.withColumn(f"_near_{along}{step + 1}", F.coalesce(F.abs(near - F.col(depth)) <= continuity * F.col(depth), F.lit(True)))
    flags = [f"_near_{c}{s}" for c in (x, y) for s in (0, 2)]
    p = p.join(per, frame).where(" AND ".join(f"`{c}`" for c in flags))
    inside = F.col(x).between(F.col("_x0") + border, F.col("_x1") - border) & F.col(y).between(F.col("_y0") + border, F.col("_y1") - border)
    held = (F.col(confidence) >= F.greatest(F.lit(least), F.col("_c"))) & (F.col(depth) <= F.col("_d")) & inside
    return p.where(held & (F.pmod(F.col(x), F.lit(stride)) == 0) & (F.pmod(F.col(y), F.lit(stride)) == 0)).select(pixels.columns)


def clamped(rows: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """settings cut to their limits."""
    return rows.withColumns({c: clip(F.col(c), lo, hi) for c, (lo, hi) in limits.items()})


def problems(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, problem): the rules that a row breaks (F28, S22, S24). A rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.select(key, F.explode(broken).alias("problem"))


def cache_state(wanted: DataFrame, stored: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """wanted with `state` (F32, X21): current, stale (another fingerprint) or missing; and what is stored and wanted no more: orphaned."""
    s = stored.select(key, F.col(fingerprint).alias("_have")).withColumn("_there", F.lit(True))
    both = wanted.select(key, F.col(fingerprint).alias("_want")).withColumn("_asked", F.lit(True)).join(s, key, "full")
    state = F.when(F.col("_asked").isNull(), "orphaned").when(F.col("_there").isNull(), "missing").when(F.col("_have").eqNullSafe(F.col("_want")), "current").otherwise("stale")
    return both.select(key, state.alias("state"))


def valid_packet(payload: Column, count: Column, header: int, element: int, most: int) -> Column:
    """a packet's length is its header and `count` elements, of `most` at most."""
    return F.coalesce((count >= 0) & (count <= most) & (F.octet_length(payload) == header + element * count), F.lit(False))


def colour_coverage(u: Column, v: Column, z: Column, width: int, height: int) -> Column:
    """whether a projected point lies in the colour image."""
    inside = (z > 0) & (u >= 0) & (u <= width - 1.0) & (v >= 0) & (v <= height - 1.0) & ~F.isnan(u) & ~F.isnan(v)
    return F.coalesce(inside, F.lit(False))
