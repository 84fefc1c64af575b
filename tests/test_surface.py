"""Surfaces, poses and recovery on fixtures with known results."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import poses, surface
from plumbline.operators.graph import diffuse, gain_fit
from plumbline.streaming.recovery import ANCHORS, RECENT, Take, compacted, scanned, track


def test_level_set_of_a_sphere_is_closed(spark):
    middle, radius = np.array([6.1, 6.2, 5.9]), 4.0
    axis = "(SELECT explode(sequence(0, 12)) {})"
    v = spark.sql(f"SELECT a kx, b ky, c kz, sqrt(pow(a-6.1,2)+pow(b-6.2,2)+pow(c-5.9,2))-4 sdf FROM {axis.format('a')}, {axis.format('b')}, {axis.format('c')}")
    rows = surface.level_set(v).collect()
    edges, area, volume = Counter(), 0.0, 0.0
    for r in rows:
        corners, p = [tuple(c) for c in r["corners"]], np.array(r["places"]) - middle
        n = np.cross(p[1] - p[0], p[2] - p[0])
        area += np.linalg.norm(n) / 2
        volume += p[0] @ n / 6
        edges.update((corners[k], corners[(k + 1) % 3]) for k in range(3))
    assert set(edges.values()) == {1} and all((v, u) in edges for u, v in edges)  # each edge once in either direction
    assert len({u for u, _ in edges}) - len(edges) // 2 + len(rows) == 2
    assert area == pytest.approx(4 * math.pi * radius**2, rel=0.04) and volume == pytest.approx(4 / 3 * math.pi * radius**3, rel=0.05)
    assert surface.level_set(v.where("sdf > 0")).count() == 0 and surface.level_set(v.where("false")).count() == 0


def lattice(spark, left_out):
    px = spark.createDataFrame([(x, y, 1.0) for x in range(6) for y in range(6) if (x, y) not in left_out] + [(9, 9, None)], "x int, y int, z double")
    at = F.col("y") * 6 + F.col("x")
    first = F.when(F.col("half") == 0, at).otherwise(at + 6)
    return surface.depth_sheet(px, []).select((at * 2 + F.col("half")).alias("tid"), first.alias("a"), (at + 6 + F.col("half")).alias("b"), (at + 1).alias("c")), px.select(at.alias("vid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "z")


def test_rim_of_a_sheet_with_a_hole(spark):
    t, v = lattice(spark, {(2, 2)})
    loops = {}
    for r in surface.boundary_loops(t).orderBy("loop", "place").collect():
        loops.setdefault(r["loop"], []).append(r["vid"])
    assert {k: len(x) for k, x in loops.items()} == {0: 20, 8: 6} and loops[8] == [8, 9, 15, 20, 19, 13]
    found = {r["loop"]: r for r in surface.loop_metrics(surface.boundary_loops(t), v).collect()}
    assert found[0]["area"] == pytest.approx(25) and found[0]["perimeter"] == pytest.approx(20) and found[8]["area"] == pytest.approx(3) and found[8]["rms"] == pytest.approx(0)
    assert surface.nonmanifold_vertices(t).count() == 0


def test_fans_that_meet_in_a_vertex(spark):
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 3, 4), (2, 5, 6, 7), (3, 5, 6, 8), (4, 5, 6, 9)], "tid long, a long, b long, c long")
    assert [tuple(r) for r in surface.nonmanifold_vertices(t).orderBy("vid").collect()] == [(0, 2, 4), (5, 1, 3), (6, 1, 3)]
    assert surface.boundary_loops(t.where("tid < 2")).count() == 0  # a figure of eight is no loop


def test_a_jump_in_depth_cuts_the_sheet(spark):
    px = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (0, 1, 1.0), (1, 1, 1.2)], "x int, y int, z double")
    assert [tuple(r) for r in surface.depth_sheet(px, []).collect()] == [(0, 0, 0)]
    assert surface.depth_sheet(px, [], jump=0.3).count() == 2 and surface.depth_sheet(px.where("false"), []).count() == 0


def test_similarity_with_strays(spark):
    rng = np.random.default_rng(3)
    p, turn = rng.normal(size=(80, 3)), poses.rotation_exp(np.array([0.3, -0.4, 0.5]))
    q = 0.8 * p @ turn.T + [1, 2, 3]
    q[::8] += 2
    rows = [(a.tolist(), b.tolist()) for a, b in zip(p, q)] + [([math.nan, 0.0, 0.0], [0.0, 0.0, 0.0]), (None, [0.0, 0.0, 0.0])]
    scale, found, shift, out = poses.similarity_fit(spark.createDataFrame(rows, "p1 array<double>, p2 array<double>"))
    assert scale == pytest.approx(0.8) and np.allclose(found, turn) and np.allclose(shift, [1, 2, 3]) and out.where("inlier").count() == 70
    turns = spark.createDataFrame([(poses.rotation_exp(np.array([0, 0, a])).ravel().tolist(),) for a in (0.1, 0.3)] + [(None,)], "r array<double>")
    assert np.allclose(poses.mean_rotation(turns, "r"), poses.rotation_exp(np.array([0, 0, 0.2])))
    half = poses.between(np.eye(4), np.block([[turn, np.array([[2.0], [0], [0]])], [np.zeros((1, 3)), np.ones((1, 1))]]), 0.5)
    assert np.allclose(half[:3, :3] @ half[:3, :3], turn) and half[0, 3] == 1


def moved(x, y=0.0, angle=0.0):
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = poses.rotation_exp(np.array([0, 0, angle])), [x, y, 0]
    return m


def test_pose_graph_rejects_the_wrong_closure(spark):
    n, step = 12, moved(0.5, angle=2 * math.pi / 12)
    true = [np.linalg.matrix_power(step, k) for k in range(n)]
    chain = [("a", k, (step @ moved(0.01 * (k % 2), angle=0.01)).ravel().tolist()) for k in range(1, n)] + [("b", 1, step.ravel().tolist()), ("b", 3, step.ravel().tolist())]
    ties = [("a", i, j, (np.linalg.inv(true[i]) @ true[j]).ravel().tolist(), 2.0) for i, j in ((0, 11), (0, 6), (3, 9))] + [("a", 1, 8, moved(5).ravel().tolist(), 2.0), ("a", 0, 99, moved(0).ravel().tolist(), 1.0), ("a", 0, 5, None, 1.0)]
    found = poses.pose_graph(spark.createDataFrame(chain, "take string, node long, step array<double>"), spark.createDataFrame(ties, "take string, i long, j long, step array<double>, weight double"), "take").orderBy("take", "node").collect()
    a = [np.array(r["pose"]).reshape(4, 4) for r in found if r["take"] == "a"]
    assert len(a) == n and max(np.abs(p - t).max() for p, t in zip(a, true)) < 0.02 and {r["rejected"] for r in found if r["take"] == "a"} == {1}
    assert [r["node"] for r in found if r["take"] == "b"] == [0, 1]


def frame(sequence, *candidates):
    return {"sequence": sequence, "t_us": sequence * 100_000, "gyro": None, "candidates": [{"kind": k, "anchor": a, "step": m.ravel().tolist(), "overlap": o, "inliers": 0.95, "rmse": 0.01} for k, a, m, o in candidates]}


def test_tracker_loses_and_confirms_a_recovery():
    take, out = Take(), []
    for k in range(1, 4):
        out.append(track(take, frame(k, ("previous", None, moved(0.1), 0.9)), 0.01))
    assert [(r[1], r[2]) for r in out] == [("tracking", True)] * 3 and [a[0] for a in take.anchors] == [1, 2, 3]
    assert track(take, frame(4, ("previous", None, moved(0.1), 0.1)), 0.01)[1] == "lost"
    assert track(take, frame(5, ("previous", None, moved(0.9), 0.9)), 0.01)[5] == "motion beyond physical limits"
    back = [track(take, frame(k, ("anchor", 1, moved(0.02), 0.9)), 0.01) for k in range(6, 9)]
    assert [r[1] for r in back] == ["recovering", "recovering", "tracking"] and back[2][2] is False and back[2][3] == 1
    assert take.lost == 0 and take.pending is None and np.allclose(np.array(take.pose).reshape(4, 4), moved(0.02))
    # the next frame may be mapped again; a far jump after a loss is not credible
    assert track(take, frame(9, ("previous", None, moved(0.1), 0.9)), 0.01)[2] is True
    track(take, frame(10), 0.01)
    assert track(take, frame(20, ("previous", None, moved(0.3), 0.9)), 0.01)[5] == "recovery not credible"


def test_a_pending_recovery_expires():
    take = Take()
    track(take, frame(1), 0.01)
    track(take, frame(2), 0.01)
    assert track(take, frame(3, ("previous", None, moved(0.01), 0.9)), 0.01)[1] == "recovering" and take.pending[1] == 1
    track(take, frame(243), 0.01)
    assert take.pending is not None
    track(take, frame(244), 0.01)
    assert take.pending is None


def test_the_bank_of_anchors_is_bounded_and_scanned_in_turn():
    bank = [[k, 0, np.eye(4).ravel().tolist()] for k in range(ANCHORS + 1)]
    kept = [a[0] for a in compacted(bank)]
    assert kept[0] == 0 and kept[-RECENT:] == list(range(ANCHORS + 1 - RECENT, ANCHORS + 1)) and len(kept) == RECENT + 21
    take = Take(pose=[], sequence=99, anchors=bank[:8])
    assert [[a[0] for a in scanned(take)] for _ in range(3)] == [[0, 1, 2, 3], [0, 4, 5, 6], [0, 7, 1, 2]]
    take.pending = [[], 1, 50, 5]
    assert [a[0] for a in scanned(take)] == [5, 0, 3, 4]  # the cursor stands at 2 of 1, 2, 3, 4, 6, 7


def test_diffusion_and_gains(spark):
    given = {0: 4.0, 5: 10.0}
    v = spark.createDataFrame([(k, given.get(k)) for k in range(8)], "node long, value double")
    path = [(a, a + 1) for a in range(6)]
    e = spark.createDataFrame(path + [(b, a) for a, b in path], "u long, v long")
    want = dict(given)
    for _ in range(16):
        near = {n: [want[m] for a, b in path for n2, m in ((a, b), (b, a)) if n2 == n and m in want] for n in range(8) if n not in want}
        want |= {n: sum(x) / len(x) for n, x in near.items() if x}
    assert {r["node"]: r["value"] for r in diffuse(v, e).collect()} == want | {7: None}
    gains = [0.3, -0.1, 0.2, -0.4]
    rows = [(i, j, gains[i] - gains[j], 1.0 + i) for i in range(4) for j in range(i)] + [(7, 8, 1.0, 2.0), (1, 1, 5.0, 1.0), (0, 1, None, 1.0)]
    found = {r["frame"]: r["gain"] for r in gain_fit(spark.createDataFrame(rows, "i long, j long, offset double, weight double")).collect()}
    assert found == pytest.approx(dict(enumerate(gains)) | {7: 0.5, 8: -0.5})
    assert gain_fit(spark.createDataFrame(rows[:0], "i long, j long, offset double, weight double")).count() == 0
    noisy = [(i, j, o + 0.01 * (i * 7 % 3) if o is not None else None, w) for i, j, o, w in rows]
    d = spark.createDataFrame(noisy, "i long, j long, offset double, weight double")
    dense, rounds = ({r["frame"]: r["gain"] for r in gain_fit(d, most).collect()} for most in (4096, 3))
    assert rounds == pytest.approx(dense, abs=1e-8)
