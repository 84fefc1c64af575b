"""Gyroscope priors, keyframes, fields, splat edits and gates against plain versions and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import gates, motion, texture
from plumbline.operators.poses import rotation_exp, rotation_log
from plumbline.streaming.flows import Keyframer, Motion, after_reset, newest, reason


def prior(spark, samples, window, **limits):
    s = spark.createDataFrame([(1, *x) for x in samples], "k int, t long, x double, y double, z double")
    w = spark.createDataFrame([(1, *window)], "k int, b long, e long")
    return motion.gyro_prior(s, w, "k", "t", "b", "e", **limits).first()


def test_gyro_about_z(spark):
    r = prior(spark, [(t, 0.0, 0.0, 1.0) for t in (0, 50_000, 100_000)], (0, 100_000))
    assert r["angle"] == pytest.approx(np.degrees(0.1))
    assert rotation_log(np.array(r["rotation"]).reshape(3, 3))[2] == pytest.approx(-0.1)


def test_gyro_is_an_ordered_product(spark):
    rng = np.random.default_rng(2)
    t = [0, 30_000, 70_000, 130_000, 180_000]
    rates = rng.normal(size=(5, 3)) * 2
    r = prior(spark, [(a, *map(float, v)) for a, v in zip(t, rates)], (-20_000, 200_000))
    turn, before, rate = np.eye(3), -20_000, rates[0]
    for a, v in zip([*t, 200_000], [*rates, rates[-1]]):
        turn, before, rate = turn @ rotation_exp((rate + v) / 2 * (a - before) / 1e6), a, v
    assert np.allclose(np.array(r["rotation"]).reshape(3, 3), turn.T)


@pytest.mark.parametrize("samples, window", [([(0, 0.0, 0.0, 1.0)], (0, 50_000)), ([(0, 0.0, 0.0, 1.0), (90_000, 0.0, 0.0, 1.0)], (0, 100_000)), ([(81_000, 0.0, 0.0, 1.0), (90_000, 0.0, 0.0, 1.0)], (0, 100_000)), ([(0, 0.0, 0.0, 1.0), (10_000, 0.0, 0.0, 1.0)], (0, 100_000)), ([(t, 0.0, 0.0, 1.0) for t in range(0, 600_000, 50_000)], (0, 550_000)), ([(t, 0.0, 0.0, 9.0) for t in range(0, 200_001, 50_000)], (0, 200_000)), ([(0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 1.0)], (1, 1)), ([(t, float("nan"), 0.0, 1.0) for t in (0, 50_000, 100_000)], (0, 100_000))])
def test_gyro_without_a_prior(spark, samples, window):
    assert prior(spark, samples, window)["rotation"] is None


def test_trajectory_needs_rotations(spark):
    rows = [(k, i, i * 100_000, m) for k, scale in ((1, 1.0), (2, 1.2)) for i in range(3) for m in [[scale, 0.0, 0.0, 0.01 * i, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]]]
    rows += [(3, 0, 0, None), (3, 1, 1, [1.0] * 4)]
    d = spark.createDataFrame(rows, "k int, i int, t long, m array<double>")
    found = {r["k"]: r for r in motion.captured_trajectory(d, "k", ["i"], "t", "m").collect()}
    assert found[1]["sound"] and found[1]["path"] == pytest.approx(0.02) and found[1]["mean_speed"] == pytest.approx(0.1)
    assert not found[2]["sound"] and not found[3]["sound"]


def test_alignment_of_a_flat_wall(spark):
    px = spark.range(160 * 120).select(F.lit(0).alias("p"), (F.col("id") % 160).alias("x"), F.expr("id div 160").alias("y"), F.lit(2.0).alias("d"))
    for shift, accepted in ((0.0, True), (0.25, False)):
        m = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, shift, 0.0, 0.0, 0.0, 1.0)))
        found = motion.depth_correspondences(px, px, ["p"], "x", "y", "d", m, (145.0, 145.0, 79.5, 59.5), (160, 120))
        q = motion.alignment_quality(found, px, ["p"]).first()
        assert q["accepted"] == accepted and (q["overlap"] > 0.95 and q["rmse"] < 1e-6 if accepted else q["inliers"] < 0.1)


def still(reference, frame):
    return Motion(True, 1 - abs(frame["v"] - reference["v"]), 0.0, 0.0, 0.0)


def run(frames, measure=still):
    k = Keyframer(measure)
    out = [(f["t"], why) for x in frames for f, why, _ in k.push(x)]
    return out + [(f["t"], why) for f, why, _ in k.end()]


def test_keyframes_look_back():
    f = lambda t, v, s=1.0: {"t": t, "v": v, "sharpness": s}
    assert run([f(0, 0), f(0.1, 0.5)]) == [(0, "first_frame")]
    assert run([f(0, 0), f(0.2, 0.1), f(0.4, 0.3)]) == [(0, "first_frame"), (0.4, "tracked_overlap")]
    assert run([f(0, 0), f(0.2, 0.1), f(0.4, 0.7)])[1:] == [(0.2, "overlap_guard"), (0.4, "tracked_overlap")]
    assert run([f(0, 0), f(0.2, 0.1), f(0.4, 0.3, 0.5)])[1:] == [(0.2, "sharpness_guard"), (0.4, "last_frame")]
    assert run([f(0, 0), f(1, 0.0), f(2, 0.0), f(2.05, 0.0)]) == [(0, "first_frame"), (2, "maximum_gap")]
    assert reason(1.0, Motion(False, 0.0, 1.0, 1.0, 0.13)) == "visual_change" and reason(1.0, Motion(False, 0.0, 1.0, 1.0, 0.1)) is None


def test_reset_and_newest(spark):
    d = spark.createDataFrame([(1, i, i == 3) for i in range(6)] + [(2, 0, None)], "k int, i int, m boolean")
    assert sorted((r["k"], r["i"]) for r in after_reset(d, "k", ["i"], F.col("m")).collect()) == [(1, 4), (1, 5), (2, 0)]
    p = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "kind string, s long, p string")
    assert [r["p"] for r in newest(p, "kind", "s", "p", {"a": 2}).collect()] == ["z"]
    assert sorted(r["p"] for r in newest(p, "kind", "s", "p", {"a": 1}).collect()) == ["y", "z"]


def test_due_rows_follow_what_was_evaluated(spark):
    times = [0, 4, 9, 10, 15, 19, 21, 40]
    d = spark.createDataFrame([(1, t) for t in times], "k int, t long")
    assert sorted(r["t"] for r in motion.due_rows(d, "k", "t", 10).collect()) == [0, 10, 21, 40]


def test_fields_against_a_loop(spark):
    rng = np.random.default_rng(5)
    mean, n = rng.normal(size=(4, 4)) / 20, rng.integers(0, 40, (4, 4))
    rows = [(0, x, y, float(mean[y, x]), int(n[y, x])) for y in range(4) for x in range(4)]
    found = texture.smoothed_fields(spark.createDataFrame(rows, "f int, x int, y int, mean double, n int"), "f", 4, 3).collect()
    now = mean.copy()
    for _ in range(3):
        new = np.zeros((4, 4))
        for y in range(4):
            for x in range(4):
                around = (now[y - 1, x] + now[(y + 1) % 4, x] + now[y, x - 1] + now[y, (x + 1) % 4]) / 4
                w = min(n[y, x] / 8, 4)
                new[y, x] = (w * mean[y, x] + 1.5 * around) / (w + 1.5)
        now = new
    assert all(r["spatial"] == pytest.approx(np.clip(now[r["y"], r["x"]], -0.08, 0.08)) for r in found)


def test_edited_splats_have_the_mapped_covariance(spark):
    rng = np.random.default_rng(6)
    scale, turn = np.abs(rng.normal(size=(20, 3))) + 0.1, rng.normal(size=(20, 4))
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    a = rng.normal(size=(3, 3))

    def matrix(q):
        w, x, y, z = q
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])

    d = spark.createDataFrame([(i, s.tolist(), t.tolist()) for i, (s, t) in enumerate(zip(scale, turn))], "i long, scale array<double>, turn array<double>")
    for r in texture.edited_splats(d, "i", a.ravel().tolist()).collect():
        half = a @ matrix(turn[r["i"]]) * scale[r["i"]]
        mine = matrix(r["turn"]) * np.array(r["scale"])
        assert np.allclose(mine @ mine.T, half @ half.T)


def test_gates(spark):
    row = lambda **k: spark.range(1).select(*[F.lit(v).alias(n) for n, v in k.items()])
    ask = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [ask(gates.useful_registrations(F.lit(n))) for n in (3, 181, 239)] == [3, 82, 108]
    f = lambda sup, free, occ, views, dia=0.2, coh=0.9, res=0.001, inferred=False, largest=0.3: ask(gates.hole_decision(*map(F.lit, (sup, free, occ, views, dia, coh, res)), 0.01, inferred, largest=largest))
    assert f(10, 0, 0, 2) == "fill_measured" and f(10, 1, 0, 2) == "preserve_opening" and f(10, 0, 0, 2, largest=0.1) == "preserve_too_large"
    assert f(4, 0, 6, 2) == "preserve_occluded" and f(0, 0, 0, 0) == "preserve_unknown" and f(0, 0, 0, 0, inferred=True) == "fill_inferred"
    assert gates.largest_hole(0.001) == 0.04 and gates.largest_hole(0.03) == 0.15
    s = gates.problems(row(k=1, a=5.0, b=None), "k", {"low": F.col("a") > 6, "null": F.col("b") > 0, "fine": F.col("a") > 1})
    assert sorted(r["problem"] for r in s.collect()) == ["low", "null"]
    assert ask(gates.valid_packet(F.lit(b"x" * 39), F.lit(1), 24, 15, 10)) and not ask(gates.valid_packet(F.lit(b"x" * 40), F.lit(1), 24, 15, 10))


def test_views_of_one_place_tell_nothing(spark):
    assert spark.range(1).select(motion.view_score(F.lit(0.01), F.lit(1.0), F.lit(True), F.lit(1)).alias("s")).first()["s"] is None
    assert spark.range(1).select(motion.view_score(F.lit(0.5), F.lit(0.5), F.lit(True), F.lit(2000)).alias("s")).first()["s"] == pytest.approx(0.5 + 0.175 + 0.1 - 0.25)


def test_seeds_of_a_flat_wall(spark):
    px = spark.range(32 * 32).select((F.col("id") % 32).alias("x"), F.expr("id div 32").alias("y"), F.lit(2.0).alias("z"), F.lit(5.0).alias("v"))
    rows = texture.seeds(px, (40.0, 40.0, 15.5, 15.5), 16).collect()
    assert sorted((r["x"], r["y"]) for r in rows) == [(7, 7), (7, 23), (23, 7), (23, 23)]
    assert all(r["scale_x"] == pytest.approx(0.4) and r["scale_z"] == pytest.approx(0.032) for r in rows)
    for r in rows:  # the normal looks back along z
        w, x, y, z = (r[f"q{c}"] for c in "wxyz")
        assert 1 - 2 * (x * x + y * y) == pytest.approx(-1)


def test_rational_lens(spark):
    from plumbline.functions.geom import rational_lens

    u, v = rational_lens(F.lit(0.4), F.lit(-0.2), [0.12, -0.03, 0.004, -0.002, 0.01, 0.08, -0.02, 0.005])
    r2 = 0.2
    radial = (1 + r2 * (0.12 + r2 * (-0.03 + r2 * 0.01))) / (1 + r2 * (0.08 + r2 * (-0.02 + r2 * 0.005)))
    row = spark.range(1).select(u.alias("u"), v.alias("v")).first()
    assert row["u"] == pytest.approx(0.4 * radial - 0.00064 - 0.00104) and row["v"] == pytest.approx(-0.2 * radial + 0.00112 + 0.00032)


def test_packets():
    import io

    from plumbline.sources import packets

    raw = packets.point_packet(b"PNTS", 7, 5, 30.0, np.array([[1.0, 2, 3]]), np.array([[4, 5, 6]]))
    assert len(raw) == 39 and packets.read_point_packet(raw, b"PNTS")[0] == 7
    for bad in (raw[:-1], raw + b"x", b"X" + raw[1:], raw[:10]):
        with pytest.raises(ValueError):
            packets.read_point_packet(bad, b"PNTS")
    mesh = packets.mesh_packet(b"MESH", 1, np.arange(15.0).reshape(5, 3), np.zeros((5, 3)), np.array([[0, 2, 4]]), flip=True)
    assert packets.MESH_HEADER.unpack_from(mesh) == (b"MESH", 1, 3, 3) and np.frombuffer(mesh[-12:], "<u4").tolist() == [2, 1, 0]
    stream = b"".join(packets.write_message(b"MSGS", k, k + 10, bytes(k)) for k in range(3))
    assert [(k, s, len(p)) for k, s, p in packets.read_messages(io.BytesIO(stream), b"MSGS")] == [(0, 10, 0), (1, 11, 1), (2, 12, 2)]
    for bad in (stream[:-1], stream[:5], b"X" + stream[1:]):
        with pytest.raises(ValueError):
            list(packets.read_messages(io.BytesIO(bad), b"MSGS"))
    with pytest.raises(ValueError):
        list(packets.read_messages(io.BytesIO(packets.write_message(b"MSGS", 1, 1, b"12345")), b"MSGS", most=4))


def test_first_sound_strategy(spark):
    from plumbline.sources.publish import first_sound

    def broken():
        raise ValueError("no volume")

    assert first_sound(broken, lambda: spark.range(0), lambda: spark.range(2)).count() == 2
    with pytest.raises(ValueError):
        first_sound(broken, lambda: spark.range(0))


def test_strategies_fall_back(spark):
    from plumbline.operators.extensions import by_strategy, predicted

    heard = []

    def broken(df):
        raise RuntimeError("no device")

    late = lambda df: df.select(F.raise_error(F.lit("late")).alias("id"))
    out = by_strategy(spark.range(3), {"gpu": broken, "late": late, "cpu": lambda df: df}, on_fallback=lambda n, e: heard.append(n), on_done=heard.append)
    assert out.count() == 3 and heard == ["gpu", "late", "cpu"]
    with pytest.raises(RuntimeError):
        by_strategy(spark.range(3), {"gpu": broken, "cpu": lambda df: df}, "gpu")
    f = spark.createDataFrame([(1, [1.0] * 4, [0.0] * 12, [1.0] * 4)], "k int, depth array<double>, colour array<double>, lens array<double>")
    with pytest.raises(Exception):
        predicted(f, "k", lambda d, c, l: (d[:, :1], c[:, :1, :, 0] > 0), 2, 2).collect()


def test_stop_and_heartbeat(spark, tmp_path):
    import time

    from plumbline.streaming.flows import Heartbeat, until

    run = spark.readStream.format("rate").load().writeStream.foreachBatch(lambda b, n: None).option("checkpointLocation", str(tmp_path / "c")).start()
    began = time.time()
    assert not until(run, lambda: time.time() - began > 1) and not run.isActive
    beats = []
    with Heartbeat(beats.append, 0.05):
        time.sleep(0.3)
    n = len(beats)
    time.sleep(0.15)
    assert n >= 2 and len(beats) == n


def test_replay_has_turns(spark):
    from plumbline.sources.phase import Phase, replayed

    frames = spark.createDataFrame([(0, 0, 0), (1, 1, 100_000), (2, 2, 900_000)], "index int, source_sequence long, timestamp_us long")
    imu = spark.createDataFrame([(t, "gyro", 0.0, 0.0, 1.0, None) for t in (0, 50_000, 100_000)], "ts_us long, kind string, x double, y double, z double, temp_c double")
    rows = replayed(Phase({}, frames, imu, None)).orderBy("number").collect()
    assert [r["number"] for r in rows] == [0, 1, 2] and rows[0]["rotation"] is None and rows[2]["rotation"] is None
    assert rows[1]["angle"] == pytest.approx(np.degrees(0.1))


def test_neighbours_in_blocks_without_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(motion, "VIEWS", 20, raising=False)
    rng = np.random.default_rng(5)
    at, to = rng.integers(0, 3, (120, 3)) * 0.5, rng.integers(-1, 2, (120, 2)) * 0.5  # with ties
    d = spark.createDataFrame([(i, i % 2, i % 5, *map(float, [*at[i], *to[i]])) for i in range(120)], "i long, p int, s int, x double, y double, z double, c double, f double")
    found = motion.view_neighbours(d, "p", "i", "s", "i", ["x", "y", "z"], ["c", "f"])
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()

    def score(i, j):
        far, dot = np.linalg.norm(at[i] - at[j]), float(np.clip(to[i] @ to[j], -1, 1))
        return None if far < 0.012 and dot > 0.9999 else far + 0.35 * (1 - dot) + (min(abs(i - j), 1000) * 1e-4 - 0.25 if i % 5 == j % 5 else 0)

    want = {}
    for i in range(120):
        near = sorted((round(score(i, j), 9), j) for j in range(i % 2, 120, 2) if j != i and score(i, j) is not None)
        want |= {(i, n + 1): j for n, (_, j) in enumerate(near[:4])}
    assert {(r["i"], r["rank"]): r["ref"] for r in found.collect()} == want
