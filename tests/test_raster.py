"""Adaptive cells, labels, clipping and packing against plain versions."""

import numpy as np
import pytest

from plumbline.operators import raster


def test_quadtree(spark):
    rng = np.random.default_rng(2)
    v = np.zeros((32, 32))
    v[:, 20:] = 5
    v[3, 4] = 9
    there = {(x, y): float(v[y, x]) for x in range(32) for y in range(32) if not (x > 28 and y > 28)}

    def cells(x0, y0, size):
        own = [there[p] for p in there if x0 <= p[0] < x0 + size and y0 <= p[1] < y0 + size]
        if not own:
            return []
        if size > 2 and (np.var(own) > 0.5 or len(own) < size * size):
            h = size // 2
            return [c for dx in (0, h) for dy in (0, h) for c in cells(x0 + dx, y0 + dy, h)]
        return [(x0, y0, size, len(own))]

    d = spark.createDataFrame([(x, y, w) for (x, y), w in there.items()], "x int, y int, v double")
    got = sorted((r["x0"], r["y0"], r["size"], r["n"]) for r in raster.quadtree(d, 16, 2, 0.5).collect())
    assert got == sorted(c for x in (0, 16) for y in (0, 16) for c in cells(x, y, 16))


def test_smooth_labels(spark):
    rng = np.random.default_rng(4)
    n, s = 40, np.random.default_rng(4).integers(0, 20, (40, 3)) / 20
    edges = [(i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    label = [min(range(3), key=lambda k: (-s[i, k], k)) for i in range(n)]
    for _ in range(5):
        was = list(label)
        for half in (0, 1):
            new = list(label)
            for i in range(half, n, 2):
                total = [round(s[i, k] + 0.42 * sum(label[j] == k for a, j in edges if a == i), 9) for k in range(3)]
                new[i] = min(range(3), key=lambda k: (-total[k], k))
            label = new
        if label == was:
            break
    scores = spark.createDataFrame([(i, k, float(s[i, k])) for i in range(n) for k in range(3)], "node long, label int, score double")
    found = raster.smooth_labels(scores, spark.createDataFrame([(a, b, 1.0) for a, b in edges], "u long, v long, w double"))
    assert {r["node"]: r["label"] for r in found.collect()} == dict(enumerate(label))


def test_clip_and_pack(spark):
    t = spark.createDataFrame([(1, [-1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), (2, [5.0, 5.0, 5.0], [6.0, 5.0, 5.0], [5.0, 6.0, 5.0])], "tid long, a array<double>, b array<double>, c array<double>")
    got = raster.clip_triangles(t, [-0.5, -9.0, -9.0], [1.0, 9.0, 9.0]).collect()
    area = sum(abs(np.cross(np.subtract(r["b"], r["a"]), np.subtract(r["c"], r["a"]))[2]) / 2 for r in got)
    assert {r["tid"] for r in got} == {1} and len(got) == 2 and min(min(p[0] for p in (r["a"], r["b"], r["c"])) for r in got) == -0.5 and area == pytest.approx(0.875)
    s = spark.createDataFrame([(7, [1.0, 2.0, 3.0], [0.0, 0.0, 0.0], 0.0, [0.5, 0.0, 2.0], [2.0, 0.0, 0.0, 0.0])], "sid long, position array<double>, scale array<double>, opacity double, colour array<double>, turn array<double>")
    x = np.frombuffer(bytes(raster.packed_splats(s).first()["packed"]), dtype=raster.SPLAT)[0]
    assert x["position"].tolist() == [1, 2, 3] and x["scale"].tolist() == [1, 1, 1] and x["colour"].tolist() == [128, 0, 255, 128] and x["turn"].tolist() == [255, 128, 128, 128]
