"""Nearest references over more of them than a block holds."""

import numpy as np

from plumbline.operators import selection


def test_more_references_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(selection, "MAX_REFERENCES", 30)
    x = np.random.default_rng(1).integers(-3, 4, size=(100, 3)).astype(float)  # with ties
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    for k in (5, None):
        found = {(r["i"], r["rank"]): r["ref"] for r in selection.nearest_references(d, d, "i", "v", k).collect()}
        assert found == {(i, n + 1): j for i in range(100) for n, j in enumerate(sorted(set(range(100)) - {i}, key=lambda j: (far[i, j], j))[:k])}
    assert selection.nearest_references(d, d.where("false"), "i", "v", 2).collect() == []


def test_more_candidates_than_the_driver_takes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    x[200:] = x[100:200]  # ties
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(5)
    whole = sorted(map(tuple, selection.farthest_points(d, "i", "v", 40).collect()))
    monkeypatch.setattr(selection, "MAX_CANDIDATES", 30)
    assert sorted(map(tuple, selection.farthest_points(d, "i", "v", 40).collect())) == whole


def test_another_order(spark):
    d = spark.createDataFrame([(i, [float(i)]) for i in range(300)], "i long, v array<double>")
    found = selection.nearest_references(d, d, "i", "v", 3, lambda d2, own, ref: -d2)
    assert {(r["i"], r["rank"]): r["ref"] for r in found.where("i = 10").collect()} == {(10, 1): 299, (10, 2): 298, (10, 3): 297}


def test_quantiles_beyond_what_a_task_sorts(spark, monkeypatch):
    from plumbline.operators import quantiles as q

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), [1e6, -1e6]])
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    shares = [0.0, 0.02, 0.5, 0.55, 0.9, 0.999, 1.0]
    whole = q.quantiles(d, d["v"], shares)
    assert np.allclose(whole, np.quantile(x, shares))
    monkeypatch.setattr(q, "SORTED", 500)
    monkeypatch.setattr(q, "BINS", 16)
    assert np.allclose(q.quantiles(d, d["v"], shares), np.quantile(x, shares))
    assert q.quantiles(d.where("false"), d["v"], [0.5]) == [None]
