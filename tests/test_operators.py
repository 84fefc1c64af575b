"""Readers, selections, streaming and geometry on small fixtures with closed-form results."""

import math
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.operators import relational as rel
from plumbline.operators.graph import connected_components
from plumbline.operators.selection import farthest_points, greedy_coverage, nearest_references
from plumbline.plans import catalogue
from plumbline.sources import readers, store
from plumbline.streaming.live import integrate, latest_wins


def test_frame_index_is_strict(spark, tmp_path):
    head = "index,source_sequence,timestamp_us,depth_path,color_path,rgb_path,rgb_timestamp_us\n"
    (tmp_path / "good.csv").write_text(head + "0,5,100,a,b,,\n")
    row = readers.frame_index(spark, str(tmp_path / "good.csv")).first()
    assert row["source_sequence"] == 5 and row["rgb_timestamp_us"] is None
    (tmp_path / "bad.csv").write_text(head + "0,x,100,a,b,,\n")
    with pytest.raises(Exception):
        readers.frame_index(spark, str(tmp_path / "bad.csv")).collect()


def test_journal_is_tolerant(spark, tmp_path):
    pose = [1.0] * 16
    (tmp_path / "j.jsonl").write_text("\n".join(['{"schemaVersion":1,"sequence":1,"accepted":true,"worldToCamera":%s}' % pose, "no json", '{"schemaVersion":2,"sequence":2,"accepted":true}', '{"schemaVersion":1,"sequence":3,"accepted":false}', '{"schemaVersion":1,"sequence":1,"accepted":true,"worldToCamera":%s}' % ([2.0] * 16)]))
    rows = readers.journal(spark, str(tmp_path / "j.jsonl")).withColumn("position", F.monotonically_increasing_id())
    assert sorted(r["sequence"] for r in rows.collect()) == [1, 1, 3]
    assert [(r["sequence"], r["pose"][0]) for r in readers.journal_poses(rows).collect()] == [(1, 2.0)]


def test_imu_loses_bad_rows_alone(spark, tmp_path):
    (tmp_path / "imu.csv").write_text("timestamp_us,type,x,y,z,temperature_c\n0,gyro,0,0,0.25,\n1,accel,0,-9.81,0,20\n2,mag,0,0,0,\n3,gyro,q,0,0,\n4,gyro,0,NaN,0,\n5,gyro,0,Infinity,0,\n")
    assert [(r["ts_us"], r["temp_c"]) for r in readers.imu(spark, str(tmp_path / "imu.csv")).orderBy("ts_us").collect()] == [(0, None), (1, 20.0)]


def test_depth_raster(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "0.raw").write_bytes(struct.pack("<6H", 0, 300, 2, 65535, 0, 7))
    found = {(r["x"], r["y"]): r["d"] for r in readers.depth_pixels(spark, str(tmp_path / "d"), 3, 2).collect()}
    assert found == {(1, 0): 300, (2, 0): 2, (0, 1): 65535, (2, 1): 7}
    with pytest.raises(Exception):
        readers.depth_pixels(spark, str(tmp_path / "d"), 4, 2).collect()


def test_obj_and_ply(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 3/3\nf -3 -2 -1\n")
    v, c = readers.obj(spark, str(tmp_path / "m.obj"))
    assert v.count() == 3 and sorted((r["tid"], r["corner"], r["vid"]) for r in c.collect()) == [(t, k, k + 1) for t in (1, 2) for k in range(3)]
    raw = readers.ply_bytes(spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4, 5, 6)], "i int, x double, y double, z double, r int, g int, b int"), "i")
    assert raw.endswith(struct.pack("<fff3B", 1, 2, 3, 4, 5, 6)) and b"element vertex 1" in raw


def test_projects_and_store(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"schemaVersion":3,"id":"a","phases":[{"id":"1","frameCount":2},{"id":"2","frameCount":0},{"id":"3","frameCount":4,"status":"recording"}]}')
    assert [r["id"] for r in readers.phases(readers.projects(spark, str(tmp_path / "p.json"))).collect()] == ["1"]
    (tmp_path / "q.json").write_text('{"schemaVersion":2,"id":"a","phases":[]}')
    with pytest.raises(Exception):
        readers.projects(spark, str(tmp_path / "q.json")).collect()
    made = []
    for _ in range(2):
        df = store.materialized(spark, str(tmp_path / "s"), ("x", 1), lambda: made.append(1) or spark.range(3))
        assert df.count() == 3
    assert made == [1]


def test_selection(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    chosen = [0, 49]
    while len(chosen) < 10:
        far = np.min([((x - x[c]) ** 2).sum(1) for c in chosen], axis=0)
        chosen.append(int(far.argmax()))
    assert [r["i"] for r in farthest_points(d, "i", "v", 10).orderBy("step").collect()] == chosen
    found = {(r["i"], r["rank"]): r["ref"] for r in nearest_references(d, d, "i", "v", 2).collect()}
    dist = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(dist, np.inf)
    assert all(found[i, 1] == dist[i].argmin() for i in range(50))
    s = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 2, 1.5), ("c", 3, 0.4), ("d", 1, 0.5)], "v string, i int, s double")
    assert greedy_coverage(s, "v", "i", "s", 5) == [("a", 2.0), ("b", 0.5), ("c", 0.4)]


def test_relational(spark):
    rows = spark.range(1, 11).withColumn("k", F.lit(1))
    assert [r["fragment"] for r in rel.fragments(rows.where("id <= 5"), "k", ["id"]).orderBy("id").collect()] == [0] * 5
    assert [r["fragment"] for r in rel.fragments(rows, "k", ["id"]).orderBy("id").collect()] == [0] * 4 + [1] * 4 + [2] * 2
    for n, keep in ((7, 3), (100, 9), (5, 10), (10, 1)):
        got = sorted(r["id"] for r in rel.evenly_spaced(spark.range(n), ["id"], keep).collect())
        assert got == (sorted({i * (n - 1) // (keep - 1) for i in range(keep)}) if 1 < keep < n else [0] if keep == 1 else list(range(n)))
    w = spark.createDataFrame([(1, 10, 20), (1, 15, 90)], "k int, a int, b int")
    r = spark.createDataFrame([(1, t) for t in (9, 10, 20, 21, 90)], "k int, t int")
    for bucket in (None, 7.0):
        assert rel.interval_join(r, w, "k", "t", "a", "b", bucket).count() == 5


def test_places_of_rows_wider_than_their_keys(spark):
    """Ranges of wide rows are merged otherwise than ranges of the same rows' keys."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(40_000).withColumn("wide", F.sha2(F.col("id").cast("string"), 512))
        got = rel._numbered(rows.repartition(8), ["id"]).select("id", "_i", "_n", "wide").collect()
        assert len(got) == 40_000 and all(r["_i"] == r["id"] and r["_n"] == 40_000 for r in got)
        docs = rows.select("id", "wide").where("id < 30000").repartition(8)
        assert sorted(r["id"] for r in rel.evenly_spaced(docs, ["id"], 100).collect()) == [q * 29_999 // 99 for q in range(100)]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_training_order_has_every_step_once(spark, tmp_path):
    merged = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "260k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in merged.items():
        spark.conf.set(k, v)
    try:
        spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
        got = catalogue.queries()["training_order"](spark, str(tmp_path)).select("step").collect()
        assert sorted(r["step"] for r in got) == list(range(len(got))) and len(got) == 4 * 2 * 26_666
    finally:
        for k in merged:
            spark.conf.unset(k)


def test_training_order_without_ids(spark, tmp_path):
    """Documents without an id are last in SQL's order, not first."""
    rows = [(None if i % 9 == 4 else i, "en" if i % 3 else None if i % 2 else "de") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(c.sql(catalogue.oracle_sql()["training_order"]).fetchall())
    assert Counter(map(tuple, catalogue.queries()["training_order"](spark, str(tmp_path)).collect())) == want


def test_preview_rounds_as_sql(spark, tmp_path):
    spark.createDataFrame([(0, [-0.08385, 0.0, 0.0, 0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert [tuple(r) for r in catalogue.queries()["preview_points"](spark, str(tmp_path)).collect()] == c.sql(catalogue.oracle_sql()["preview_points"]).fetchall()


def one_thread(tmp_path, table, name):
    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    return sorted(c.sql(catalogue.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name, least", [("hole_decisions", 0.06), ("repair_summary", 0.04)])
def test_holes_on_a_limit(spark, tmp_path, name, least):
    """Parts whose mean tax is exactly a limit: only the order of the sum tells on which side the doubles fall."""
    rng = np.random.default_rng(4)
    rows = []
    for part in range(400):
        off = rng.integers(-2, 3, 10)
        tax = np.concatenate([least * 100 + off, least * 100 - off]) / 100
        rows += [(0, part, int(i % 3), int(i), 10.0, 100.0, 0.05, float(t)) for i, t in enumerate(tax)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, kind).repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect())) == one_thread(tmp_path, "lineitem", name)


def test_queue_and_gate(spark):
    q = spark.createDataFrame([(1, s) for s in (1, 2, 3)], "k int, s int")
    assert sorted((r["s"], r["dropped"]) for r in latest_wins(q, "k", "s", 2).collect()) == [(2, 1), (3, 1)]
    assert sorted(r["s"] for r in latest_wins(q, "k", "s", 2, drop_newest=True).collect()) == [1, 2]
    rows = [(i * 10, i, float(i % 4)) for i in range(20)]
    whole = integrate(None, rows, 2.0, 50)[1]
    state, parts = None, []
    for i in range(0, 20, 3):
        state, out = integrate(state, rows[i : i + 3], 2.0, 50)
        parts += out
    assert parts == whole


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_geometry(spark):
    one = spark.range(1)
    x, y = F.lit(0.4), F.lit(-0.2)
    u, v = geom.brown_lens(x, y, (0.1, 0.0, 0.0), (0.004, -0.002))
    m = geom.axis_rotation((F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(math.pi / 2))
    row = one.select(u.alias("u"), v.alias("v"), geom.apply_rigid(m, [F.lit(0.0)] * 3, [F.lit(1.0), F.lit(0.0), F.lit(0.0)])[1].alias("r"), geom.rotation_angle(F.lit(1.0)).alias("a"), geom.linear_to_srgb(geom.srgb_to_linear(F.lit(0.3))).alias("s"), geom.to_byte(F.lit(0.5)).alias("b"), geom.halton(F.lit(6), 2, 4).alias("h")).first()
    assert row["u"] == pytest.approx(0.4 * 1.02 + 2 * 0.004 * 0.4 * -0.2 - 0.002 * (0.2 + 0.32)) and row["r"] == pytest.approx(1)
    assert row["a"] == pytest.approx(90) and row["s"] == pytest.approx(0.3) and row["b"] == 128 and row["h"] == 0.375
