"""Phases, journals, rasters and published datasets on small folders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import phase, publish

LENS = {"width": 4, "height": 3, "fx": 220.0, "fy": 221.0, "cx": 1.5, "cy": 1.0}


def manifest(**more):
    return {"schemaVersion": 3, "camera": LENS | {"depth_scale": 1000.0, "max_depth_m": 4.2}, "rgbCamera": LENS | {"model": "pinhole", "distortion": []}, "rgbFromDepth": np.eye(4).ravel().tolist()} | more


def folder(at, journal=(), **more):
    at.mkdir()
    (at / "phase.json").write_text(json.dumps(manifest(**more)))
    rows = [f"{i},{i + 10},{100_000 * i},depth/{i}.u16,color/{i}.rgb" for i in range(4)]
    (at / "frames.csv").write_text("\n".join(["index,source_sequence,timestamp_us,depth_path,color_path", *rows]) + "\n")
    (at / "imu.csv").write_text("timestamp_us,type,x,y,z,temperature_c\n5,gyro,0,0,0.25,\n1,accel,0,-9.81,0,20\n2,mag,0,0,0,\n3,gyro,q,0,0,\n")
    if journal:
        (at / "tracking.jsonl").write_text("\n".join(j if isinstance(j, str) else json.dumps(j) for j in journal))
    return str(at)


def pose(x):
    m = np.eye(4)
    m[0, 3] = x
    return m.ravel().tolist()


def test_phase(spark, tmp_path):
    line = lambda s, ok=True, **k: {"schemaVersion": 1, "sequence": s, "accepted": ok} | k
    log = [line(10, worldToCamera=pose(0), overlap=0.5), line(11, False, worldToCamera=pose(9)), line(12, worldToCamera=pose(-0.1)), "no json", line(12, worldToCamera=pose(-0.2), overlap=0.7), line(12, worldToCamera=[1.0] * 15)]
    log += [line(13, worldToCamera=[0.0] * 16), line(13, False), line(10, schemaVersion=2, accepted=False), line(11, worldToCamera=pose(5)), {"schemaVersion": 1, "accepted": False}, line(12, False, sequence="x"), line(10, worldToCamera="no list")]
    at = folder(tmp_path / "a", log, imu={"coordinateFrame": "depth_camera"})
    p = phase.phase(spark, at)
    assert {r["source_sequence"]: r["tracked"] and r["tracked"][3] for r in p.frames.collect()} == {10: 0.0, 12: 0.2}
    assert p.frames.where("pose IS NOT NULL").count() == 0
    every = phase.phase(spark, at, include_rejected=True).frames
    assert sorted(r["source_sequence"] for r in every.collect()) == [10, 11, 12, 13]
    assert [(r["ts_us"], r["kind"]) for r in p.imu.collect()] == [(1, "accel"), (5, "gyro")]
    assert p.quality.first()["mean_overlap"] == pytest.approx(0.6) and p.quality.first()["mean_rmse_mm"] is None
    plain = phase.phase(spark, folder(tmp_path / "b", imu={"coordinateFrame": "body"}))
    assert plain.frames.count() == 4 and plain.imu.count() == 0
    with pytest.raises(ValueError):
        phase.phase(spark, folder(tmp_path / "c", [line(s, False) for s in range(10, 14)]))
    (tmp_path / "b" / "frames.csv").write_text("index,source_sequence,timestamp_us,depth_path,color_path\n0,x,0,a,b\n")
    with pytest.raises(Exception):
        phase.phase(spark, str(tmp_path / "b")).frames.collect()


@pytest.mark.parametrize("wrong", [{"schemaVersion": 2}, {"camera": LENS | {"fx": 0}}, {"camera": LENS | {"fx": float("nan")}}, {"rgbCamera": LENS | {"model": "fisheye", "distortion": []}}, {"rgbCamera": LENS | {"model": "brown_conrady", "distortion": [0.1]}}, {"rgbFromDepth": [1.0] * 15}, {"rgbFromDepth": (1.5 * np.eye(4)).ravel().tolist()}, {"rgbFromDepth": np.diag([-1.0, 1, 1, 1]).ravel().tolist()}])
def test_manifests_are_strict(wrong):
    with pytest.raises(ValueError):
        phase.checked(manifest(**wrong), "here")


def test_small_scale_errors_are_mended():
    m = np.eye(4)
    m[0, 0] = 1.005
    assert np.allclose(phase.checked(manifest(rgbFromDepth=m.ravel().tolist()), "")["rgbFromDepth"], np.eye(4).ravel())


def test_colour_raster_and_photos(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "0.rgb").write_bytes(bytes(range(18)))
    found = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in phase.colour_pixels(spark, str(tmp_path / "r"), 3, 2).collect()}
    assert found[2, 1] == (15, 16, 17) and len(found) == 6
    with pytest.raises(Exception):
        phase.colour_pixels(spark, str(tmp_path / "r"), 2, 2).collect()
    photo = lambda i, status, n=16: {"id": i, "status": status, "width": 2, "height": 2, "worldFromCamera": [1.0] * n}
    (tmp_path / "p.json").write_text(json.dumps({"photos": [photo("a", "localized"), photo("b", "failed", 3)]}))
    assert [r["photo"] for r in phase.posed_photos(spark, str(tmp_path / "p.json")).collect()] == ["a"]
    (tmp_path / "p.json").write_text(json.dumps({"photos": [photo("a", "localized", 3)]}))
    with pytest.raises(Exception):
        phase.posed_photos(spark, str(tmp_path / "p.json")).collect()


def test_synthetic_project(spark):
    frames, pixels = phase.synthetic(spark, 2, 4)
    assert frames.count() == 8 and pixels.count() == 8 * 48 * 36
    r = pixels.where("phase = 1 AND index = 2 AND x = 7 AND y = 5").first()
    assert (r["d"], r["r"], r["g"], r["b"]) == (int(2100 + 120 * np.sin(7 / 6 + 0.25) + 50 * np.cos(1.0)), 37, 30, 160)
    assert frames.where("phase = 1 AND index = 3").first()["pose"][3] == pytest.approx(0.38)


def test_published_datasets(spark, tmp_path):
    root = str(tmp_path / "d")
    first = publish.publish(spark, root, spark.range(5))
    assert publish.published(spark, root).count() == 5
    publish.publish(spark, root, spark.range(7), {"note": "x", "none": None})
    assert publish.published(spark, root).count() == 7 and spark.read.parquet(f"{root}/{first}").count() == 5
    pointer = phase.document(spark, f"{root}/current.json")
    assert pointer["note"] == "x" and "none" not in pointer and not list((tmp_path / "d").glob("*.tmp"))
    publish.replace_document(spark, f"{root}/current.json", {"schemaVersion": 1, "version": "../x", "rows": 1})
    with pytest.raises(ValueError):
        publish.published(spark, root)


def test_quarantine_and_export(spark, tmp_path):
    kept = str(tmp_path / "kept")
    assert publish.load_or_quarantine(spark, kept, ["id"]) is None
    spark.range(3).write.parquet(kept)
    assert publish.load_or_quarantine(spark, kept, ["id"]).count() == 3
    assert publish.load_or_quarantine(spark, kept, ["id", "pose"]) is None and len(list(tmp_path.glob("kept.corrupt-*"))) == 1
    (tmp_path / "kept").mkdir()
    (tmp_path / "kept" / "part-0.parquet").write_bytes(b"no parquet")
    assert publish.load_or_quarantine(spark, kept, ["id"]) is None
    out = tmp_path / "out.txt"
    publish.export(spark, str(out), lambda p: open(p, "w").write("one"))
    publish.export(spark, str(out), lambda p: open(p, "w").write("two"))

    def broken(p):
        open(p, "w").write("half")
        raise OSError("disk")

    with pytest.raises(OSError):
        publish.export(spark, str(out), broken)
    assert out.read_text() == "two" and sorted(p.name for p in tmp_path.glob("out*")) == ["out.txt"]


def test_imu_writer_and_sidecars(spark, tmp_path):
    s = spark.createDataFrame([(5, "gyro", 0.0, 0.0, 0.25, None), (1, "accel", 0.0, -9.81, 0.0, 20.0)], "timestamp_us long, type string, x double, y double, z double, temperature_c double")
    publish.imu_csv(s, str(tmp_path / "imu"))
    from plumbline.sources.readers import imu

    assert [(r["ts_us"], r["z"]) for r in imu(spark, str(tmp_path / "imu")).orderBy("ts_us").collect()] == [(1, 0.0), (5, 0.25)]
    c = spark.createDataFrame([("a", 0.0, 1.0, 2.0, 0.5), ("a", 1.0, -1.0, 2.0, 1.0)], "g string, x double, y double, z double, opacity double")
    assert json.loads(publish.sidecars(c, "g").first()["json"]) == {"count": 2, "min": [0, -1, 2], "max": [1, 1, 2], "opacity": 0.75}


def test_inverse_of_any_matrix(spark):
    from plumbline.functions import rigid

    rng = np.random.default_rng(3)
    for m in [rng.normal(size=(4, 4)) for _ in range(3)]:
        det, back = rigid.inverse([F.lit(float(v)) for v in m.ravel()])
        row = spark.range(1).select(det.alias("d"), F.array(*back).alias("m")).first()
        assert row["d"] == pytest.approx(np.linalg.det(m)) and np.allclose(np.array(row["m"]).reshape(4, 4), np.linalg.inv(m))
