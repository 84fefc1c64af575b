"""Documents in binary and text forms: round trips and damaged ones."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import binary, readers

MAGIC = b"TESTRGBD"


def frame(sequence=1, color=True):
    return {
        "sequence": sequence, "depth_us": 10, "color_us": 11, "width": 4, "height": 3, "fx": 220.0, "fy": 221.0, "cx": 1.5, "cy": 1.0, "depth_scale": 1000.0, "min_m": 0.25, "max_m": 5.0,
        "gyro": [0.0, 0.5, 0.0, 0.5], "pose": np.arange(16.0).tolist() if color else None, "mirrored": color, "depth": struct.pack("<12H", *range(0, 1200, 100)), "color": bytes(range(36)) if color else None,
    }


def test_stream_round_trip(spark, tmp_path):
    whole = [frame(1), frame(2, color=False)]
    raw = b"".join(binary.write_frame(f, MAGIC) for f in whole)
    assert list(binary.read_frames(io.BytesIO(raw), MAGIC)) == whole
    (tmp_path / "a.bin").write_bytes(raw)
    (tmp_path / "empty.bin").write_bytes(b"")
    rows = binary.rgbd_frames(spark, str(tmp_path), MAGIC).orderBy("sequence").collect()
    assert [{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items() if k != "path"} for r in rows] == whole


@pytest.mark.parametrize("change", [lambda b: b[:-17], lambda b: b[:100], lambda b: b"X" + b[1:], lambda b: b[:40] + b"\0\0\0\0" + b[44:], lambda b: b[:48] + struct.pack("<f", float("nan")) + b[52:], lambda b: b[:-36]])
def test_damaged_streams_fail(change):
    with pytest.raises(ValueError):
        list(binary.read_frames(io.BytesIO(change(binary.write_frame(frame(), MAGIC))), MAGIC))


def test_ply_forms(spark, tmp_path):
    rows = [(1.5, 2, 200), (-0.25, -7, 0)]
    head = "ply\nformat {}\ncomment none\nelement vertex 2\nproperty float x\nproperty short k\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_bytes(head.format("ascii 1.0").encode() + b"1.5 2 200\n-0.25 -7 0\n3 0 1 1\n")
    for name, order in (("little", "<"), ("big", ">")):
        (tmp_path / f"{name}.ply").write_bytes(head.format(f"binary_{name}_endian 1.0").encode() + b"".join(struct.pack(order + "fhB", *r) for r in rows) + struct.pack(order + "Biii", 3, 0, 1, 1))
    for name in ("a", "little", "big"):
        path = str(tmp_path / f"{name}.ply")
        assert [tuple(r)[2:] for r in binary.ply(spark, path).orderBy("row").collect()] == rows
        assert [r["vertex_indices"] for r in binary.ply(spark, path, "face").collect()] == [[0, 1, 1]]
    short = (tmp_path / "little.ply").read_bytes()[:-15]
    with pytest.raises(ValueError):
        binary._element_rows(short, "vertex")
    with pytest.raises(ValueError):
        binary.ply_header(b"plx\nend_header\n")


def test_splat_document(spark, tmp_path):
    rest = [[float(100 * k + c) for c in range(3)] for k in range(15)]
    df = spark.createDataFrame([(2, [1.0, 2.0, 3.0], [0.1, 0.2, 0.3], rest, 0.5, [-1.0, -2.0, -3.0], [1.0, 0.0, 0.0, 0.0]), (1, [0.0] * 3, [0.0] * 3, None, 0.0, [0.0] * 3, [1.0, 0.0, 0.0, 0.0])], "sid long, position array<double>, sh0 array<double>, rest array<array<double>>, opacity double, scale array<double>, turn array<double>")
    (tmp_path / "s.ply").write_bytes(binary.splat_ply(df))
    back = binary.ply(spark, str(tmp_path / "s.ply")).orderBy("row").collect()
    assert len(binary.SPLAT) == 62 and back[0]["f_rest_44"] == 0 and back[1]["z"] == 3
    assert [back[1][f"f_rest_{k}"] for k in (0, 1, 15, 44)] == [0, 100, 1, 1402]
    with pytest.raises(ValueError):
        binary.splat_ply(df, most=1)


def test_listings_and_paths(spark, tmp_path):
    for name, text in (("a", '{"schemaVersion":3,"id":"a","createdAt":"2024-01-01T00:00:00Z"}'), ("b", '{"schemaVersion":3,"id":"b","createdAt":"2025-01-01T00:00:00Z"}'), ("c", "no json"), ("d", '{"schemaVersion":2,"id":"d"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "project.json").write_text(text)
    assert [r["id"] for r in readers.project_listing(spark, str(tmp_path)).collect()] == ["b", "a"]
    (tmp_path / "i.csv").write_text("index\n1\n\n2\n  \n")
    assert readers.indexed_frames(spark, str(tmp_path / "i.csv")).first()["frames"] == 2
    (tmp_path / "beat").write_text("on")
    assert readers.live_workers(spark, str(tmp_path / "beat"), 600).first()["status"] == "on"
    paths = spark.createDataFrame([(p,) for p in ("a/b.png", "a..b", "/a", "..", "a/../b", "C:/a", "a\\..\\b", "", None)], "p string")
    assert [r["p"] for r in paths.where(readers.safe_path(F.col("p"))).collect()] == ["a/b.png", "a..b"]


def test_text_sinks(spark, tmp_path):
    v = spark.createDataFrame([(5, 0.1, 0.0, 0.0), (7, 1.0, 0.0, 0.0), (9, 0.0, 1.0, 0.0), (11, 9.0, 9.0, 9.0)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(1, 9, 5, 7), (2, 5, 7, 99)], "tid long, a long, b long, c long")
    lines = [r["line"] for r in readers.obj_lines(t, v).orderBy("part", "key").collect()]
    assert [float(w) for w in lines[0].split()[1:]] == [0.1, 0.0, 0.0] and len(lines) == 4 and lines[3] == "f 3 1 2"
    p = spark.createDataFrame([(k, k / 3, 0.0, 0.0, 1, 2, 3) for k in range(9)], "i long, x double, y double, z double, r int, g int, b int")
    assert [r["json"] for r in readers.preview(p, ["i"], 3).orderBy("i").collect()] == ["[0.0,0.0,0.0,1.0,2.0,3.0]", "[1.33333,0.0,0.0,1.0,2.0,3.0]", "[2.66667,0.0,0.0,1.0,2.0,3.0]"]
    c = spark.createDataFrame([(1, "f", [1 / 3] * 16, 1.0, 2.0, 3.0, 1 / 3)], "i int, name string, pose array<double>, fx double, fy double, cx double, cy double")
    assert '"cy":0.33333333' in readers.camera_poses(c, "i").first()["json"]


def test_splat_document_as_it_arrives(spark, tmp_path):
    from plumbline.sources import publish

    df = spark.createDataFrame([(i, [float(i), 0.0, 0.0], [0.1] * 3, None, 0.5, [-1.0] * 3, [1.0, 0.0, 0.0, 0.0]) for i in (3, 1, 2)], "sid long, position array<double>, sh0 array<double>, rest array<array<double>>, opacity double, scale array<double>, turn array<double>")
    assert publish.splat_document(spark, df, str(tmp_path / "s.ply")) == 3
    assert (tmp_path / "s.ply").read_bytes() == binary.splat_ply(df)
