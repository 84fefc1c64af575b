"""Binary documents: PLY tables, splat clouds, framed RGB-D streams."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the PLY format: names of its number types.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
SPARK_TYPES = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "long", "f4": "float", "f8": "double"}
HEADER_MOST = 65_536


def ply_header(start: bytes) -> tuple[str, list[tuple[str, int, list[tuple[str, str]]]], int]:
    """(format, elements as (name, count, [(property, type)]), length of the header). A list property has the type "list COUNT ITEM"."""
    end = start.find(b"end_header")
    if not start.startswith(b"ply") or end < 0:
        raise ValueError("no PLY header")
    length = start.index(b"\n", end) + 1
    kind, elements = "", []
    for line in start[:end].decode("ascii").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            types = words[2:4] if words[1] == "list" else words[1:2]
            unknown = [t for t in types if t not in PLY_TYPES]
            if unknown or not elements:
                raise ValueError(f"PLY property {line!r}")
            elements[-1][2].append((words[-1], " ".join(["list", *types]) if words[1] == "list" else types[0]))
    if kind not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"PLY format {kind!r}")
    return kind, elements, length


def _element_rows(content: bytes, element: str) -> dict[str, list | np.ndarray]:
    """The columns of one element; ValueError where the file ends before its rows do."""
    kind, elements, at = ply_header(content)
    words = iter(content[at:].split()) if kind == "ascii" else iter(())
    order = ">" if kind == "binary_big_endian" else "<"
    for name, count, properties in elements:
        flat = not any(t.startswith("list") for _, t in properties)
        wanted = {p: [] for p, _ in properties}
        if kind != "ascii" and flat:
            row = np.dtype([(p, order + PLY_TYPES[t]) for p, t in properties])
            if len(content) - at < count * row.itemsize:
                raise ValueError("PLY rows are missing")
            table = np.frombuffer(content, row, count, at)
            at += count * row.itemsize
            wanted = {p: table[p].astype(table[p].dtype.newbyteorder("=")) for p, _ in properties}
        else:

            def number(t: str) -> int | float:
                nonlocal at
                if kind == "ascii":
                    w = next(words, None)
                    if w is None:
                        raise ValueError("PLY rows are missing")
                    return float(w) if PLY_TYPES[t][0] == "f" else int(w)
                d = np.dtype(order + PLY_TYPES[t])
                if len(content) - at < d.itemsize:
                    raise ValueError("PLY rows are missing")
                at += d.itemsize
                return np.frombuffer(content, d, 1, at - d.itemsize)[0].item()

            for _ in range(count):
                for p, t in properties:
                    if t.startswith("list"):
                        _, size, item = t.split()
                        wanted[p].append([number(item) for _ in range(int(number(size)))])
                    else:
                        wanted[p].append(number(t))
        if name == element:
            return wanted
    raise ValueError(f"PLY element {element!r} is missing")


def ply(spark: SparkSession, path: str, element: str = "vertex") -> DataFrame:
    """(path, row, one column a property) of the PLY files at a path, ASCII or binary, in either byte order.

    The columns come from the first file's header; all files must have them. One task reads a file. A damaged file fails the scan.
    """
    files = spark.read.format("binaryFile").load(path)
    first = files.select(F.substring("content", 1, HEADER_MOST).alias("s")).first()
    if first is None:
        raise ValueError("no PLY files")
    properties = next((p for n, _, p in ply_header(bytes(first["s"]))[1] if n == element), None)
    if properties is None:
        raise ValueError(f"PLY element {element!r} is missing")

    def kind(t: str) -> str:
        return f"array<{SPARK_TYPES[PLY_TYPES[t.split()[2]]]}>" if t.startswith("list") else SPARK_TYPES[PLY_TYPES[t]]

    def read(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                rows = _element_rows(bytes(content), element)
                n = len(next(iter(rows.values()))) if rows else 0
                for k in range(0, n, 65_536):
                    yield pd.DataFrame({"path": name, "row": np.arange(k, min(n, k + 65_536))} | {p: rows[p][k : k + 65_536] for p, _ in properties})

    return files.select("path", "content").mapInPandas(read, "path string, row long, " + ", ".join(f"`{p}` {kind(t)}" for p, t in properties))


#: The 62 floats of a splat in a PLY cloud: place, normal, colour, 45 rest coefficients by channel, opacity, scale, turn.
SPLAT = [*"xyz", "nx", "ny", "nz", *[f"f_dc_{k}" for k in range(3)], *[f"f_rest_{k}" for k in range(45)], "opacity", *[f"scale_{k}" for k in range(3)], *[f"rot_{k}" for k in range(4)]]


def splat_rows(splats: DataFrame) -> DataFrame:
    """(sid, the 62 columns of SPLAT) of (sid, position, sh0, rest, opacity, scale, turn): normals 0, rest turned from 15 triples to channels (K6).

    rest is an array of up to 15 arrays of three numbers; missing ones are 0.
    """
    by_channel = [F.coalesce(F.get(F.get("rest", F.lit(k)), F.lit(c)), F.lit(0.0)) for c in range(3) for k in range(15)]
    columns = [*[F.col("position")[k] for k in range(3)], *[F.lit(0.0)] * 3, *[F.col("sh0")[k] for k in range(3)], *by_channel, F.col("opacity"), *[F.col("scale")[k] for k in range(3)], *[F.col("turn")[k] for k in range(4)]]
    return splats.select("sid", *[c.cast("float").alias(n) for n, c in zip(SPLAT, columns)])


def splat_ply(splats: DataFrame, most: int = 4_000_000) -> bytes:
    """One binary PLY document of splat_rows in order of sid. A document has one writer: ValueError for more than `most` splats (1 GB)."""
    rows = splat_rows(splats)
    if rows.count() > most:
        raise ValueError("too many splats for one document")
    found = rows.orderBy("sid").toPandas()[SPLAT].to_numpy("<f4")
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(found)}\n" + "".join(f"property float {c}\n" for c in SPLAT) + "end_header\n"
    return head.encode() + found.tobytes()


# Fixed values of the stream format: the header's fields in order and its flags.
FRAME_FIELDS = ["magic", "version", "header_bytes", "flags", "sequence", "depth_us", "color_us", "width", "height", "fx", "fy", "cx", "cy", "depth_scale", "min_m", "max_m"]
FRAME_HEADER = struct.Struct("<8sHHIQQQII7f4f16fII")
HAS_COLOR, HAS_GYRO, HAS_POSE, MIRRORED = 1, 2, 4, 8
FRAME_PIXELS = 4096 * 4096
FRAME_ROW = "sequence long, depth_us long, color_us long, width int, height int, " + ", ".join(f"{c} float" for c in FRAME_FIELDS[9:]) + ", gyro array<float>, pose array<float>, mirrored boolean, depth binary, color binary"


def write_frame(row: dict, magic: bytes, version: int = 1) -> bytes:
    """The bytes of one frame: gyro, pose and color may be None."""
    flags = sum(bit for bit, name in ((HAS_COLOR, "color"), (HAS_GYRO, "gyro"), (HAS_POSE, "pose")) if row[name] is not None) | (MIRRORED if row["mirrored"] else 0)
    pixels = row["width"] * row["height"]
    color = row["color"] or b""
    if len(row["depth"]) != 2 * pixels or (row["color"] is not None and len(color) != 3 * pixels):
        raise ValueError("raster size")
    gyro, pose = row["gyro"] or [0.0, 0.0, 0.0, 1.0], row["pose"] or np.eye(4).ravel().tolist()
    return FRAME_HEADER.pack(magic, version, FRAME_HEADER.size, flags, *[row[c] for c in FRAME_FIELDS[4:]], *gyro, *pose, len(row["depth"]), len(color)) + row["depth"] + color


def read_frames(source: io.BufferedIOBase, magic: bytes, version: int = 1) -> Iterator[dict]:
    """The frames of a stream until its end; ValueError for anything that is no whole, sound frame."""
    while head := source.read(FRAME_HEADER.size):
        if len(head) < FRAME_HEADER.size:
            raise ValueError("stream ends within a header")
        v = FRAME_HEADER.unpack(head)
        row, (gyro, pose, sizes) = dict(zip(FRAME_FIELDS, v)), (v[16:20], v[20:36], v[36:])
        if row["magic"] != magic or row["version"] != version or row["header_bytes"] != FRAME_HEADER.size:
            raise ValueError("not a frame of this format")
        pixels, lens = row["width"] * row["height"], [row[c] for c in FRAME_FIELDS[9:]]
        if not 0 < pixels <= FRAME_PIXELS:
            raise ValueError("frame size")
        if not np.isfinite(lens).all() or min(row["fx"], row["fy"], row["depth_scale"]) <= 0 or row["max_m"] <= row["min_m"]:
            raise ValueError("frame calibration")
        if sizes != (2 * pixels, 3 * pixels if row["flags"] & HAS_COLOR else 0):
            raise ValueError("frame payload size")
        depth, color = source.read(sizes[0]), source.read(sizes[1])
        if (len(depth), len(color)) != sizes:
            raise ValueError("stream ends within a frame")
        flags = row["flags"]
        kept = {c: row[c] for c in FRAME_FIELDS[4:]}
        yield kept | {"gyro": list(gyro) if flags & HAS_GYRO else None, "pose": list(pose) if flags & HAS_POSE else None, "mirrored": bool(flags & MIRRORED), "depth": depth, "color": color if flags & HAS_COLOR else None}


def rgbd_frames(spark: SparkSession, path: str, magic: bytes, version: int = 1) -> DataFrame:
    """(path, FRAME_ROW) of recorded streams; one task reads a file, frame by frame. A damaged file fails the scan."""

    def read(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                for row in read_frames(io.BytesIO(bytes(content)), magic, version):
                    yield pd.DataFrame([{"path": name} | row])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, f"path string, {FRAME_ROW}")
