"""Sinks that never show a half-written result: documents, datasets behind a pointer, exports with a backup."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.phase import _there, document

IMU_COLUMNS = ["timestamp_us", "type", "x", "y", "z", "temperature_c"]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Renames source to target, over what is there, in one step where the store can."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    (a, fs), (b, _) = _path(spark, source), _path(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(a), fs.makeQualified(b), options)


def replace_document(spark: SparkSession, path: str, value: dict) -> None:
    """A JSON document, written beside its place and renamed into it (K1, K19). Fields that are None are left out."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    p, fs = _path(spark, beside)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps({k: v for k, v in value.items() if v is not None}, ensure_ascii=False, indent=1).encode()))
        out.hsync()
    finally:
        out.close()
    replace(spark, beside, path)


def publish(spark: SparkSession, root: str, df: DataFrame, facts: dict | None = None) -> str:
    """Writes df as a version of the dataset at root, then points to it (K14, K15). Readers see the old version or the new one, and a failed write leaves only a staging folder."""
    version = uuid.uuid4().hex
    staging = f"{root}/staging-{version}"
    df.write.parquet(staging)
    replace(spark, staging, f"{root}/{version}")
    replace_document(spark, f"{root}/current.json", {"schemaVersion": 1, "version": version, "rows": spark.read.parquet(f"{root}/{version}").count(), **(facts or {})})
    return version


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that the dataset's pointer names (S22); an error if it names none, another schema, or rows that are not there."""
    pointer = document(spark, f"{root}/current.json")
    version = str(pointer.get("version", ""))
    if pointer.get("schemaVersion") != 1 or not version.isalnum():
        raise ValueError(f"the pointer is not one: {root}")
    df = spark.read.parquet(f"{root}/{version}")
    if df.count() != pointer["rows"]:
        raise ValueError(f"rows are missing: {root}/{version}")
    return df


def load_or_quarantine(spark: SparkSession, path: str, columns: list[str]) -> DataFrame | None:
    """What is kept at path; None if there is nothing, or if it cannot be read or lacks columns: then it is moved aside."""
    if not _there(spark, path):
        return None
    try:
        df = spark.read.parquet(path)
        if set(columns) <= set(df.columns):
            df.select(F.count(F.struct(*columns))).first()
            return df
    except (PySparkException, Py4JJavaError):
        pass
    replace(spark, path, f"{path}.corrupt-{uuid.uuid4().hex}")
    return None


def export(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Lets `write` make a file or folder beside path and puts it there; what was there comes back if that fails, and goes if it does not."""
    beside, backup = f"{path}.{uuid.uuid4().hex}.tmp", f"{path}.{uuid.uuid4().hex}.bak"
    try:
        write(beside)
    except BaseException:
        p, fs = _path(spark, beside)
        fs.delete(p, True)
        raise
    before = _there(spark, path)
    if before:
        replace(spark, path, backup)
    try:
        replace(spark, beside, path)
    except BaseException:
        if before:
            replace(spark, backup, path)
        raise
    if before:
        p, fs = _path(spark, backup)
        fs.delete(p, True)


def imu_csv(samples: DataFrame, path: str) -> None:
    """IMU samples in the archive's columns, ordered by time within the files."""
    samples.select(*IMU_COLUMNS).repartitionByRange("timestamp_us").sortWithinPartitions("timestamp_us").write.option("header", True).csv(path)


def sidecars(splats: DataFrame, group: str) -> DataFrame:
    """(group, json): a document beside each cloud with its size, bounds and mean opacity (K8)."""
    bounds = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    x = splats.groupBy(group).agg(F.count("*").alias("count"), *bounds, F.round(F.avg("opacity"), 6).alias("opacity"))
    corner = lambda n: F.array(*[F.round(f"{n}_{c}", 6) for c in "xyz"])
    return x.select(group, F.to_json(F.struct("count", corner("min").alias("min"), corner("max").alias("max"), "opacity")).alias("json"))


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """One binary document, to any store that Spark writes."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def rasters(spark: SparkSession, pixels: DataFrame, frame: str, folder: str, width: int, height: int) -> list[str]:
    """Writes a raw little-endian 16-bit raster for each frame of (frame, x, y, d), 0 where there is none, and returns the paths.

    Rasters are packed by frame in parallel and reach the driver one at a time.
    """
    import numpy as np
    import pandas as pd

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        raster = np.zeros((height, width), dtype="<u2")
        raster[part["y"], part["x"]] = part["d"]
        return pd.DataFrame({"name": [f"{int(key[0]):06}.u16"], "raw": [raster.tobytes()]})

    paths = []
    for r in pixels.select(frame, "x", "y", "d").groupBy(frame).applyInPandas(pack, "name string, raw binary").toLocalIterator():
        paths.append(f"{folder}/{r['name']}")
        write_bytes(spark, paths[-1], bytes(r["raw"]))
    return sorted(paths)


def initialization(points: DataFrame, path: str) -> None:
    """What a training starts from: places, colours, log scales, turns and opacities, as Parquet."""
    points.select("x", "y", "z", "r", "g", "b", "scale", "turn", "opacity").write.parquet(path)


def first_sound(*makers: Callable[[], DataFrame]) -> DataFrame:
    """The first of several strategies whose result has rows; one that fails counts as one without (X4, X19). The last one's error is raised."""
    last: Exception | None = None
    for make in makers:
        try:
            df = make()
            if not df.isEmpty():
                return df
        except (PySparkException, Py4JJavaError, ValueError) as e:
            last = e
    if last is not None:
        raise last
    return df


def splat_document(spark: SparkSession, splats: DataFrame, path: str) -> int:
    """One binary PLY document of any number of splats, in order of sid, written as its rows arrive; their number (K6)."""
    import struct

    from plumbline.sources.binary import SPLAT, splat_rows

    rows = splat_rows(splats)
    n = rows.count()
    pack = struct.Struct(f"<{len(SPLAT)}f")
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray((f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n" + "".join(f"property float {c}\n" for c in SPLAT) + "end_header\n").encode()))
        held = bytearray()
        for r in rows.orderBy("sid").select(*SPLAT).toLocalIterator():
            held += pack.pack(*r)
            if len(held) > 1 << 20:
                out.write(held)
                held = bytearray()
        out.write(held)
    finally:
        out.close()
    return n
