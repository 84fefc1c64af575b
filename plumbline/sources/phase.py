"""A capture phase as tables: manifest, frames, tracking journal and IMU, and a synthetic project."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import rigid
from plumbline.operators.poses import nearest_rotation
from plumbline.sources.readers import imu

#: Lens models and how many coefficients each has.
LENSES = {"pinhole": 0, "none": 0, "brown_conrady": 5, "opencv_rational": 8}
MATRIX = [f"m{i}{j}" for i in range(4) for j in range(4)]


@dataclass(frozen=True)
class Phase:
    """manifest: the checked document. frames: index, source_sequence, timestamp_us, paths, pose, tracked (the journal's camera to world), accepted by the journal or not named in it. quality: one row of means."""

    manifest: dict
    frames: DataFrame
    imu: DataFrame
    quality: DataFrame


def document(spark: SparkSession, path: str) -> dict:
    """A small JSON document from any path that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def checked(manifest: dict, where: str) -> dict:
    """The manifest, its colour transform made rigid; an error names what is wrong."""

    def need(holds: bool, what: str) -> None:
        if not holds:
            raise ValueError(f"{what}: {where}")

    need(manifest.get("schemaVersion") == 3, "not capture schema 3")
    for name in ("camera", "rgbCamera"):
        lens = manifest.get(name) or {}
        numbers = [lens.get(k) for k in ("width", "height", "fx", "fy", "cx", "cy")] + ([lens.get("depth_scale", 1000.0), lens.get("max_depth_m", 4.5)] if name == "camera" else [])
        need(all(isinstance(v, (int, float)) and math.isfinite(v) for v in numbers), f"{name} calibration is not complete")
        need(min(numbers[:4] + numbers[6:]) > 0, f"{name} calibration is not positive")
    colour = manifest["rgbCamera"]
    need(isinstance(colour.get("distortion"), list) and LENSES.get(colour.get("model")) == len(colour["distortion"]) and all(isinstance(v, (int, float)) and math.isfinite(v) for v in colour["distortion"]), "the colour lens is unknown or not complete")
    motion = manifest.get("rgbFromDepth")
    need(isinstance(motion, list) and len(motion) == 16 and all(isinstance(v, (int, float)) and math.isfinite(v) for v in motion), "no transform from depth to colour")
    m = np.array(motion, dtype=np.float64).reshape(4, 4)
    need(bool(np.allclose(m[3], [0, 0, 0, 1], atol=1e-6)), "the transform from depth to colour is not one")
    need(np.linalg.det(m[:3, :3]) > 0, "the transform from depth to colour is mirrored")
    try:  # devices are off by half a percent; more is an error
        m[:3, :3] = nearest_rotation(m[:3, :3], 0.03)
    except ValueError as e:
        raise ValueError(f"the transform from depth to colour does not turn: {where}") from e
    return manifest | {"rgbFromDepth": m.ravel().tolist()}


def tracking(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """(position, sequence, accepted, overlap, depthRmseMm, tracked) of a journal's lines.

    Lines that are no JSON, of another version or without a sequence are left out. tracked: the
    inverse of worldToCamera, null if that is not 16 finite numbers or cannot be inverted.
    """
    lines = spark.read.text(path).withColumn("position", F.monotonically_increasing_id())
    at = lambda name, kind: F.expr(f"try_cast(get_json_object(value, '$.{name}') AS {kind})")
    x = lines.select("position", at("schemaVersion", "int").alias("v"), at("sequence", "long").alias("sequence"), F.coalesce(at("accepted", "boolean"), F.lit(False)).alias("accepted"), at("overlap", "double").alias("overlap"), at("depthRmseMm", "double").alias("depthRmseMm"), F.from_json(F.get_json_object("value", "$.worldToCamera"), "array<double>").alias("m"))
    x = x.where((F.col("v") == version) & F.col("sequence").isNotNull())
    whole = F.when((F.size("m") == 16) & F.forall("m", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.col("m"))
    det, back = rigid.inverse([F.get("_m", F.lit(i)) for i in range(16)])
    return x.withColumn("_m", whole).withColumn("tracked", F.when(F.abs(det) > 1e-12, F.array(*back))).select("position", "sequence", "accepted", "overlap", "depthRmseMm", "tracked")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """The frame index by the names of its columns, strict: a number that does not parse fails (S4). Columns that it lacks are null; a pose needs all of its 16 numbers."""
    raw = spark.read.option("header", True).csv(path)
    has = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    pose = F.when(F.forall(F.array(*[has(c) for c in MATRIX]), lambda v: v.isNotNull()), F.array(*[has(c).cast("double") for c in MATRIX]))
    return raw.select(has("index").cast("int").alias("index"), has("source_sequence").cast("long").alias("source_sequence"), has("timestamp_us").cast("long").alias("timestamp_us"), has("depth_path").alias("depth_path"), has("color_path").alias("color_path"), has("rgb_path").alias("rgb_path"), has("rgb_timestamp_us").cast("long").alias("rgb_timestamp_us"), pose.alias("pose"))


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def phase(spark: SparkSession, root: str, include_rejected: bool = False) -> Phase:
    """A phase's folder: phase.json, frames.csv, tracking.jsonl (if there), and IMU samples if the manifest says that they are in the depth camera's frame.

    Frames that the journal rejects once are left out (unless asked for); a phase without frames
    is an error. The last sound pose of a sequence counts. Samples are ordered by time.
    """
    manifest = checked(document(spark, f"{root}/phase.json"), root)
    index = frames(spark, f"{root}/frames.csv")
    if _there(spark, f"{root}/tracking.jsonl"):
        log = tracking(spark, f"{root}/tracking.jsonl")
    else:
        log = spark.createDataFrame([], "position long, sequence long, accepted boolean, overlap double, depthRmseMm double, tracked array<double>")
    rejected = log.where("NOT accepted").select(F.col("sequence").alias("source_sequence")).distinct()
    sound = log.where("accepted AND tracked IS NOT NULL")
    poses = sound.groupBy(F.col("sequence").alias("source_sequence")).agg(F.max_by("tracked", "position").alias("tracked"))
    kept = index if include_rejected else index.join(rejected, "source_sequence", "left_anti")
    kept = kept.join(poses, "source_sequence", "left")
    if kept.isEmpty():
        raise ValueError(f"a phase without frames: {root}")
    given = manifest.get("imu")
    samples = spark.createDataFrame([], "ts_us long, kind string, x double, y double, z double, temp_c double")
    if isinstance(given, dict) and given.get("coordinateFrame") == "depth_camera" and _there(spark, f"{root}/{given.get('path', 'imu.csv')}"):
        samples = imu(spark, f"{root}/{given.get('path', 'imu.csv')}")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c))
    quality = sound.agg(F.avg(finite("overlap")).alias("mean_overlap"), F.avg(finite("depthRmseMm")).alias("mean_rmse_mm"))
    return Phase(manifest, kept, samples.orderBy("ts_us"), quality)


def colour_pixels(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Raw rasters of three bytes a pixel as rows (path, x, y, r, g, b); a file of another size fails."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    sized = files.withColumn("content", F.when(F.col("length") == 3 * width * height, F.col("content")).otherwise(F.raise_error(F.lit("raster size")).cast("binary")))
    pixels = sized.select("path", F.posexplode(F.expr(f"transform(sequence(0, {width * height - 1}), i -> hex(substring(content, 3 * i + 1, 3)))")).alias("i", "h"))
    byte = lambda k: F.conv(F.substring("h", 2 * k + 1, 2), 16, 10).cast("int")
    return pixels.select("path", (F.col("i") % width).cast("int").alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), *[byte(k).alias(c) for k, c in enumerate("rgb")])


def posed_photos(spark: SparkSession, path: str) -> DataFrame:
    """(photo, width, height, pose) of a manifest of photos that were placed (S15, S16); a pose that is not 16 finite numbers fails."""
    raw = spark.read.option("multiLine", True).schema("photos array<struct<id:string,status:string,width:int,height:int,worldFromCamera:array<double>>>").json(path)
    p = raw.select(F.explode("photos").alias("p")).select("p.*").where("status = 'localized'")
    sound = (F.size("worldFromCamera") == 16) & F.forall("worldFromCamera", lambda v: v.isNotNull() & ~F.isnan(v))
    return p.select(F.col("id").alias("photo"), "width", "height", F.when(F.coalesce(sound, F.lit(False)), F.col("worldFromCamera")).otherwise(F.raise_error(F.lit("a photo's pose")).cast("array<double>")).alias("pose"))


def synthetic(spark: SparkSession, phases: int = 2, count: int = 10, width: int = 48, height: int = 36) -> tuple[DataFrame, DataFrame]:
    """Frames (phase, index, source_sequence, timestamp_us, pose) and pixels (phase, index, x, y, d, r, g, b) of a wavy wall seen by a camera that moves sideways."""
    f = spark.range(phases * count).select(F.expr(f"int(id div {count})").alias("phase"), F.expr(f"int(id % {count})").alias("index"))
    numbers = [F.lit(1.0 if i in (0, 5, 10, 15) else 0.0) for i in range(16)]
    numbers[3], numbers[11] = 0.35 * F.col("phase") + 0.01 * F.col("index"), 0.06 * F.col("phase")
    frames_ = f.select("phase", "index", F.col("index").cast("long").alias("source_sequence"), (F.col("index") * 100_000).cast("long").alias("timestamp_us"), F.array(*numbers).alias("pose"))
    p = f.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1)))).withColumns({"x": F.col("i") % width, "y": F.expr(f"int(i div {width})")})
    d = F.floor(2100 + 120 * F.sin(F.col("x") / 6 + F.col("index") / 8) + 50 * F.cos(F.col("y") / 5)).cast("int")
    return frames_, p.select("phase", "index", "x", "y", d.alias("d"), F.expr(f"int(x * 255 div {width})").alias("r"), F.expr(f"int(y * 220 div {height})").alias("g"), (130 + 30 * F.col("phase")).alias("b"))


def replayed(p: Phase) -> DataFrame:
    """The frames of a phase in order of time, those that the journal rejected included (read with include_rejected), with the turn that the gyroscope saw since the frame before.

    number: the place in the replay; rotation: nine numbers, null where there is no sound prior.
    """
    from pyspark.sql import Window

    from plumbline.operators.motion import gyro_prior

    w = Window.partitionBy("take").orderBy("timestamp_us", "index")
    f = p.frames.withColumn("take", F.lit(0)).withColumn("before", F.lag("timestamp_us").over(w)).withColumn("number", F.row_number().over(w) - 1)
    samples = p.imu.where("kind = 'gyro'").select(F.lit(0).alias("take"), F.col("ts_us").alias("t"), "x", "y", "z")
    windows = f.where("before IS NOT NULL").select("take", "before", "timestamp_us")
    found = gyro_prior(samples, windows, "take", "t", "before", "timestamp_us").dropDuplicates(["before", "timestamp_us"]).drop("take")
    return f.drop("take").join(found, ["before", "timestamp_us"], "left").drop("before")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """(source, image, timestamp_s) of a media manifest; sources whose path leads out of the project are left out."""
    from plumbline.sources.readers import safe_path

    raw = spark.read.option("multiLine", True).schema("observations array<struct<source:string,image:string,timestampSeconds:double>>").json(path)
    o = raw.select(F.explode("observations").alias("o")).select("o.source", "o.image", F.col("o.timestampSeconds").alias("timestamp_s"))
    return o.where(safe_path(F.col("source")) & safe_path(F.col("image")))


def located(spark: SparkSession, path: str) -> DataFrame:
    """(path, id) of project documents whose own `path` is the folder that they lie in."""
    raw = spark.read.schema("schemaVersion int, id string, path string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "project.json").json(path)
    at = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+|/[^/]*$", "")
    given = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^/+|/+$", "")
    return raw.withColumn("_at", at).where((F.col("schemaVersion") == 3) & (F.col("_at") == given)).select(F.col("_at").alias("path"), "id")
