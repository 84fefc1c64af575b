"""Typed readers of archive files, each with its own error policy, and writers that fit them."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "index int, source_sequence long, timestamp_us long, depth_path string, color_path string, rgb_path string, rgb_timestamp_us long"
JOURNAL = "schemaVersion int, sequence long, accepted boolean, overlap double, depthRmseMm double, worldToCamera array<double>"
PROJECT = "schemaVersion int, id string, name string, createdAt string, phases array<struct<id:string,name:string,frameCount:int,status:string>>"


def frame_index(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a number that does not parse fails the scan."""
    return spark.read.schema(FRAMES).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)


def journal(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Tolerant: lines that do not parse and entries of another version are left out."""
    return spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path).where(F.col("schemaVersion") == version)


def journal_poses(rows: DataFrame) -> DataFrame:
    """Of each sequence the last accepted pose of 16 numbers; entries without an order of their own are ordered by `position`."""
    sound = rows.where("accepted AND size(worldToCamera) = 16")
    return sound.groupBy("sequence").agg(F.max_by("worldToCamera", "position").alias("pose"))


def imu(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant per row: an unknown kind, or a field that is no finite number, loses the row; a blank temperature is null."""
    raw = spark.read.schema("timestamp_us string, type string, x string, y string, z string, temperature_c string").option("header", True).csv(path)
    typed = raw.selectExpr("try_cast(timestamp_us AS long) ts_us", "type kind", *[f"try_cast({c} AS double) {c}" for c in "xyz"], "try_cast(temperature_c AS double) temp_c")
    finite = F.lit(True)
    for c in "xyz":
        finite &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return typed.where(F.col("ts_us").isNotNull() & F.col("kind").isin("accel", "gyro") & finite)


def projects(spark: SparkSession, path: str) -> DataFrame:
    """Project documents of schema 3; others fail."""
    p = spark.read.schema(PROJECT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return p.withColumn("schemaVersion", F.when(F.col("schemaVersion") == 3, F.col("schemaVersion")).otherwise(F.raise_error(F.lit("unsupported project schema")).cast("int")))


def phases(project: DataFrame) -> DataFrame:
    """Phases that are complete (the default) and not empty."""
    p = project.select("id", F.explode("phases").alias("p")).select(F.col("id").alias("project_id"), "p.*")
    return p.where((F.coalesce("status", F.lit("complete")) == "complete") & (F.col("frameCount") > 0))


def depth_pixels(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Raw rasters of little-endian 16-bit depths as rows (path, x, y, d); a file of another size fails (S7). 0 is no measurement."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    sized = files.withColumn("content", F.when(F.col("length") == 2 * width * height, F.col("content")).otherwise(F.raise_error(F.lit("raster size")).cast("binary")))
    pixels = sized.select("path", F.posexplode(F.expr(f"transform(sequence(0, {width * height - 1}), i -> hex(substring(content, 2 * i + 1, 2)))")).alias("i", "h"))
    depth = F.conv(F.concat(F.substring("h", 3, 2), F.substring("h", 1, 2)), 16, 10).cast("int")
    return pixels.select("path", (F.col("i") % width).cast("int").alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), depth.alias("d")).where("d > 0")


def obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and corners (tid, corner, vid) of an OBJ file; negative indices count from the last vertex so far."""
    from pyspark.sql import Window

    lines = spark.read.option("lineSep", "\n").text(path).withColumn("_at", F.monotonically_increasing_id()).withColumn("p", F.split(F.trim("value"), r"\s+"))
    order = Window.orderBy("_at")  # one file: its lines have one order
    v = lines.where("p[0] = 'v'").withColumn("vid", F.row_number().over(order))
    vertices = v.select("vid", *[F.try_element_at("p", F.lit(i + 2)).cast("double").alias(c) for i, c in enumerate("xyz")])
    faces = lines.withColumn("n", F.sum(F.when(F.col("p")[0] == "v", 1).otherwise(0)).over(order)).where("p[0] = 'f'").withColumn("tid", F.row_number().over(order))
    corner = faces.select("tid", "n", F.posexplode(F.slice("p", 2, 3)).alias("corner", "c")).withColumn("k", F.split("c", "/")[0].cast("int"))
    return vertices, corner.select("tid", "corner", F.when(F.col("k") < 0, F.col("n") + F.col("k") + 1).otherwise(F.col("k")).alias("vid"))


def ply_bytes(points: DataFrame, order: str) -> bytes:
    """A binary point cloud of 15-byte rows, for clouds that were capped for export (K2). The rows are collected: cap them first."""
    rows = points.orderBy(order).select("x", "y", "z", "r", "g", "b").collect()
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(rows)}\n" + "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"
    return head.encode() + b"".join(struct.pack("<fff3B", *r) for r in rows)


def indexed_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, frames): lines of an index that are not blank, without its header."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("v")).where("v <> ''")
    return lines.groupBy("path").agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("frames"))


def project_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, name, created) of the project documents under a path, newest first, ties by path; those that cannot be read, or of another schema, are left out."""
    p = spark.read.schema(PROJECT).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    p = p.select(F.col("_metadata.file_path").alias("path"), "schemaVersion", "id", "name", F.expr("try_to_timestamp(createdAt)").alias("created"))
    return p.where("schemaVersion = 3 AND id IS NOT NULL").drop("schemaVersion").orderBy(F.desc_nulls_last("created"), "path")


def live_workers(spark: SparkSession, path: str, seconds: int = 3) -> DataFrame:
    """(path, status): heartbeat documents written within the last seconds."""
    beat = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("status"), F.col("_metadata.file_modification_time").alias("at"))
    return beat.where(F.col("at") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(seconds)))).select("path", "status")


def safe_path(path: Column) -> Column:
    """Relative, without a drive, a leading separator or a step up; null is not safe."""
    return F.coalesce(~path.rlike(r"^$|^[/\\\\]|^[A-Za-z]:|(^|[/\\\\])\.\.([/\\\\]|$)"), F.lit(False))


def camera_poses(frames: DataFrame, order: str) -> DataFrame:
    """(order, json): one line a frame with its pose rounded to ten places and its lens to eight (K17). frames: order, name, pose (16 numbers), fx, fy, cx, cy."""
    lens = [F.round(c, 8).alias(c) for c in ("fx", "fy", "cx", "cy")]
    return frames.select(order, F.to_json(F.struct("name", F.transform("pose", lambda v: F.round(v, 10)).alias("cameraToWorld"), F.struct(*lens).alias("intrinsics"))).alias("json"))


def preview(points: DataFrame, order: list[str], keep: int) -> DataFrame:
    """(place, json) of at most `keep` evenly spaced points: x, y, z rounded half to even at five places, then colours (K3)."""
    from plumbline.operators.relational import evenly_spaced

    kept = evenly_spaced(points, order, keep)
    row = F.array(*[F.bround(c, 5) for c in "xyz"], *[F.col(c).cast("double") for c in "rgb"])
    return kept.select(*order, F.to_json(row).alias("json"))


def obj_lines(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(part, key, line) of an OBJ document, to be written in this order; vertices are numbered from 1 in order of vid.

    triangles (tid, a, b, c), vertices (vid, x, y, z). Vertices that no triangle uses are left out; triangles with unknown corners too.
    """
    from plumbline.operators.relational import _numbered

    used = triangles.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    v = _numbered(vertices.join(used, "vid", "left_semi"), ["vid"]).select("vid", "x", "y", "z", (F.col("_i") + 1).alias("n"))
    corner = triangles.select("tid", F.posexplode(F.array("a", "b", "c")).alias("k", "vid")).join(v.select("vid", "n"), "vid")
    faces = corner.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("c")).where("size(c) = 3")
    lines = v.select(F.lit(0).alias("part"), F.col("n").alias("key"), F.format_string("v %.17g %.17g %.17g", *[F.col(c).cast("double") for c in "xyz"]).alias("line"))
    return lines.unionByName(faces.select(F.lit(1).alias("part"), F.col("tid").alias("key"), F.concat_ws(" ", F.lit("f"), *[F.col("c")[i]["n"] for i in range(3)]).alias("line")))
