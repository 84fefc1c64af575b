"""Graph operators over edge tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, set for checkpoints too. Where that is unset: on one machine a temporary one, on a cluster an error."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if context.getCheckpointDir() is None:
        if not shared and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="plumbline-"))
    return shared or context.getCheckpointDir()


_SCRATCH: list[tuple[SparkSession, str]] = []


def _cleared() -> None:
    """Deletes what scratch() named, while the session still runs."""
    for spark, path in _SCRATCH:
        with contextlib.suppress(Exception):  # the session may be gone
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _SCRATCH.clear()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one for what a result is read from; it goes when the program ends."""
    if not _SCRATCH:
        atexit.register(_cleared)
    _SCRATCH.append((spark, f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"))
    return _SCRATCH[-1][1]


def _written(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 100) -> DataFrame:
    """(node, component): the least node each node reaches.

    Every round each node takes the least label of its neighbours and then the label of its label,
    so that labels travel twice as far each time; a round is written to the shared folder.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = _written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    now = _written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    for _ in range(rounds):
        near = both.join(now.select(F.col("u").alias("v"), F.col("m").alias("n")), "v").groupBy("u").agg(F.min("n").alias("n"))
        least = now.join(near, "u").select("u", F.least("m", "n").alias("m"), F.col("m").alias("was"))
        jump = least.select(F.col("u").alias("m"), F.col("m").alias("j"))
        new = _written(least.join(jump, "m").select("u", F.least("m", "j").alias("m"), "was"))
        now = new.select("u", "m")
        if new.where("m <> was").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("m").alias("component"))
    raise RuntimeError("components did not settle")


def diffuse(values: DataFrame, edges: DataFrame, rounds: int = 16) -> DataFrame:
    """(node, value): nodes without a value take the mean of their neighbours that have one, round by round.

    values (node, value), one row a node; edges (u, v) in both directions. A round sees only the values of the rounds before. Values
    that are given stay; nodes out of reach stay null. It ends early when a round fills nothing.
    """
    now = _written(values.select("node", F.col("value").cast("double").alias("value")))
    links = _written(edges.select("u", "v").where("u <> v").distinct())
    for _ in range(rounds):
        gaps = now.where("value IS NULL").select(F.col("node").alias("u"))
        near = links.join(gaps, "u").join(now.where("value IS NOT NULL").select(F.col("node").alias("v"), "value"), "v")
        filled = _written(near.groupBy(F.col("u").alias("node")).agg(F.avg("value").alias("mean")))
        if filled.isEmpty():
            break
        now = _written(now.join(filled, "node", "left").select("node", F.coalesce("value", "mean").alias("value")))
    return now


def _gains_in_place(sums: DataFrame, tolerance: float = 1e-10, rounds: int = 1000) -> DataFrame:
    """(frame, gain) by conjugate gradients over the normal equations (i, j, w, d): a round is a join and three sums, its vectors are written to the shared folder.

    The residuals have no part along the constants of a group of frames that overlap, so every group's mean stays 0.
    """
    x = _written(sums.groupBy("i").agg(F.sum("w").alias("w"), F.sum("d").alias("r")).select("i", "w", F.lit(0.0).alias("x"), "r", F.col("r").alias("p")))
    rr = first = x.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(rounds):
        if rr <= tolerance * tolerance * first or not rr:
            break
        across = sums.join(x.select(F.col("i").alias("j"), F.col("p").alias("q")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("q")).alias("s"))
        y = _written(x.join(across, "i").withColumn("ap", F.col("w") * F.col("p") - F.col("s")).drop("s"))
        step = rr / y.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        y = y.withColumn("x", F.col("x") + step * F.col("p")).withColumn("r", F.col("r") - step * F.col("ap"))
        now = y.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        x, rr = _written(y.withColumn("p", F.col("r") + now / rr * F.col("p")).drop("ap")), now
    return x.select(F.col("i").alias("frame"), F.col("x").alias("gain"))


def gain_fit(overlaps: DataFrame, most: int = 4096) -> DataFrame:
    """(frame, gain): gains with gain[i] - gain[j] nearest to `offset` over all rows (i, j, offset, weight), by weight.

    Each group of frames that overlap has a mean gain of 0 (the solution of least norm). Rows with a null or i = j do not count. Spark adds
    up the normal equations; those of up to `most` frames (128 MB) are solved dense on the driver, larger ones by rounds in place.
    """
    import numpy as np

    rows = overlaps.where("i <> j AND offset IS NOT NULL AND weight > 0")
    swapped = rows.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("offset")).alias("offset"), "weight")
    sums = _written(rows.select("i", "j", "offset", "weight").unionByName(swapped).groupBy("i", "j").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("offset")).alias("d")))
    frames = [r[0] for r in sums.select("i").distinct().orderBy("i").limit(most + 1).collect()]
    if len(frames) > most:
        return _gains_in_place(sums)
    at = {f: k for k, f in enumerate(frames)}
    normal, right = np.zeros((len(at), len(at))), np.zeros(len(at))
    for r in sums.toLocalIterator():
        normal[at[r["i"]], at[r["i"]]] += r["w"]
        normal[at[r["i"]], at[r["j"]]] -= r["w"]
        right[at[r["i"]]] += r["d"]
    gains = np.linalg.lstsq(normal, right, rcond=None)[0] if len(at) else []
    kind = rows.schema["i"].dataType.simpleString()
    return overlaps.sparkSession.createDataFrame([(f, float(g)) for f, g in zip(frames, gains)], f"frame {kind}, gain double")
