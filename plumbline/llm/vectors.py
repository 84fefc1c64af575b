"""Operator 2: near duplicates among embeddings by spherical k-means cells.

Centroids are fitted on a bounded sample. Every vector is at home in its nearest cell and visits
the cells whose centroid is nearly as close (within `margin` of the best cosine); a link is found
if one of its ends visits the home of the other. Homes are compared with themselves and with
visitors in blocks of bounded size, as matrix products in double precision; a pair that meets in
two homes counts in the first of them. One vector of each group is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import compared, dealt_by, in_blocks, link_rows, resolved
from plumbline.llm.store import cut


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit vectors x; empty cells keep their last centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 1024] @ c.T).argmax(1) for i in range(0, len(x), 1024)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision; scaled by their largest component first, so that no square overflows or vanishes."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, margin: float, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    c = centroids.astype(np.float32)
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            b = whole.slice(at, 1024)
            x = _units(b.column(1), c.shape[1]).astype(np.float32)
            s = x @ c.T
            home = s.argmax(1)
            near = s >= s.max(1, keepdims=True) - margin
            _, cells = np.nonzero(near)
            offsets = np.concatenate([[0], np.cumsum(near.sum(1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(out[1].type), b.column(2), pa.array(home.astype(np.int32)), lists.cast(out[4].type)], schema=out)


def _cell_links(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of a block of a home with itself, with another of its blocks (kind 0) or with visitors (kind 1, side 1)."""
    ids, home, side = (group.column(c).to_numpy() for c in ("node", "home", "side"))
    cell, visitors = group.column("cell")[0].as_py(), group.column("kind")[0].as_py() == 1
    x = _units(group.column("vec").chunk(0), len(group.column("vec")[0]))
    within = not visitors and group.column("bi")[0].as_py() == group.column("bj")[0].as_py()
    left = np.flatnonzero(side == 0)
    right = left if within else np.flatnonzero(side == 1)
    lists = group.column("cells").chunk(0)
    number = np.asarray(lists.value_lengths())
    visits = np.full((len(ids), int(number.max())), -1, dtype=np.int32)
    visits[np.arange(visits.shape[1])[None, :] < number[:, None]] = lists.flatten().to_numpy()
    firsts: list[np.ndarray] = []
    seconds: list[np.ndarray] = []
    for i in range(0, len(left), 512):
        rows = left[i : i + 512]
        p, q = np.nonzero(x[rows] @ x[right].T >= threshold)
        a, b = rows[p], right[q]
        if within:
            a, b = a[a < b], b[a < b]
        if visitors and len(a):  # a is at home here; if it visits b's home too, the pair counts in the first of the two
            keep = (home[b] > cell) | ~(visits[a] == home[b][:, None]).any(1)
            a, b = a[keep], b[keep]
        firsts.append(a)
        seconds.append(b)
    if firsts:
        yield link_rows(ids, np.concatenate(firsts), np.concatenate(seconds), group.column("copies").to_numpy())


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.9,
    margin: float = 0.15,
    cell_rows: int = 256,
    max_cells: int = 4096,
    sample: int = 16_384,
    block: int = 1024,
    visitors: int = 4096,
) -> DataFrame:
    """One row per row of vectors: key, n_links, component_id, kept.

    n_links: other vectors linked directly (cosine >= threshold); component_id: the smallest key
    reachable by links; kept: it is that one. Null and zero vectors and those with null or
    non-finite components link with nothing; vectors link with those of their own length, each
    length in a pass of its own. Equal vectors become one with a weight first. Rows may repeat a
    key, each counts; a row without a key links like others, but its key is nobody's component (null
    where no other is reachable, and then it is kept). Centroids (at most max_cells) come from at most
    `sample` vectors; all are compared. Links are found if an end visits the other's home (see README).
    """
    x = F.col("vec")
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vec")).withColumn("vec", F.when(sound, x))
    rows = cut(rows.withColumn("one", F.xxhash64("vec")).withColumn("two", F.xxhash64("vec", F.lit(1))))
    unique = rows.where("vec IS NOT NULL").groupBy("one", "two").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    unique = cut(cut(unique).withColumn("node", F.monotonically_increasing_id()))  # numbered from a written table
    found = None
    for w in unique.groupBy(F.size("vec").alias("w")).agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).where("rows > 1").orderBy(F.desc("n"), "w").toLocalIterator():
        links = _linked(unique.where(F.size("vec") == w["w"]).select("node", "vec", "copies"), w["w"], w["rows"], threshold, margin, cell_rows, max_cells, sample, block, visitors)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "node long, root long, n long")
    linked = resolved(found, unique.select("node", "one", "two", "least", "copies"), "node")
    named = linked.groupBy("component_id").agg(F.min("least").alias("smallest"))
    linked = linked.join(named, "component_id").select("one", "two", (F.col("n_links") + F.col("copies") - 1).alias("n_links"), "smallest", F.lit(True).alias("there"))
    every = rows.select("vec_id", F.col("vec").isNotNull().alias("sound"), "one", "two").join(linked, ["one", "two"], "left")
    own = F.when(F.col("sound"), F.col("smallest")).otherwise(F.col("vec_id"))
    return every.select(F.col("vec_id").alias(key), F.when(F.col("sound"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))


def _linked(usable: DataFrame, width: int, rows: int, threshold: float, margin: float, cell_rows: int, max_cells: int, sample: int, block: int, visitors: int) -> DataFrame:
    """Rows (node, root, n) of the links among different vectors (node, vec, copies) of one length."""
    drawn = usable.orderBy(F.xxhash64("vec"), "node").limit(sample).select("vec").toArrow()
    fit = _units(drawn.column("vec").combine_chunks(), width)
    k = max(1, min(max_cells, len(fit), rows // cell_rows))
    spark = usable.sparkSession
    shared = spark.sparkContext.broadcast(spherical_kmeans(fit, k))  # at most max_cells vectors
    element = usable.schema["vec"].dataType.elementType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema({"node": pa.int64(), "vec": pa.list_(to_arrow_type(usable.schema["vec"].dataType.elementType)), "copies": pa.int64(), "home": pa.int32(), "cells": pa.list_(pa.int32())})

    def assign(batches):
        return _assign(batches, shared.value, margin, out)

    assigned = cut(usable.mapInArrow(assign, f"node long, vec array<{element}>, copies long, home int, cells array<int>"))
    calls = assigned.withColumn("cell", F.explode("cells"))
    sizes = calls.groupBy("cell").agg(F.count_if(F.col("cell") == F.col("home")).alias("h"), F.count_if(F.col("cell") != F.col("home")).alias("v"))
    sizes = sizes.where("h > 0").select("cell", F.ceil(F.col("h") / block).cast("int").alias("blocks"), F.ceil(F.col("v") / visitors).cast("int").alias("v_blocks"))
    placed = calls.join(F.broadcast(sizes), "cell")  # sizes: at most max_cells rows
    at_home, visiting = placed.where("cell = home"), placed.where("cell <> home")
    same = in_blocks(at_home.withColumn("kind", F.lit(0)).drop("v_blocks"), ["cell", "kind"], "node", deal=False)
    own, own_v = (F.pmod(F.xxhash64("node", F.lit(7)), F.col(c)).cast("int") for c in ("blocks", "v_blocks"))
    every, every_v = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("blocks", "v_blocks"))
    residents = at_home.where("v_blocks > 0").withColumn("bi", own).withColumn("bj", every_v).withColumn("side", F.lit(0))
    guests = visiting.withColumn("bj", own_v).withColumn("bi", every).withColumn("side", F.lit(1))
    other = residents.unionByName(guests).withColumn("kind", F.lit(1)).drop("blocks", "v_blocks")
    dealt = dealt_by(same.unionByName(other), ["cell", "kind"], "node")

    def links(group):
        return _cell_links(group, threshold)

    return cut(compared(dealt, ["cell", "kind"], links))
