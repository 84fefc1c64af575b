"""Comparing the members of buckets in blocks of bounded size.

Members of a bucket are dealt into blocks; a task compares one block with one block (or a block
with itself). A bucket that is hot thus spreads over many tasks, none of which holds more than
two blocks, and no pair becomes a row: a task returns how many links each member has and a
spanning forest of the links, which is all that counts and components need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt_by(rows: DataFrame, key: list[str], member: str) -> DataFrame:
    """Rows of a block pair together in one partition, in order."""
    by = [*key, "bi", "bj"]
    return rows.repartition(*by).sortWithinPartitions(*by, "side", member)


def in_blocks(members: DataFrame, key: list[str], member: str, deal: bool = True) -> DataFrame:
    """members with side (0 or 1), bi and bj: one row for each block pair that a member takes part in, and, with `deal`, dealt and sorted by it.

    members has `blocks`, the number of blocks of the row's bucket.
    """
    own = F.pmod(F.xxhash64(member, F.lit(7)), F.col("blocks")).cast("int")
    dealt = (
        members.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        .withColumn("bi", F.least("_own", "_other"))
        .withColumn("bj", F.greatest("_own", "_other"))
        .withColumn("side", F.when(F.col("_own") == F.col("bi"), 0).otherwise(1))
        .drop("_own", "_other", "blocks")
    )
    return dealt_by(dealt, key, member) if deal else dealt


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of rows of equal keys, from batches sorted by the key; holds one run and one batch at a time."""
    rest: list[pa.RecordBatch] = []
    rest_key = None
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, dtype=bool)
        for k in key:
            v = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        first = tuple(b.column(b.schema.get_field_index(k))[0].as_py() for k in key)
        if rest and first != rest_key:
            yield pa.Table.from_batches(rest)
            rest = []
        for i, j in zip(cuts[:-2], cuts[1:-1]):
            rest.append(b.slice(i, j - i))
            yield pa.Table.from_batches(rest)
            rest = []
        rest.append(b.slice(cuts[-2], cuts[-1] - cuts[-2]))
        rest_key = tuple(b.column(b.schema.get_field_index(k))[b.num_rows - 1].as_py() for k in key)
    if rest:
        yield pa.Table.from_batches(rest)


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between positions a and b: (position, root) of a spanning forest of stars; roots have the least id."""
    parent = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    low, high = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
    label = rank.copy()
    while True:
        before = label.copy()
        least = np.minimum(label[low], label[high])
        np.minimum.at(label, low, least)
        np.minimum.at(label, high, least)
        label = label[order[label]]
        if (label == before).all():
            break
    parent = order[label]
    moved = np.flatnonzero(parent != np.arange(len(ids)))
    return moved, parent[moved]


LINK_SCHEMA = pa.schema({"node": pa.int64(), "root": pa.int64(), "n": pa.int64()})


def link_rows(ids: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows (node, root, n): links counted for each member (times the other's weight), and its root in the forest."""
    w = np.ones(len(ids), np.int64) if weight is None else weight
    n = np.zeros(len(ids), dtype=np.int64)
    np.add.at(n, a, w[b])
    np.add.at(n, b, w[a])
    root = np.arange(len(ids))
    moved, to = forest(ids, a, b)
    root[moved] = to
    got = np.flatnonzero(n > 0)
    return pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(ids[root[got]]), pa.array(n[got])], schema=LINK_SCHEMA)


def compared(dealt: DataFrame, key: list[str], links: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows (node, root, n) of all block pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, [*key, "bi", "bj"]):
            if group.num_rows > 1:
                yield from links(group.combine_chunks())

    return dealt.mapInArrow(run, "node long, root long, n long")


def resolved(found: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """nodes with n_links and component_id; found: rows (node, root, n)."""
    from plumbline.llm.components import components

    own = components(found.select("node", "root"), "node", "root")
    counts = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    joined = counts.join(own, "node", "left").select(F.col("node").alias(node), "n_links", F.coalesce("component", "node").alias("component_id"))
    return nodes.join(joined, node, "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))).withColumn("component_id", F.coalesce("component_id", F.col(node)))
