"""Joins, caps, set and ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_rejected(rows: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Left anti join; a key that is rejected once is gone, whatever else the journal says."""
    return rows.join(rejected.select(key).distinct(), key, "left_anti")


def interval_join(rows: DataFrame, windows: DataFrame, key: str, time: str, begin: str, end: str, bucket: float | None = None) -> DataFrame:
    """Rows within [begin, end] of the windows of their key, both ends included.

    With `bucket`, time is cut into buckets of that width and the join is on key and bucket: a
    hot key spreads over its buckets. A window meets every bucket that it touches.
    """
    if bucket is None:
        return rows.join(windows, key).where(F.col(time).between(F.col(begin), F.col(end)))
    r = rows.withColumn("_b", F.floor(F.col(time) / bucket).cast("long"))
    w = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col(begin) / bucket).cast("long"), F.floor(F.col(end) / bucket).cast("long"))))
    return r.join(w, [key, "_b"]).where(F.col(time).between(F.col(begin), F.col(end))).drop("_b")


def asof(rows: DataFrame, key: str, order: list[str], when: Column, value: Column, name: str, forward: bool = False) -> DataFrame:
    """For each row the value of the last (or next) row of its key for which `when` holds, itself included."""
    w = Window.partitionBy(key).orderBy(*order)
    picked = F.when(when, value)
    if forward:
        return rows.withColumn(name, F.first(picked, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return rows.withColumn(name, F.last(picked, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def evenly_spaced(rows: DataFrame, order: list[str], keep: int, group: str | None = None) -> DataFrame:
    """At most `keep` rows at places floor(i (n - 1) / (keep - 1)) of each group, in order.

    Without a group, places come from counts of ranges and not from one sorted partition: rows
    are dealt by ranges of the first order column, written, numbered within, and offset by the ranges before.
    """
    if group is None:
        return _numbered(rows, order).where(_at_even_place(F.col("_i"), F.col("_n"), keep)).drop("_i", "_n")
    w = Window.partitionBy(group)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    return numbered.where(_at_even_place(F.col("_i"), F.col("_n"), keep)).drop("_i", "_n")


def _at_even_place(i: Column, n: Column, keep: int) -> Column:
    if keep == 1:
        return i == 0
    j = F.ceil(i * (keep - 1) / F.greatest(n - 1, F.lit(1)))
    return (n <= keep) | (F.floor(j * (n - 1) / (keep - 1)) == i)


def _numbered(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """rows with _i, the place in the whole order, and _n, their number.

    The ranges are written once: dealt again for the numbers, they may be sampled or merged otherwise than for the counts.
    """
    from plumbline.operators.graph import _written

    dealt = _written(rows.repartitionByRange(order[0]).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy()))
    w = Window.partitionBy("_p").orderBy(*order)
    return dealt.withColumn("_k", F.row_number().over(w) - 1).join(F.broadcast(before.drop("_c")), "_p").withColumn("_i", F.col("_k") + F.col("_before")).drop("_p", "_k", "_before")


def best_per_key(rows: DataFrame, key: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key; the limit is applied before and after the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def sequence_gaps(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Per key the numbers that are missing between consecutive ones."""
    w = Window.partitionBy(key).orderBy(seq)
    return rows.withColumn("_g", F.greatest(F.col(seq) - F.lag(seq).over(w) - 1, F.lit(0))).groupBy(key).agg(F.coalesce(F.sum("_g"), F.lit(0)).cast("long").alias("dropped"), F.count("*").alias("n"))


def bucket_decimation(rows: DataFrame, i: str, target: int, source: int) -> DataFrame:
    """Keeps row i (from 1) where floor((i - 1) target / source) changes."""
    now, before = F.floor((F.col(i) - 1) * target / source), F.floor((F.col(i) - 2) * target / source)
    return rows.where((F.col(i) == 1) | (now != before))


def fragments(rows: DataFrame, key: str, order: list[str], size: int = 4, least: int = 2) -> DataFrame:
    """rows with `fragment`: runs of `size` rows of a key; a tail of fewer than `least` joins the run before."""
    w = Window.partitionBy(key)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    last = F.greatest(F.ceil(n / size) - 1 - F.when(F.pmod(n, F.lit(size)).between(1, least - 1), 1).otherwise(0), F.lit(0))
    return rows.withColumn("fragment", F.least(F.floor(i / size), last).cast("long"))


def in_row_order(rows: DataFrame) -> DataFrame:
    """rows of parquet files with `_file`, the place of its file among the files' names, and `_row`, its place in the file."""
    files = sorted(r[0] for r in rows.select("_metadata.file_path").distinct().collect())
    named = rows.sparkSession.createDataFrame(list(enumerate(files)), "_file long, _path string")
    placed = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    return placed.join(F.broadcast(named), "_path").drop("_path")


def running_sums(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """rows with `_sum_<value>` of the rows of their key up to them, added one by one in order, and `_last` in the last of them.

    Doubles that are added in parts round otherwise with every partitioning, which tips rows that lie on
    a limit. A key's rows are sorted, which spills, and never held as an array.
    """
    w = Window.partitionBy(key)
    sofar = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({f"_sum_{v}": F.sum(v).over(sofar) for v in values} | {"_last": F.lead(F.lit(False), 1, True).over(w.orderBy(*order))})
