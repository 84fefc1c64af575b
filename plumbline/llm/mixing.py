"""Operator 1: mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a target in words. What is a whole multiple of the source is allocated as
certain whole copies of all its documents; the rest is a Pareto order sample: documents are ranked
by the odds of a uniform number over their inclusion odds and taken in this order until the rest
of the target is met as nearly as whole documents allow. The uniform number is a digest of the id,
so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.store import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Classes into which ranks are cut: only the class that holds a source's last document is sorted.
CLASSES = 4096


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], epochs: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, weigh `weights`, repeating, and share epochs times all
    sizes; a target stops at `most` times its source's size and the excess is shared by weight among
    the others, until none is above. The level at which that ends is found in one pass over the
    sources in the order in which they reach their limit.
    """
    everything = Window.partitionBy(F.lit(1))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    to_limit = Window.partitionBy(F.lit(1)).orderBy("reach", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", weight.cast("double")).withColumn("limit", F.lit(float(most)) * F.col("source_size")).withColumn("reach", F.col("limit") / F.col("w"))
    shared = ranked.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("limits_before", F.sum("limit").over(to_limit.rowsBetween(Window.unboundedPreceding, 0)) - F.col("limit"))
    shared = shared.withColumn("w_left", F.sum("w").over(everything) - F.sum("w").over(to_limit.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w"))
    level = shared.withColumn("level", (F.lit(float(epochs)) * F.col("all_size") - F.col("limits_before")) / F.col("w_left"))
    own = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", F.row_number().over(to_limit).alias("at"), "level"))).over(everything)["level"]
    target = F.when(own.isNull(), F.col("limit")).otherwise(F.least(own * F.col("w"), F.col("limit")))
    return level.select("source", "source_size", target.alias("target"))


def _small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df for a broadcast if it is counted to be small; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def _ranked(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """slim with its source's columns, `order` (odds of the uniform number over inclusion odds; null without such odds) and its class."""
    number = (F.conv(F.substring(F.md5("draw"), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    odds = (F.col("size") / (F.col("size") + F.lit(50.0))) * (F.col("rate") / (F.lit(1.0) - F.col("rate")))
    joined = slim.join(targets, slim["source"].eqNullSafe(targets["_source"])).drop("_source")
    ranked = joined.withColumn("_u", number).withColumn("_odds", odds)
    ranked = ranked.withColumn("order", F.when(F.col("_odds") > 0, (F.col("_u") / (F.lit(1.0) - F.col("_u"))) / F.col("_odds")))
    return ranked.withColumn("class", F.floor(F.lit(float(CLASSES)) * (F.col("order") / (F.lit(1.0) + F.col("order")))).cast("int")).drop("_u", "_odds")


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with `_n`, from 1, among the rows of a key. A key's rows are numbered by the partition they came in, so that a hot key stays spread."""
    held = cut(rows.withColumn("_part", F.spark_partition_id()))
    counts = held.groupBy(*key, "_part").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_before", F.sum("_count").over(before) - F.col("_count")).drop("_count")
    own = Window.partitionBy(*key, "_part").orderBy(F.lit(0))
    return held.join(counts, [*key, "_part"]).withColumn("_n", F.col("_before") + F.row_number().over(own)).drop("_part", "_before")


def allotted(slim: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """slim (source, size, draw, mark, and any others) with source_size, target, copies and taken.

    draw: a string from which the uniform number comes; mark: a number that parts rows of one draw.
    Inclusion odds within a source grow with size / (size + 50): a short document is a little less
    likely to be repeated than a long one. The sample of a source ends with the last document in
    order that fits in the rest of its target, and one closing document: the one of those behind
    whose size is nearest to the gap, if taking it brings the source nearer. Of rows alike in all
    of this as many are taken as fit, whichever. All statistics come from a slim table; the rows
    of slim themselves are not shuffled while the sources are few enough to be broadcast.
    """
    slim = slim.withColumn("draw", F.concat(F.lit(seed + ":"), F.coalesce("draw", F.lit(""))))
    sizes = cut(slim.select("source", "size", "draw", "mark"))
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = source_targets(per_source, weights, epochs, most)
    some = F.col("source_size") > 0
    targets = targets.withColumn("whole", F.when(some, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0).cast("int"))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = cut(targets.withColumn("rate", F.when(some, F.col("rest") / F.col("source_size")).otherwise(0.0)).withColumnRenamed("source", "_source"))
    ranked = _ranked(sizes, _small(targets)).where("class IS NOT NULL")

    per_class = ranked.groupBy("source", "class", "rest").agg(F.sum("size").alias("class_size"))
    running = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    last = per_class.withColumn("up_to", F.sum("class_size").over(running)).where("up_to >= rest").groupBy("source", "rest").agg(F.min(F.struct("class", (F.col("up_to") - F.col("class_size")).alias("before"))).alias("m"))
    last = cut(last.select(F.col("source").alias("_of"), F.col("m.class").alias("last_class"), F.col("m.before").alias("before")))
    at_edge = ranked.join(_small(last), F.col("source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("at", F.struct("order", "draw", "size", "mark"))
    in_order = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    edge = at_edge.where("class = last_class").withColumn("up_to", F.col("before") + F.sum("size").over(in_order))
    edge = edge.groupBy("source", "at").agg(F.count("*").alias("there"), F.count_if(F.col("up_to") <= F.col("rest")).alias("fit"), F.max(F.when(F.col("up_to") <= F.col("rest"), F.col("up_to"))).alias("reached")).where("fit > 0")
    edge = cut(edge.groupBy(F.col("source").alias("_of")).agg(F.max(F.struct("at", "there", "fit", "reached")).alias("e")).select("_of", F.col("e.at").alias("last_at"), "e.there", "e.fit", "e.reached"))
    behind = at_edge.join(_small(edge), F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of").withColumn("gap", F.col("rest") - F.coalesce("reached", "before"))
    behind = behind.where("class > last_class OR (class = last_class AND (last_at IS NULL OR at > last_at OR (at = last_at AND there > fit)))").withColumn("off", F.abs(F.col("size") - F.col("gap"))).where("off < gap")
    closing = behind.groupBy("source").agg(F.min(F.struct("off", "at"))["at"].alias("closing_at")).withColumnRenamed("source", "_of2")

    whole = targets.join(last, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of").join(edge.drop("reached", "there"), F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")
    whole = cut(whole.join(closing, F.col("_source").eqNullSafe(F.col("_of2")), "left").drop("_of2"))
    mixed = _ranked(slim, _small(whole)).withColumn("at", F.struct("order", "draw", "size", "mark"))
    # Of the rows at the last and the closing place so many are taken; more than those are there only where rows are alike.
    few = F.when(F.col("at") == F.col("last_at"), F.col("fit")).otherwise(0) + F.when(F.col("at") == F.col("closing_at"), 1).otherwise(0)
    at_end = "coalesce(at = last_at, false) OR coalesce(at = closing_at, false)"
    ends = _ranked(sizes, _small(whole)).withColumn("at", F.struct("order", "draw", "size", "mark")).where(at_end).groupBy("source", "at").agg(F.count("*").alias("there"), F.max(few).alias("few"))
    taken = F.coalesce(F.expr("class IS NOT NULL AND (class < last_class OR (class = last_class AND at <= last_at) OR at = closing_at)"), F.lit(False))
    if ends.where("there > few").isEmpty():
        mixed = mixed.withColumn("copies", F.col("whole") + taken.cast("int"))
    else:
        alike = _numbered(mixed.where(at_end).withColumn("_of", F.coalesce("source", F.lit(""))), ["_of", "at"]).drop("_of")
        alike = alike.withColumn("copies", F.col("whole") + (F.col("_n") <= few).cast("int")).drop("_n")
        mixed = mixed.where(f"NOT ({at_end})").withColumn("copies", F.col("whole") + taken.cast("int")).unionByName(alike)
    return mixed.withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).drop("draw", "mark", "whole", "rest", "rate", "order", "class", "at", "last_class", "before", "last_at", "fit", "closing_at")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per row of docs: key, size, source_size, target, copies, taken.

    size: words of the whole text (null: 0); taken: words that the mix takes, copies counted. A
    null source is a source of its own, the last. Documents without words have no inclusion odds
    and are only in whole copies. Rows that repeat an id have the same uniform number and stay
    rows of their own; of rows alike in id and text as many are taken as fit the target. Other columns are not read.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("source"), words_in(text).alias("size"), F.col(key).cast("string").alias("draw"), F.xxhash64(F.col(text)).alias("mark"))
    return allotted(slim, **options).select(F.col("_key").alias(key), "size", "source_size", "target", "copies", "taken")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it; the columns of docs, whatever their names."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source).cast("string").alias("source"), words_in(text).alias("size"), F.col(key).cast("string").alias("draw"), F.xxhash64(F.col(text)).alias("mark"))
    copies = allotted(whole, **options).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select("_row.*")
