"""Connected components over links of any number, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import cut

MAX_ROUNDS = 60


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """small: every node's neighbours up to itself move to the least of them; else every larger neighbour does.

    links: (a, b) with a > b. The least neighbour is aggregated in part before the shuffle and
    written, so that both sides of the join that brings it back are plain shuffles, which adaptive
    execution splits where a node is hot.
    """
    if small:
        least = cut(links.groupBy("a").agg(F.min("b").alias("m")))
        joined = links.join(least, "a")
        return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. Loops and repeated links change nothing.

    Every round writes its links to the shared folder, so that no task depends on earlier rounds.
    Ends when a round changes no link; the number of rounds grows with the logarithm of a chain's length.
    """
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = cut(now)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        now = cut(_stars(_stars(now, False), True))
        now_seen = mark(now)
        if now_seen == seen:
            break
        seen = now_seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
