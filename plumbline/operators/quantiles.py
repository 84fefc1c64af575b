"""Exact quantiles of a column, whatever its size: histograms close in on the ranks, and only the last bin is sorted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one task may sort; bins of a histogram.
SORTED, BINS = 1_000_000, 4096


def _at_ranks(values: DataFrame, ranks: list[int], low: float, high: float, before: int) -> dict[int, float]:
    """The values at these ranks (from 0, counted from `before` at `low`), all between low and high."""
    if low == high:
        return dict.fromkeys(ranks, low)
    here = values.where(F.col("v").between(low, high))
    width = (high - low) / BINS
    bins = here.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).cast("int").alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z"))
    found, up_to = {}, before
    for r in sorted(bins.collect(), key=lambda r: r["b"]):  # at most BINS rows
        mine = [k for k in ranks if up_to <= k < up_to + r["n"]]
        if mine and r["n"] <= SORTED:
            own = sorted(x["v"] for x in here.where(F.col("v").between(r["a"], r["z"])).select("v").collect()) if r["n"] <= BINS else None
            if own is None:
                small = here.where(F.col("v").between(r["a"], r["z"])).agg(F.array_sort(F.collect_list("v")).alias("s")).select(*[F.col("s")[k - up_to].alias(f"k{k}") for k in mine]).first()
                found |= {k: small[f"k{k}"] for k in mine}
            else:
                found |= {k: own[k - up_to] for k in mine}
        elif mine:
            found |= _at_ranks(here, mine, r["a"], r["z"], up_to)
        up_to += r["n"]
    return found


def quantiles(rows: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """The quantiles, linear between ranks; None for no values. Nulls and NaN do not count. The same at every size: up to SORTED rows in one aggregate."""
    values = rows.select(value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    s = values.agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).first()
    if not s["n"]:
        return [None] * len(shares)
    if s["n"] <= SORTED:
        return list(values.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).first()["q"])
    at = [q * (s["n"] - 1) for q in shares]
    got = _at_ranks(values, sorted({int(f(x)) for x in at for f in (math.floor, math.ceil)}), s["a"], s["z"], 0)
    return [got[math.floor(x)] + (got[math.ceil(x)] - got[math.floor(x)]) * (x - math.floor(x)) for x in at]
