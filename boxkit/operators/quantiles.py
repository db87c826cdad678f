"""Exact values by rank, for keys of any size, without sorting the values of a key.

A pass counts the values of each key in bins between the smallest and the largest one;
the bin that holds a wanted rank is looked into in the next pass, until it holds one
value only or few enough to sort. Each pass is an aggregate of counts per bin, so a key
with most of the rows costs as much as many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import stored

BINS, FEW = 1024, 10_000


def by_index(df: DataFrame, value: Column, shares: dict[str, float], keys: list[str], few: int = FEW, bins: int = BINS) -> DataFrame:
    """The values at floor(n * share) of each key's sorted values, one column per share; null values don't count."""
    rank = lambda n, s: F.least(F.floor(n * s), n - 1)
    return at_ranks(df, value, {k: (lambda n, s=s: rank(n, s)) for k, s in shares.items()}, keys, few, bins)


def at_ranks(df: DataFrame, value: Column, ranks: dict, keys: list[str], few: int = FEW, bins: int = BINS) -> DataFrame:
    """The values at ranks (from 0, functions of the key's number of values) of each key."""
    d = df.select(*keys, value.cast("double").alias("v")).where("v IS NOT NULL")
    ends = [F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    first = stored(d.groupBy(*keys).agg(*ends) if keys else d.agg(*ends).where("n > 0"), "extents")
    names = F.array(*(F.struct(F.lit(k).alias("pick"), f(F.col("n")).cast("long").alias("r")) for k, f in ranks.items()))
    want = first.select(*keys, "n", "lo", "hi", F.inline(names))
    if (first.agg(F.max("n")).first()[0] or 0) <= few:
        lists = d.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("s"))  # few values of a key
        return lists.select(*keys, *(F.get("s", f(F.size("s").cast("long")).cast("int")).alias(k) for k, f in ranks.items()))
    done = None
    while True:
        known = want.where("lo = hi").select(*keys, "pick", F.col("lo").alias("v"))
        small = want.where((F.col("lo") < F.col("hi")) & (F.col("n") <= few))
        held = _within(d, small, keys).groupBy(*keys, "pick").agg(F.sort_array(F.collect_list("v")).alias("s"), F.first("r").alias("r"))
        got = known.unionByName(held.select(*keys, "pick", F.get("s", F.col("r").cast("int")).alias("v")))
        done = got if done is None else done.unionByName(got)
        left = stored(want.where((F.col("lo") < F.col("hi")) & (F.col("n") > few)), "ranges")
        if left.isEmpty():
            break
        bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        h = _within(d, left, keys).withColumn("bin", bin_).groupBy(*keys, "pick", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("r").alias("r"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "pick").orderBy("bin"))  # one row per bin
        h = h.withColumn("upto", upto).where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n")))
        want = stored(h.select(*keys, "n", "lo", "hi", "pick", (F.col("r") - F.col("upto") + F.col("n")).alias("r")), "ranges")
    return done.groupBy(*keys).pivot("pick", list(ranks)).agg(F.first("v")) if keys else done.groupBy().pivot("pick", list(ranks)).agg(F.first("v"))


def _within(d: DataFrame, want: DataFrame, keys: list[str]) -> DataFrame:
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    return (d.join(want.drop("n"), keys) if keys else d.join(want.drop("n"))).where(inside)
