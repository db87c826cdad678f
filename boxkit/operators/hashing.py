"""Nearest binary codes by multi-index hashing, over a table of sub-codes that can be stored and added to.

A code is cut into m parts of about log2(number of codes) bits. Codes that differ
in at most m * (s + 1) - 1 bits have one part that differs in at most s, so all of
them are met by looking up the parts of a query with up to s bits turned. Rounds
turn one bit more for those queries only that haven't got their n nearest codes
within the radius that is covered; what is found is exact. Where a round would look
up more parts than there are codes, or where comparing all pairs is less work than the
jobs of a round, the queries left are compared with all codes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import stored

BITS, LEAST_PART, MOST_PART = 64, 6, 20
#: Pairs that are compared in about the time that Spark needs for the jobs of a round.
FEW_PAIRS = 50_000_000
#: Queries (a number and an id each) that are sent to all tasks at once.
MOST_SENT = 100_000


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def parts(bits: int, n: int) -> list[tuple[int, int]]:
    """(first bit, width) of the parts of a code for an index of n codes."""
    width = min(bits, max(LEAST_PART, min(MOST_PART, round(math.log2(max(2, n))))))
    m = -(-bits // width)
    return [(i * bits // m, (i + 1) * bits // m - i * bits // m) for i in range(m)]


def _part(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1))


def sub_codes(codes: DataFrame, cut: list[tuple[int, int]]) -> DataFrame:
    """part, sub and code of every distinct code."""
    pieces = F.array(*(F.struct(F.lit(i).alias("part"), _part(F.col("code"), *p).alias("sub")) for i, p in enumerate(cut)))
    return codes.select("code").distinct().select(F.inline(pieces), "code")


def _masks(spark: SparkSession, width: int, turned: int) -> DataFrame:
    """All masks of so many bits of a width, made from those of one bit less."""
    d = spark.range(1).select(F.lit(0).cast("long").alias("mask"), F.lit(-1).alias("top"))
    for _ in range(turned):
        d = d.select("mask", F.explode(F.expr(f"CASE WHEN top + 1 < {width} THEN sequence(top + 1, {width - 1}) ELSE array() END")).alias("bit"))
        d = d.select(F.col("mask").bitwiseOR(F.expr("shiftleft(1L, bit)")).alias("mask"), F.col("bit").alias("top"))
    return d.select("mask")


def _closest(pairs: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "code")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def nearest_codes(index: DataFrame, cut: list[tuple[int, int]], queries: DataFrame, n: int, counted: list | None = None, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """query_id, code, distance and rank of the n nearest distinct codes of each query (query_id, qcode), ties by code.

    index: part, sub and code, as sub_codes() gives them. counted, if given, gets the number of pairs that each round compared.
    """
    spark = queries.sparkSession
    codes = index.where("part = 0").select("code")
    total, open_, out, seen = codes.count(), stored(queries.select("query_id", "qcode"), "queries"), [], None
    for turned in range(max(w for _, w in cut) + 1):
        looks = sum(math.comb(w, turned) for _, w in cut)
        if looks > total or total * open_.count() <= few_pairs:
            pairs = codes.join(F.broadcast(open_) if open_.count() <= MOST_SENT else open_).select("query_id", "code", distance(F.col("code"), F.col("qcode")).alias("distance"))
            if counted is not None:
                counted.append(total * open_.count())
            out.append(_closest(pairs, n))
            break
        probes = []
        for width in sorted({w for _, w in cut}):
            mine = F.array(*(F.struct(F.lit(i).alias("part"), _part(F.col("qcode"), *p).alias("own")) for i, p in enumerate(cut) if p[1] == width))
            masks = F.broadcast(_masks(spark, width, turned))  # no more than there are codes
            probes.append(open_.select("query_id", "qcode", F.inline(mine)).join(masks).select("query_id", "qcode", "part", F.col("own").bitwiseXOR(F.col("mask")).alias("sub")))
        probes = probes[0] if len(probes) == 1 else probes[0].unionByName(probes[1])
        met = probes.join(index, ["part", "sub"]).select("query_id", "code", distance(F.col("code"), F.col("qcode")).alias("distance")).distinct()
        seen = stored(met if seen is None else met.unionByName(seen).distinct(), "met")
        if counted is not None:
            counted.append(seen.count())
        best = _closest(seen, n)
        reach = len(cut) * (turned + 1) - 1
        done = seen.where(F.col("distance") <= reach).groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(n, total)).select("query_id")
        done = stored(done, "done")
        out.append(best.join(done, "query_id", "left_semi"))
        open_ = stored(open_.join(done, "query_id", "left_anti"), "queries")
        if open_.isEmpty():
            break
        seen = stored(seen.join(done, "query_id", "left_anti"), "met")
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result.select("query_id", "code", "distance", "rank")


def write_index(codes: DataFrame, path: str, bits: int = BITS) -> None:
    """Stores an index of (uid, code): the codes by uid, the sub-codes of distinct codes, and how codes are cut."""
    spark = codes.sparkSession
    codes.select("uid", "code").write.mode("overwrite").parquet(f"{path}/codes")
    cut = parts(bits, codes.select("code").distinct().count())
    spark.createDataFrame(cut, "first int, width int").coalesce(1).write.mode("overwrite").parquet(f"{path}/cut")
    _write_subs(sub_codes(codes, cut), f"{path}/subs", "overwrite")


def _write_subs(subs: DataFrame, path: str, mode: str) -> None:
    subs.sort("part", "sub").write.mode(mode).parquet(path)


def _cut(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    return sorted((r["first"], r["width"]) for r in spark.read.parquet(f"{path}/cut").collect())  # one row per part


def add_to_index(codes: DataFrame, path: str) -> None:
    """Adds the uids that a stored index lacks; what is there stays as it is. A run that is repeated adds nothing twice."""
    spark = codes.sparkSession
    old = spark.read.parquet(f"{path}/codes")
    new = stored(codes.select("uid", "code").dropDuplicates(["uid"]).join(old.select("uid"), "uid", "left_anti"), "new-codes")
    known = spark.read.parquet(f"{path}/subs").where("part = 0").select("code")
    fresh = new.select("code").distinct().join(known, "code", "left_anti")
    _write_subs(sub_codes(fresh, _cut(spark, path)), f"{path}/subs", "append")  # first: a code without a uid does no harm
    new.write.mode("append").parquet(f"{path}/codes")


def search_index(spark: SparkSession, path: str, queries: DataFrame, n: int, counted: list | None = None, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """query_id, uid, code, distance and rank of all uids of the n nearest codes of a stored index."""
    subs = spark.read.parquet(f"{path}/subs")
    return nearest_codes(subs, _cut(spark, path), queries, n, counted, few_pairs).join(spark.read.parquet(f"{path}/codes"), "code").select("query_id", "uid", "code", "distance", "rank")
