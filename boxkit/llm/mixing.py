"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of the mix are cut into equal blocks. Each source has, in each of the
hashed shards, a cell of documents; the blocks go to the cells with the highest
quotients weight / (2 k + 1), so that every cell has an integer quota of blocks.
A source so small that half a block in each of its cells is over ``COARSE`` of
its target has its target shared among its cells by words instead, within one
word of each cell's share. Within a cell documents are taken in the order of a
seeded hash until its quota is full, whole passes first. Everything is DataFrame
functions.

No task holds a source: running totals are taken within hashed buckets of a
cell, and the totals of buckets before it are added from a table of buckets.

Defined cases: null texts have 0 words and are taken 0; a null source is one
source, ordered last; null doc_ids are hashed as the empty text, and the text is
hashed with the id, so that many rows of one id or of none spread over buckets;
equal rows are shared out alike on every run; no documents or no words give no blocks and 0
taken; columns named like inner ones don't clash, as only the needed ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

WEIGHTS, SHARE, MOST, BLOCKS, SHARDS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 16384, 8, "mix"
COARSE = 0.02


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> with target: shares by weight, stopped at ``most`` times the size.

    Resharing the excess until none is above fills all sources to a common level of
    weight; the sources that stop are the first ones by size / weight. The table has
    one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = sizes.withColumn("nth", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum(F.col("source_size")).over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    table = table.withColumn("level", level)
    # the first source, in that order, that isn't full at the level left for it and those after it
    table = table.withColumn("level", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "nth", "level"))).over(every).getField("level"))
    return table.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def quotas(cells: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """source, shard, cell_size, source_size, target -> with take, the words that the cell's blocks hold.

    Seats are listed up to twice a cell's share and ranked by quotient; the highest ``blocks`` win.
    """
    total = F.sum(F.col("target") * F.col("cell_size") / F.col("source_size"))
    whole = cells.where("source_size > 0").agg(total.alias("total"))
    cells = cells.crossJoin(F.broadcast(whole))  # one row
    cells = cells.withColumn("cell_weight", F.try_divide(F.col("target") * F.col("cell_size"), "source_size"))
    seats = cells.where("cell_weight > 0").select("source", "shard", "cell_weight", F.explode(F.sequence(F.lit(0), F.ceil(2 * blocks * F.col("cell_weight") / F.col("total")).cast("int") + 1)).alias("k"))
    won = seats.orderBy(F.desc(F.col("cell_weight") / (2 * F.col("k") + 1)), F.col("source").asc_nulls_last(), "shard", "k").limit(blocks)
    won = won.groupBy(F.col("source").alias("w_source"), F.col("shard").alias("w_shard")).agg(F.count("*").alias("quota"))
    same = F.col("source").eqNullSafe(F.col("w_source")) & (F.col("shard") == F.col("w_shard"))
    cells = cells.join(won, same, "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    # words of a source's cells up to and with each one; a source has as many rows here as there are shards
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    of_source = Window.partitionBy("source")
    share = F.try_divide("target", "source_size")
    words = F.round(share * F.sum("cell_size").over(upto)) - F.round(share * (F.sum("cell_size").over(upto) - F.col("cell_size")))
    coarse = F.count_if(F.col("cell_weight") > 0).over(of_source) * F.col("total") / blocks / 2 > COARSE * F.col("target")
    take = F.least(F.when(coarse, words).otherwise(F.round(F.col("quota") * F.col("total") / blocks)), F.lit(MOST) * F.col("cell_size"))
    return cells.select("source", "shard", "cell_size", "source_size", "target", F.coalesce(take, F.lit(0.0)).cast("long").alias("take"), "quota")


def mix(docs: DataFrame, *keep: str, seed: str = SEED, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """The kept columns (as struct _row), doc_id, size, source_size, target, taken, shard and quota."""
    own = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))
    rows = docs.select(F.struct(*keep).alias("_row"), "doc_id", "source", n_words(F.col("text")).alias("size"), code.alias("code"))
    rows = rows.withColumn("shard", (F.conv(F.substring("code", 1, 2), 16, 10).cast("int") % shards)).withColumn("bucket", F.substring("code", 3, 3))
    rows = C.saved(rows, "mixing")
    buckets = C.saved(rows.groupBy("source", "shard", "bucket").agg(F.sum("size").alias("in_bucket")), "mixing-buckets")
    sources = targets(buckets.groupBy("source").agg(F.sum("in_bucket").alias("source_size"))).withColumnRenamed("source", "s_source")
    cell = buckets.groupBy("source", "shard").agg(F.sum("in_bucket").alias("cell_size"))
    cell = cell.join(sources, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    cell = quotas(cell, blocks).withColumnsRenamed({"source": "c_source", "shard": "c_shard"})
    ahead = Window.partitionBy("source", "shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0))).drop("in_bucket")
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("shard") == F.col("c_shard"))
    buckets = buckets.join(cell, same).selectExpr("source AS b_source", "shard AS b_shard", "bucket AS b_bucket", "ahead", "cell_size", "source_size", "target", "take", "quota")
    within = Window.partitionBy("source", "shard", "bucket").orderBy("code", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within))
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("shard") == F.col("b_shard")) & (F.col("bucket") == F.col("b_bucket"))
    passes = F.when(F.col("cell_size") > 0, F.floor(F.col("take") / F.col("cell_size"))).otherwise(0)
    rest = F.col("take") - passes * F.col("cell_size")
    start = F.col("ahead") + F.col("upto") - F.col("size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - start))
    return rows.join(buckets, same).select("_row", "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "shard", "quota")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with their own columns, a document once for each pass that begins it."""
    out = mix(docs, *docs.columns, **how).where("taken > 0")
    copies = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    return out.select("_row", copies.alias("_copy")).select("_row.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS code FROM documents),
placed AS (SELECT *, (('0x' || substr(code, 1, 2))::INT) % {SHARDS} AS shard FROM rows),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM placed GROUP BY source),
w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM src),
lv AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
one AS (SELECT arg_min(level, struct_pack(r := cap / weight, n := nth)) AS level FROM lv WHERE cap > level * weight),
tg AS (SELECT w.source, source_size, least(cap, coalesce(one.level * weight, cap)) AS target FROM w, one),
cell AS (
  SELECT p.source, p.shard, p.cell_size, tg.source_size, tg.target, CASE WHEN tg.source_size > 0 THEN target * cell_size / source_size ELSE 0 END AS cw
  FROM (SELECT source, shard, sum(size)::BIGINT AS cell_size FROM placed GROUP BY source, shard) p JOIN tg ON p.source IS NOT DISTINCT FROM tg.source),
total AS (SELECT sum(cw) AS total FROM cell),
seats AS (SELECT source, shard, cw, unnest(range(0, ceil(2 * {BLOCKS} * cw / total)::INT + 2)) AS k FROM cell, total WHERE cw > 0),
won AS (
  SELECT source, shard, count(*) AS quota FROM (SELECT * FROM seats ORDER BY cw / (2 * k + 1) DESC, source NULLS LAST, shard, k LIMIT {BLOCKS}) GROUP BY source, shard),
shared AS (
  SELECT *, count(*) FILTER (cw > 0) OVER (PARTITION BY source) AS cells, sum(cell_size) OVER (PARTITION BY source ORDER BY shard) AS shard_upto, CASE WHEN source_size > 0 THEN target / source_size END AS share FROM cell),
take AS (
  SELECT c.*, coalesce(least(CASE WHEN cells * total / {BLOCKS} / 2 > {COARSE}::DOUBLE * target THEN round(share * shard_upto) - round(share * (shard_upto - cell_size)) ELSE round(coalesce(quota, 0) * total / {BLOCKS}) END, 2.0 * cell_size), 0)::BIGINT AS take
  FROM shared c CROSS JOIN total LEFT JOIN won ON c.source IS NOT DISTINCT FROM won.source AND c.shard = won.shard),
run AS (
  SELECT p.*, sum(size) OVER (PARTITION BY source, shard ORDER BY substr(code, 3, 3), code, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM placed p)
SELECT doc_id, size, t.source_size, t.target,
       (CASE WHEN cell_size > 0 THEN take // cell_size ELSE 0 END * size
        + greatest(0, least(size, take - CASE WHEN cell_size > 0 THEN take // cell_size ELSE 0 END * cell_size - (upto - size))))::BIGINT AS taken
FROM run r JOIN take t ON r.source IS NOT DISTINCT FROM t.source AND r.shard = t.shard
"""
