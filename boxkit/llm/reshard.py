"""Resharding by minimum-cost flow.

Documents lie in old shards: those of a column, or by the hash of their text.
Each old shard is cut into blocks by the hash of the text; the driver gets one
row per block (a number bound by parameters, whatever the input), solves the
flow from old shard sizes to new capacities that moves the fewest bytes, and
fills each flow with whole blocks. Documents then find their new shard and the
slot offset of their block by a join with that table; slots within a block are
numbered block by block, so no task ever sees a whole shard.

Equal texts of an old shard share a block and so stay together. Blocks far over
the mean are split by another hash of the text. A text whose copies alone hold
more than ``GROUP`` of a new shard, of bytes or rows, is numbered in parts by
doc_id; these stay in one shard unless they hold more than ``WHOLE`` of its bytes:
then no law could be kept with the text in one piece.

Defined cases: a null text has 0 bytes of text and crc32 0; equal rows get
different slots; a null doc_id is hashed like any value, and rows are told apart
by their place, so rewrite() keeps rows with null or repeated ids; an empty table
gives an empty result; further columns are ignored by assign() and kept by
rewrite(). A null old shard counts as shard 0.
"""

from __future__ import annotations

import uuid

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

SHARDS, BLOCKS, HOT, GROUP, WHOLE = 8, 512, 4, 1 / 8, 1 / 2


def min_cost_flow(supply: list[int], capacity: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Flow of all supply into capacities at the least cost, by successive shortest paths.

    The graph has one node per shard, so this is small work however large the data.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list] = []  # to, left, cost
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a, b, most, c):
        out[a].append(len(edges))
        edges.append([b, most, c])
        out[b].append(len(edges))
        edges.append([a, 0, -c])

    for i, x in enumerate(supply):
        add(source, i, x, 0)
    for j, x in enumerate(capacity):
        add(n + j, sink, x, 0)
    between = {}
    for i in range(n):
        for j in range(m):
            between[i, j] = len(edges)
            add(i, n + j, supply[i], cost(i, j))
    while True:
        dist, via, work = {source: 0}, {}, deque([source])
        while work:
            a = work.popleft()
            for k in out[a]:
                b, left, c = edges[k]
                if left > 0 and dist[a] + c < dist.get(b, float("inf")):
                    dist[b], via[b] = dist[a] + c, k
                    work.append(b)
        if sink not in dist:
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = edges[via[at] ^ 1][0]
        amount = min(edges[k][1] for k in path)
        for k in path:
            edges[k][1] -= amount
            edges[k ^ 1][1] += amount
    return {ij: edges[k ^ 1][1] for ij, k in between.items() if edges[k ^ 1][1]}


def choose(blocks: list[tuple[int, int, int, int]], old: list[int], shards: int) -> tuple[dict, dict]:
    """blocks: (id, old shard, bytes, rows). Gives block -> new shard, and the flow."""
    supply = [0] * len(old)
    for _, i, size, _ in blocks:
        supply[i] += size
    total = sum(supply)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    flow = min_cost_flow(supply, capacity)
    to = {b: i for b, i, _, _ in blocks}
    by_shard: dict[int, list] = {}
    for b in sorted(blocks, key=lambda b: (-b[2], b[0])):
        by_shard.setdefault(b[1], []).append(b)
    size = list(supply) + [0] * max(0, shards - len(supply))
    for (i, j), amount in sorted(flow.items()):
        if i == j:
            continue
        left, rest = amount, []
        for b in by_shard.get(i, []):
            if b[2] <= left or i >= shards:
                to[b[0]] = j
                left -= b[2]
                size[i] -= b[2]
                size[j] += b[2]
                if i >= shards and left <= 0:
                    rest += [x for x in by_shard[i] if to[x[0]] == i and x not in rest]
                    break
            else:
                rest.append(b)
        by_shard[i] = rest
    for b, i, s, _ in blocks:  # an old shard that is no more may keep nothing
        if to[b] >= shards:
            j = min(range(shards), key=lambda k: size[k])
            to[b] = j
            size[j] += s
    # what whole blocks left uneven: move or swap single small blocks between the extremes
    held: dict[int, list] = {}
    for b, _, s, _ in blocks:
        held.setdefault(to[b], []).append((s, b))
    while True:  # each move brings the extremes nearer
        hi, lo = max(range(shards), key=lambda k: size[k]), min(range(shards), key=lambda k: size[k])
        gap = size[hi] - size[lo]
        fit = [x for x in held.get(hi, []) if 0 < x[0] < gap]
        if gap <= 1 or not fit:
            break
        s, b = min(fit, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[hi].remove((s, b))
        held.setdefault(lo, []).append((s, b))
        to[b] = lo
        size[hi] -= s
        size[lo] += s
    return to, flow


def assign(docs: DataFrame, shards: int = SHARDS, old_shards: int = SHARDS, blocks: int = BLOCKS, old: str | None = None) -> DataFrame:
    """_rid, doc_id, size, text_crc32, old_shard, shard and slot of every document; old: the column with its old shard (0 and up)."""
    spark = docs.sparkSession
    n = old_shards * blocks
    of_text = F.pmod("h", F.lit(n))
    place = of_text if old is None else F.col("old_shard") + old_shards * F.pmod("h", F.lit(blocks))
    rows = C.with_row_id(docs, "doc_id", "text", (F.lit(None) if old is None else F.col(old)).cast("int").alias("old_shard"))
    slim = rows.select(
        "_rid",
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce("old_shard", F.lit(0)).alias("old_shard"),
        F.xxhash64("text").alias("h"),
        F.xxhash64("doc_id", F.lit("part")).alias("order"),
    )
    slim = C.saved(slim.withColumn("block", place.cast("int")), "reshard")
    first = slim.groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()  # n rows at most
    total = {k: sum(r[k] for r in first) for k in ("size", "rows")}
    over = lambda r: max(r[k] * n / total[k] / HOT for k in total)
    slim = slim.withColumn("part", F.lit(0))
    many = [(r["block"], int(over(r)) + 1) for r in first if over(r) > 1 and r["rows"] > 1]  # fewer than n / HOT rows
    if many:
        split = F.broadcast(spark.createDataFrame(many, "block int, parts int"))
        slim = slim.join(split, "block", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("h", F.lit("text")), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    # copies of one text beyond the limit are numbered in parts; no more texts can reach it than there are shards / GROUP, by bytes or rows
    most = {k: v * GROUP / shards for k, v in total.items()}
    large = [r["block"] for r in first if any(r[k] > most[k] for k in total) and r["rows"] > 1]
    unit = {}  # the parts of a text that one shard can hold beside others stay together
    if large:
        copies = slim.where(F.col("block").isin(large)).groupBy("block", "h").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        copies = copies.where(F.col("rows") > 1).where((F.col("size") > most["size"]) | (F.col("rows") > most["rows"])).collect()
        if copies:
            hot = [(r["block"], r["h"], (i + 1) * 2 * n, int(over(r)) + 1) for i, r in enumerate(copies)]
            unit = {(b, start + k): (b, start) for (b, _, start, parts), r in zip(hot, copies, strict=True) if r["size"] <= total["size"] / shards * WHOLE for k in range(parts)}
            hot = F.broadcast(spark.createDataFrame(hot, "block int, h long, start int, parts int"))
            dealt = F.when(F.col("start").isNull(), F.col("part")).otherwise(F.col("start") + F.pmod("order", F.col("parts")))
            slim = slim.join(hot, ["block", "h"], "left").withColumn("part", dealt.cast("int")).drop("start", "parts")
    parts = sorted(tuple(r) for r in slim.groupBy("block", "part").agg(F.sum("size"), F.count("*")).collect())
    units: dict[tuple, list] = {}
    for b, p, size, c in parts:
        held = units.setdefault(unit.get((b, p), (b, p)), [0, 0])
        held[0] += size
        held[1] += c
    to, _ = choose([(k, k[0] % old_shards, size, c) for k, (size, c) in sorted(units.items())], list(range(old_shards)), shards)
    at, table = [0] * shards, []
    for b, p, _, c in parts:
        shard = to[unit.get((b, p), (b, p))]
        table.append((b, p, shard, at[shard]))
        at[shard] += c
    placed = F.broadcast(spark.createDataFrame(table, "block int, part int, shard int, offset long"))
    within = Window.partitionBy("block", "part").orderBy("order", "doc_id", "text_crc32", "size", "_rid")
    return (
        slim.withColumn("nth", F.row_number().over(within))
        .join(placed, ["block", "part"])
        .select("_rid", "doc_id", "size", "text_crc32", (F.col("block") % old_shards).alias("old_shard"), "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"))
    )


def transfers(assigned: DataFrame) -> DataFrame:
    """Bytes and rows that move from each old shard to each new one."""
    return assigned.groupBy("old_shard", "shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def rewrite(docs: DataFrame, assigned: DataFrame, path: str) -> list[int]:
    """Writes the files of the shards that a transfer touches, with all columns and the slot, below path; gives those shards.

    Files are partitioned by new_shard; shards that nothing enters or leaves keep the files that they have there. All new
    files are written beside the old ones first, so docs may be what lies below path; then each touched shard's folder
    is put away and the new one moved in, if the shard has rows left, and at the end what was put away is removed. A run
    that breaks off leaves the old files of a shard or the new ones, and what it has put away.
    """
    spark = docs.sparkSession
    moved = transfers(assigned).where("old_shard <> shard").collect()  # at most old x new shards
    touched = sorted({r["old_shard"] for r in moved} | {r["shard"] for r in moved})
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_rid"))
    place = assigned.where(F.col("shard").isin(touched)).select("_rid", F.col("shard").alias("_to"), F.col("slot").alias("_slot"))
    keep = [c for c in docs.columns if c not in ("new_slot", "new_shard")]
    rows = rows.join(place, "_rid").select(*(F.col("_row")[c].alias(c) for c in keep), F.col("_slot").alias("new_slot"), F.col("_to").alias("new_shard"))
    staged, away = (f"{path}/_{k}-{uuid.uuid4().hex}" for k in ("staged", "away"))  # names that readers pass over
    rows.write.partitionBy("new_shard").parquet(staged)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(away))
    for k in touched:
        folder = f"new_shard={k}"
        if fs.exists(at(f"{path}/{folder}")):
            fs.rename(at(f"{path}/{folder}"), at(f"{away}/{folder}"))
        if fs.exists(at(f"{staged}/{folder}")):
            fs.rename(at(f"{staged}/{folder}"), at(f"{path}/{folder}"))
    fs.delete(at(staged), True)
    fs.delete(at(away), True)
    return touched


def digest(assigned: DataFrame) -> DataFrame:
    return assigned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op6_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(assign(C.read(spark, sf_dir, "documents")))
