"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the unit vectors again and again at the median of a random
projection; vectors near a split go to both sides. Vectors are compared only
within leaves, in double precision, and the links found in all trees are
united. A pair that meets in several leaves counts in the first of them only,
which the tasks tell from the leaves of both vectors, so that links are counted
without being listed; for components each leaf sends one link per vector to the
root of its part of the leaf.

The first levels of the trees are fitted on a sample of at most ``sample_rows``
vectors (the splits of ``trees`` trees over ``sample_rows`` / 32 leaves are all
that is broadcast); all vectors are routed. Leaves that still hold more than
``block`` vectors are split on, level by level, at the median of the projections
of all their vectors, so that the number of leaves follows the data: such a level
moves ids and projections only. Equal vectors are compared once and counted by
their number. A leaf that no projection splits, as its vectors lie too near each
other, is compared block by block, each pair of blocks in a group of its own.

Defined cases: vectors that are null, empty, all zero, or hold null or
non-finite components link with nothing and are kept; vectors of different
length never link; rows whose vec_id repeats or is null are rows of their own
(a null component_id means that no vec_id in the component is known; kept is
then true for one row of it); an empty table gives an empty result; labels and
further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

THRESHOLD, TREES, LEAF, BLOCK, SAMPLE, SPILL, SEED = 0.9, 5, 400, 2000, 16384, 0.4, 7


class Tree:
    """Directions and thresholds of the inner nodes, heap-ordered; leaves are the nodes below."""

    def __init__(self, x: np.ndarray, depth: int, margin: float, rng: np.random.Generator):
        n = (1 << depth) - 1
        self.depth, self.margin = depth, margin
        self.directions, self.thresholds = np.zeros((n, x.shape[1])), np.zeros(n)
        held = {0: np.arange(len(x))}
        for node in range(n):
            at = held.pop(node, np.empty(0, int))
            best = None
            for _ in range(4):  # of four random directions the one with the fewest vectors near the split
                d = rng.standard_normal(x.shape[1])
                d /= np.linalg.norm(d)
                p = x[at] @ d
                t = float(np.median(p)) if len(p) else 0.0
                near = np.mean(np.abs(p - t) < margin) if len(p) else 0.0
                if best is None or near < best[0]:
                    best = (near, d, t, p)
            _, self.directions[node], self.thresholds[node], p = best
            held[2 * node + 1] = at[p < self.thresholds[node] + margin]
            held[2 * node + 2] = at[p >= self.thresholds[node] - margin]

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaves), a row once for each leaf that it reaches."""
        rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            p = np.einsum("ij,ij->i", x[rows], self.directions[nodes]) - self.thresholds[nodes]
            left, right = p < self.margin, p >= -self.margin
            rows = np.concatenate([rows[left], rows[right]])
            nodes = np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
        return rows, nodes - ((1 << self.depth) - 1)


def unit_rows(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Rows by length of their vector, and their unit vectors in double precision."""
    rows, mats = {}, {}
    sizes = np.array(pa.compute.list_value_length(column).fill_null(0).to_pylist(), dtype=np.int64)
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), d)
        norm = np.sqrt((flat * flat).sum(1))
        ok = np.isfinite(norm) & (norm > 0)
        if not ok.all():  # components as large or as small as a double can be
            big = np.abs(flat).max(1)
            fine = np.isfinite(flat).all(1) & (big > 0)
            flat = np.where(fine[:, None], flat / np.where(fine, big, 1)[:, None], 0)
            norm, ok = np.sqrt((flat * flat).sum(1)), fine
        rows[d], mats[d] = at[ok], flat[ok] / norm[ok, None]
    return sizes, rows, mats


class Forest:
    """Trees for each length of vectors seen in the sample."""

    def __init__(self, sample: pa.Array, n_rows: int, trees: int, leaf: int, threshold: float, spill: float, seed: int):
        self.trees: dict[int, list[Tree]] = {}
        _, rows, mats = unit_rows(sample)
        for d, x in mats.items():
            share = len(x) / max(1, len(sample))
            depth = min(math.ceil(math.log2(max(1, n_rows * share / leaf))), int(math.log2(max(1, len(x) / 32))))
            margin = spill * math.sqrt(2 * (1 - threshold) / d)
            self.trees[d] = [Tree(x, max(0, depth), margin, np.random.default_rng(seed + k)) for k in range(trees)]

    def codes(self, d: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, codes): the leaves of all trees as one number each, the lengths apart."""
        rows, codes = [], []
        for k, tree in enumerate(self.trees.get(d, [None])):
            r, leaf = tree.route(x) if tree else (np.arange(len(x)), np.zeros(len(x), np.int64))
            rows.append(r)
            codes.append((np.int64(d) << 40) + (k << 32) + leaf)
        return np.concatenate(rows), np.concatenate(codes)


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each row of a matrix of links."""
    root = np.arange(len(linked))
    a, b = np.nonzero(linked)
    while len(a):
        new = root.copy()
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def compare(count, x, codes, ends, side, code: int, threshold: float):
    """(new links, local root) of each vector of one leaf, or of two blocks of it (side 1 and 2).

    codes: all leaves of the vectors, one list after the other up to ends.
    """
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    some = np.flatnonzero(linked.any(1))
    new = np.zeros(len(x), np.int64)
    if len(some):
        # pairs that share a leaf before this one count there
        many = np.diff(np.concatenate(([0], ends)))[some]
        at = np.repeat(ends[some] - np.cumsum(many), many) + np.arange(many.sum())
        of, mine = np.repeat(np.arange(len(some)), many), codes[at]
        of, mine = of[mine < code], mine[mine < code]
        met, place = np.unique(mine, return_inverse=True)
        own = linked[np.ix_(some, some)]
        if len(met):
            earlier = np.zeros((len(some), len(met)), np.float32)
            earlier[of, place] = 1
            new[some] = (own & ~(earlier @ earlier.T > 0)) @ count[some]
        else:
            new[some] = own @ count[some]
    return new, _local_roots(linked)


def _split_large(leaves: DataFrame, reps: DataFrame, block: int, margin, seed: int, levels: int = 6) -> DataFrame:
    """Leaves (rid, code) of at most block vectors, as far as projections can split them.

    A pass projects the vectors of large leaves on ``levels`` random directions, each leaf on its own, and splits
    them level by level at the median, vectors near it to both sides; passes go on while they make leaves smaller.
    """
    step = 0
    while True:
        sizes = leaves.groupBy("code").agg(F.count("*").alias("m"))
        large = C.saved(sizes.where(F.col("m") > block), "large-leaves")
        if large.isEmpty():
            return leaves
        step += 1

        def project(batches, step=step):
            for b in batches:
                code = b.column("code").to_numpy()
                _, at, mats = unit_rows(b.column("embedding"))
                for d, x in mats.items():
                    out = np.empty((len(x), levels))
                    for c in np.unique(code[at[d]]).tolist():
                        mine = code[at[d]] == c
                        directions = np.random.default_rng([seed, step, c % (1 << 62)]).standard_normal((levels, d))
                        out[mine] = x[mine] @ (directions / np.linalg.norm(directions, axis=1)[:, None]).T
                    pick = pa.array(at[d])
                    yield pa.RecordBatch.from_arrays([b.column("rid").take(pick), b.column("code").take(pick), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), levels).cast(pa.list_(pa.float64())), pa.array(np.full(len(x), margin(d)))], names=["rid", "code", "p", "margin"])

        rows = leaves.join(large.select("code"), "code").join(reps.select("rid", "embedding"), "rid").select("rid", "code", "embedding")
        rows = C.saved(rows.mapInArrow(project, "rid long, code long, p array<double>, margin double").withColumn("leaf", F.col("code")), "projected")
        for k in range(levels):
            node = rows.groupBy("leaf").agg(F.count("*").alias("m"), F.percentile_approx(F.col("p")[k], 0.5).alias("cut"))
            on = rows.join(node, "leaf")
            p = F.col("p")[k] - F.col("cut")
            side = F.when(F.col("m") <= block, F.array(F.lit(0))).when(F.abs(p) < F.col("margin"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.when(p < 0, 1).otherwise(2)))
            on = on.withColumn("side", F.explode(side))
            # the kind of leaf stays in the upper bits, so that leaves of vectors of other lengths and trees stay apart
            name = F.when(F.col("side") == 0, F.col("leaf")).otherwise(F.xxhash64("leaf", "side", F.lit(step)))
            rows = C.saved(on.select("rid", "code", "p", "margin", name.alias("leaf")), "split-leaves")
        # a leaf whose parts are hardly smaller than it was stays as it is
        parts = rows.groupBy("code", "leaf").agg(F.count("*").alias("m")).groupBy("code").agg(F.max("m").alias("most"))
        good = C.saved(parts.join(large, "code").where(F.col("most") <= 0.7 * F.col("m")).select("code"), "leaves-that-split")
        done = good.isEmpty()
        leaves = leaves.join(good, "code", "left_anti").select("rid", "code").unionByName(rows.join(good, "code").select("rid", F.col("leaf").alias("code")))
        leaves = C.saved(leaves, "leaves")
        if done:
            return leaves


def links(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample_rows: int = SAMPLE, spill: float = SPILL, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    vectors = vectors.select("vec_id", "embedding") if single else vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = C.with_row_id(vectors, "vec_id", "embedding")
    rows = rows.withColumn("_k1", F.xxhash64("embedding")).withColumn("_k2", F.xxhash64(F.lit(1), "embedding"))
    ids = C.saved(rows.select("vec_id", "_rid", "_k1", "_k2"), "vector-ids")
    reps = rows.where("embedding IS NOT NULL AND size(embedding) > 0").groupBy("_k1", "_k2").agg(F.min_by("embedding", "_rid").alias("embedding"), F.min("_rid").alias("rid"), F.count("*").alias("n"))
    reps = C.saved(reps, "distinct-vectors")
    total = reps.count()
    picked = reps.where(F.pmod(F.xxhash64("_k1", F.lit(seed)), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, sample_rows / max(1, total))))).select("embedding")
    sample = picked.limit(2 * sample_rows).toArrow().column("embedding").combine_chunks()
    forest = spark.sparkContext.broadcast(Forest(sample, total, trees, leaf, threshold, spill, seed))

    def route(batches):
        for b in batches:
            _, at, mats = unit_rows(b.column("embedding"))
            rid = b.column("rid").to_numpy()
            for d, x in mats.items():
                r, codes = forest.value.codes(d, x)
                yield pa.RecordBatch.from_arrays([pa.array(rid[at[d]][r]), pa.array(codes)], names=["rid", "code"])

    leaves = C.saved(reps.select("embedding", "rid").mapInArrow(route, "rid long, code long"), "leaves")
    leaves = _split_large(leaves, reps, block, lambda d: spill * math.sqrt(2 * (1 - threshold) / d), seed)
    # what is still too large is compared by pairs of blocks
    parts = leaves.groupBy("code").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    lists = leaves.groupBy("rid").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    dealt = reps.select("rid", "n", "embedding").join(lists, "rid").withColumn("code", F.explode("codes")).join(parts, "code", "left")
    own = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumn("side", F.when((F.col("other") < 0) | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2))
    dealt = dealt.withColumn("lo", F.when(F.col("other") < 0, -1).otherwise(F.least("own", "other"))).withColumn("hi", F.greatest("own", "other"))

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid").combine_chunks()
        rid, count = table.column("rid").to_numpy(), table.column("n").to_numpy()
        _, at, mats = unit_rows(table.column("embedding").combine_chunks())
        (x,) = mats.values()  # a leaf has vectors of one length
        codes = table.column("codes").combine_chunks()
        ends = np.cumsum(pa.compute.list_value_length(codes).to_numpy(zero_copy_only=False))
        n, root = compare(count, x, codes.flatten().to_numpy(), ends, table.column("side").to_numpy(), table.column("code")[0].as_py(), threshold)
        some = (n > 0) | (root != np.arange(len(root)))
        return pa.table({"rid": rid[some], "n": n[some].astype(np.int64), "root": rid[root[some]]})

    found = C.saved(dealt.select("code", "lo", "hi", "side", "rid", "n", "embedding", "codes").groupBy("code", "lo", "hi").applyInArrow(solve, "rid long, n long, root long"), "leaf-links")
    direct = found.groupBy("rid").agg(F.sum("n").alias("linked"))
    roots = components(found.selectExpr("rid AS a", "root AS b"))
    # a vector that isn't one (null, zero, not finite) stands alone even beside equal rows
    valid = F.expr("forall(embedding, v -> v IS NOT NULL AND v = v AND abs(v) < double('inf')) AND exists(embedding, v -> v <> 0)")
    per = reps.select("_k1", "_k2", "rid", "n", valid.alias("ok")).join(direct, "rid", "left").join(roots, F.col("rid") == F.col("node"), "left")
    per = per.select("_k1", "_k2", "n", "ok", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "rid").alias("root"))
    out = ids.join(per, ["_k1", "_k2"], "left")
    out = out.select("vec_id", "_rid", F.when(F.col("ok"), F.col("linked") + F.col("n") - 1).otherwise(0).cast("long").alias("n_links"), F.when(F.col("ok"), F.col("root")).otherwise(-1 - F.col("_rid")).alias("_root"))
    out = C.saved(out, "linked-vectors")
    # without any known vec_id the first row of a component is kept
    names = C.saved(out.groupBy("_root").agg(F.min("vec_id").alias("component_id"), F.min("_rid").alias("_first")), "vector-components")
    out = out.join(names, "_root").withColumn("kept", F.when(F.col("component_id").isNull(), F.col("_rid") == F.col("_first")).otherwise(F.col("vec_id").eqNullSafe(F.col("component_id"))))
    return out.select("vec_id", "n_links", "component_id", "kept")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(C.read(spark, sf_dir, "embeddings"))
