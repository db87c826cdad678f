"""Nearest vectors by cosine with an inverted multi-index.

Two codebooks quantise the two halves of the unit vectors separately, so that k
centroids for each half make k * k cells. A query reaches the cells in order of
the summed distance of its halves to both centroids, which a heap over centroid
pairs gives one by one, until the cells it has opened hold ``share`` of all
entries; all their entries are reranked by their cosine in double precision.

Only the codebooks and ``share`` are fitted on a sample of at most
``sample_rows`` vectors: ``share`` is where the cells of ``target`` of the true
neighbours of sampled vectors lie in that order, so that vectors which form
clusters open few cells and vectors without structure many. Every vector is
indexed. In a sample neighbours are further away than in all rows, so the fitted
share is on the safe side.

Cells lie on shelves of about ``block`` entries; a cell with more is dealt over
several shelves. A query goes to each shelf once, with the cells that it opens
there, and the queries of a shelf are dealt in blocks as well, so that no group
outgrows a task. Equal vectors are one entry, and of their rows the k + 1 with
the smallest ids are all that an answer can need.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite
components take no part, and rows without an id neither; only vectors of equal
length are compared; a row is left out of its own answer only, so other rows
with its id may be in it; equal scores go by id; with fewer candidates all are
given; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

K, SAMPLE, BLOCK, TARGET, MOST_CENTROIDS, ROUNDS, PROBES, SEED = 5, 16384, 4096, 0.97, 256, 12, 256, 11


def matrices(column: pa.Array):
    """(length, rows, vectors) for each length of vectors, in double precision and scaled by powers of two."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), d)
        yield d, at, np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * x @ centroids.T


class Codebooks:
    """Centroids of both halves of the vectors of one length."""

    def __init__(self, x: np.ndarray, n: int, seed: int):
        k = max(1, min(MOST_CENTROIDS, 1 << max(0, round(math.log2(max(1.0, n / 16)) / 2)), len(x)))
        self.cut = x.shape[1] // 2
        rng = np.random.default_rng(seed)
        self.first, self.second = (self._fit(half, k, rng) for half in (x[:, : self.cut], x[:, self.cut :]))

    @staticmethod
    def _fit(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        centroids = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(ROUNDS):
            near = _distances(x, centroids).argmin(1)
            sums, n = np.zeros_like(centroids), np.bincount(near, minlength=k)
            np.add.at(sums, near, x)
            centroids[n > 0] = sums[n > 0] / n[n > 0, None]
        return centroids

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.cut], self.first), _distances(x[:, self.cut :], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def share(self, x: np.ndarray, k: int, target: float, rng: np.random.Generator) -> float:
        """The share of entries to open so that target of the k nearest of sampled vectors are among them."""
        if len(x) <= k + 1:
            return 1.0
        probes = rng.choice(len(x), min(PROBES, len(x)), replace=False)
        near = x[probes] @ x.T
        near[np.arange(len(probes)), probes] = -np.inf
        top = np.argpartition(-near, k, axis=1)[:, :k]
        cells = self.cells(x)
        held = np.bincount(cells, minlength=len(self.first) * len(self.second))
        a, b = self.halves(x[probes])
        reached = []
        for q in range(len(probes)):
            order = np.argsort((a[q][:, None] + b[q][None]).ravel(), kind="stable")
            until = np.empty(len(order))
            until[order] = np.cumsum(held[order])
            reached.append(until[cells[top[q]]])
        return float(np.quantile(np.concatenate(reached), target) / len(x))


def traverse(a: np.ndarray, b: np.ndarray, held: np.ndarray, enough: float) -> list[int]:
    """The cells with entries in order of a[i] + b[j], until they hold enough entries.

    The heap holds one pair for each row of the sorted distances that has been entered.
    """
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    near, far, width = a[i].tolist(), b[j].tolist(), len(b)
    counts, first, second = held, i.tolist(), j.tolist()
    heap, out, have = [(near[0] + far[0], 0, 0)], [], 0
    while heap and have < enough:
        _, p, q = heapq.heappop(heap)
        cell = first[p] * width + second[q]
        if counts[cell]:
            out.append(cell)
            have += counts[cell]
        if q + 1 < len(far):
            heapq.heappush(heap, (near[p] + far[q + 1], p, q + 1))
        if q == 0 and p + 1 < len(near):
            heapq.heappush(heap, (near[p + 1] + far[0], p + 1, 0))
    return out


class Shelves:
    """Where the entries of each cell of one length lie: a first shelf and how many of them."""

    def __init__(self, held: np.ndarray, first: int, block: int):
        self.held = held.tolist()
        self.parts = np.maximum(1, -(-held // block))
        large = self.parts > 1
        small = np.cumsum(np.where(large, 0, held)) // block  # small cells share shelves in order
        n_small = int(small.max()) + 1 if len(small) else 0
        self.first = np.where(large, n_small + np.cumsum(np.where(large, self.parts, 0)) - self.parts, small) + first
        self.end = first + n_small + int(self.parts[large].sum())


def nearest(vectors: DataFrame, asked: Column, k: int = K, sample_rows: int = SAMPLE, block: int = BLOCK, target: float = TARGET, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row of (vec_id, embedding) for which asked holds."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    rows = C.with_row_id(vectors.withColumn("_asked", F.coalesce(asked, F.lit(False))), "vec_id", "embedding", "_asked")
    if not single:
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = rows.where("vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, v -> v IS NOT NULL AND v = v AND abs(v) < double('inf')) AND exists(embedding, v -> v <> 0)")
    rows = rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    ids = C.saved(rows.select("vec_id", "_rid", "_asked", "k1", "k2"), "searched-ids")
    entries = C.saved(rows.groupBy("k1", "k2").agg(F.min_by("embedding", "_rid").alias("embedding"), F.min("vec_id").alias("least"), F.max("_asked").alias("asked")), "entries")
    lengths = {r["d"]: r["n"] for r in entries.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    total = sum(lengths.values())
    picked = entries.where(F.pmod(F.xxhash64("k1", F.lit(seed)), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, sample_rows / max(1, total))))).select("embedding")
    sample = picked.limit(2 * sample_rows).toArrow().column("embedding").combine_chunks()
    books, shares, rng = {}, {}, np.random.default_rng(seed)
    for d, _, x in matrices(sample):
        books[d] = Codebooks(_unit(x), lengths[d], seed)
        shares[d] = books[d].share(_unit(x), k, target, rng)
    known = spark.sparkContext.broadcast(books)

    def place(batches):
        for b in batches:
            cell = np.zeros(b.num_rows, np.int64)
            size = np.zeros(b.num_rows, np.int64)
            for d, at, x in matrices(b.column("embedding")):
                size[at] = d
                if d in known.value:
                    cell[at] = known.value[d].cells(_unit(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size), pa.array(cell)], names=[*b.schema.names, "d", "cell"])

    kind, id_type = "float" if single else "double", vectors.schema["vec_id"].dataType.simpleString()
    index = C.saved(entries.mapInArrow(place, f"k1 long, k2 long, embedding array<{kind}>, least {id_type}, asked boolean, d long, cell long"), "index")
    # at most MOST_CENTROIDS squared numbers for each length of vectors
    counted: dict[int, dict[int, int]] = {}
    for r in index.groupBy("d", "cell").agg(F.count("*").alias("n")).collect():
        counted.setdefault(r["d"], {})[r["cell"]] = r["n"]
    shelves, end = {}, 0
    for d, cells in sorted(counted.items()):
        held = np.zeros(len(books[d].first) * len(books[d].second) if d in books else 1, np.int64)
        held[list(cells)] = list(cells.values())
        shelves[d] = Shelves(held, end, block)
        end = shelves[d].end
    where = spark.sparkContext.broadcast(shelves)

    def shelve(batches):
        for b in batches:
            d, cell, k1 = (b.column(c).to_numpy() for c in ("d", "cell", "k1"))
            shelf = np.zeros(b.num_rows, np.int64)
            for n in np.unique(d).tolist():
                at, s = np.flatnonzero(d == n), where.value[n]
                shelf[at] = s.first[cell[at]] + (C.mix(k1[at].view(np.uint64)) % s.parts[cell[at]].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k1", "k2", "embedding", "least", "cell")), pa.array(shelf)], names=["k1", "k2", "embedding", "least", "cell", "shelf"])

    def ask(batches):
        for b in batches:
            for d, at, x in matrices(b.column("embedding")):
                s, book = where.value[d], known.value.get(d)
                halves = book.halves(_unit(x)) if book else (np.zeros((len(x), 1)), np.zeros((len(x), 1)))
                enough = shares.get(d, 1.0) * lengths[d]
                keys, vectors, shelf, opened = [], [], [], []
                for row, a, c in zip(at.tolist(), *halves, strict=True):
                    cells = np.array(traverse(a, c, s.held, enough))
                    many = s.parts[cells]
                    on = np.repeat(s.first[cells], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    order = np.argsort(on, kind="stable")
                    on, cells = on[order], np.repeat(cells, many)[order]
                    cuts = np.flatnonzero(np.diff(on, prepend=-1))
                    shelf += on[cuts].tolist()
                    opened += np.split(cells.astype(np.int32), cuts[1:])
                    keys += [row] * len(cuts)
                    if len(keys) > 20_000:
                        yield _asked(b, keys, shelf, opened)
                        keys, shelf, opened = [], [], []
                if keys:
                    yield _asked(b, keys, shelf, opened)

    on_shelf = index.mapInArrow(shelve, f"k1 long, k2 long, embedding array<{kind}>, least {id_type}, cell long, shelf long")
    routed = C.saved(index.where("asked").select("k1", "k2", "embedding").mapInArrow(ask, f"k1 long, k2 long, embedding array<{kind}>, shelf long, cells array<int>"), "routed-queries")
    parts = routed.groupBy("shelf").agg(F.ceil(F.count("*") / (block // 2)).cast("int").alias("parts"))
    left = routed.join(parts, "shelf").withColumn("part", F.pmod(F.xxhash64("k1", "k2"), F.col("parts")).cast("int")).drop("parts")
    right = on_shelf.join(parts, "shelf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    names = ["q1", "q2", "k1", "k2", "least", "score"]

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table([asked.column(c)[:0] for c in ("k1", "k2")] + [held.column(c)[:0] for c in ("k1", "k2", "least")] + [pa.array([], pa.float64())], names=names)
        ((_, _, q),) = matrices(asked.column("embedding").combine_chunks())
        held = held.sort_by("cell").combine_chunks()
        ((_, _, x),) = matrices(held.column("embedding").combine_chunks())
        cell = held.column("cell").to_numpy()
        cells = asked.column("cells").combine_chunks()
        of = np.repeat(np.arange(len(q)), cells.value_lengths().to_numpy(zero_copy_only=False))
        cells = cells.flatten().to_numpy()
        order = np.argsort(cells, kind="stable")
        of, cells = of[order], cells[order]
        norms, own = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", q, q))
        rank = np.argsort(pa.compute.sort_indices(held.column("least")).to_numpy())
        best = _Best(len(q), k + 1, rank)
        cuts = np.flatnonzero(np.diff(cells, prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cells)], strict=True):
            a, b = np.searchsorted(cell, cells[lo]), np.searchsorted(cell, cells[lo], "right")
            if a < b:
                score = np.einsum("ij,kj->ik", q[of[lo:hi]], x[a:b]) / (own[of[lo:hi], None] * norms[None, a:b])
                best.add(of[lo:hi], np.arange(a, b), score)
        of, at, score = best.rows()
        take = lambda t, c, i: t.column(c).take(pa.array(i))
        return pa.table([take(asked, "k1", of), take(asked, "k2", of), take(held, "k1", at), take(held, "k2", at), take(held, "least", at), pa.array(score)], names=names)

    found = left.groupBy("shelf", "part").cogroup(right.groupBy("shelf", "part")).applyInArrow(rerank, f"q1 long, q2 long, k1 long, k2 long, least {id_type}, score double")
    # of the rows of equal vectors those with the smallest ids, cut down where they lie before they are moved
    first = ids.withColumn("_n", F.row_number().over(W.partitionBy("k1", "k2").orderBy("vec_id", "_rid"))).where(F.col("_n") <= k + 1)
    best = found.withColumn("_n", F.row_number().over(W.partitionBy("q1", "q2").orderBy(F.desc("score"), "least", "k1"))).where(F.col("_n") <= k + 1)
    best = C.saved(best.select("q1", "q2", "k1", "k2", "score"), "best-entries")
    near = best.join(first.select("k1", "k2", "vec_id", "_rid"), ["k1", "k2"])
    near = near.withColumn("_n", F.row_number().over(W.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id", "_rid"))).where(F.col("_n") <= k + 1)
    near = near.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "_rid", "score"))).alias("near"))
    answer = ids.where("_asked").select(F.col("vec_id").alias("query_id"), F.col("_rid").alias("_own"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).join(near, ["q1", "q2"])
    others = F.slice(F.filter("near", lambda x: x["_rid"] != F.col("_own")), 1, k)
    return answer.select("query_id", F.posexplode(others).alias("_p", "_x")).select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score"))


def _asked(b: pa.RecordBatch, keys: list[int], shelf: list[int], opened: list[np.ndarray]) -> pa.RecordBatch:
    at, ends = pa.array(keys), np.cumsum([0, *map(len, opened)])
    cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(opened), pa.int32()))
    return pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), b.column("embedding").take(at), pa.array(shelf, pa.int64()), cells], names=["k1", "k2", "embedding", "shelf", "cells"])


class _Best:
    """The m best entries of each query so far; of equal scores those of lower rank."""

    def __init__(self, n: int, m: int, rank: np.ndarray):
        self.score, self.at, self.rank = np.full((n, m), -np.inf), np.full((n, m), -1), rank

    def add(self, of: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        m = self.score.shape[1]
        both = np.concatenate([self.score[of], score], axis=1)
        place = np.concatenate([self.at[of], np.broadcast_to(at, score.shape)], axis=1)
        top = np.lexsort((self.rank[place], -both), axis=1)[:, :m]
        self.score[of], self.at[of] = np.take_along_axis(both, top, 1), np.take_along_axis(place, top, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, slot = np.nonzero(self.at >= 0)
        return of, self.at[of, slot], self.score[of, slot]


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(C.read(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"))
