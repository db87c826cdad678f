"""Search among descriptors (uid, vec): exact, by hash codes, and with relevance feedback.

Query sets are stated and small, so they are broadcast; each query's best rows
are kept per task before they meet (a grouped top-k, not a sort of all pairs).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec as V
from ..shared import stored
from . import hashing, quantiles

#: "farthest": what is least alike by histogram intersection comes first.
DISTANCES = {"euclidean": V.euclidean, "cosine": V.cosine_distance, "intersection": V.intersection_distance, "farthest": lambda a, b: -V.intersection_distance(a, b)}
MOST_QUERIES = 10_000
#: Of a search: distances that a task holds as one matrix, rows that the queries of a block keep, and rows that are sent at a time.
CELLS, KEPT, SENT = 1 << 21, 1_000_000, 10_000


def _in_blocks(queries: DataFrame, f, key: str = "query_id", most: int | None = None) -> DataFrame:
    """f of a broadcast query table; more than most (MOST_QUERIES) queries go in blocks by hashed key of about half as many, each broadcast for itself."""
    n, most = queries.count(), most or MOST_QUERIES
    if n <= most:
        return f(F.broadcast(queries))
    blocks = -(-2 * n // most)
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    return reduce(DataFrame.unionByName, [f(F.broadcast(queries.where(block == i))) for i in range(blocks)])


def knn(vectors: DataFrame, queries: DataFrame, k: int, distance: str = "euclidean") -> DataFrame:
    """The k nearest vectors of each query (query_id, qvec), ties by uid; rank from 1. Many queries go in blocks.

    A task compares its batches with the whole block of queries at once and keeps what may be among the k best of each;
    only those are compared again, one by one, and ranked.
    """
    vectors, exact = vectors.select("uid", "vec"), DISTANCES[distance](F.col("vec"), F.col("qvec"))

    def nearest(some: DataFrame) -> DataFrame:
        block = some.toArrow()  # at most MOST_QUERIES rows
        ids, groups = block.column("query_id").combine_chunks(), _by_length(block.column("qvec").combine_chunks())
        id_type, fields = some.schema["query_id"].dataType.simpleString(), vectors.schema
        out = f"query_id {id_type}, uid {fields['uid'].dataType.simpleString()}, vec {fields['vec'].dataType.simpleString()}"

        def run(batches):
            best, held = np.full(len(ids), np.inf), []
            for b in batches:
                for size, (rows, x) in _by_length(b.column("vec")).items():
                    mine, q = groups.get(size, (np.empty(0, int), None))
                    if not len(mine):
                        continue
                    parts, step = [], max(1, CELLS // len(x))
                    for i in range(0, len(mine), step):
                        some_of, d = mine[i : i + step], _block_distances(q[i : i + step], x, distance)
                        if d.shape[1] > k:
                            kth = np.partition(d, k - 1, axis=1)[:, k - 1]
                            best[some_of] = np.fmin(best[some_of], kth + 1e-9 * (1 + np.abs(kth)))
                        of, at = np.nonzero(d <= best[some_of][:, None])
                        parts.append((some_of[of], d[of, at], at))
                    of, d, at = (np.concatenate(c) for c in zip(*parts, strict=True))
                    used, at = np.unique(at, return_inverse=True)  # a row is held once for all queries that keep it
                    held.append((of, d, at, b.take(pa.array(rows[used])).select(["uid", "vec"])))
                if sum(len(h[0]) for h in held) > 4 * k * len(ids) + 100_000:
                    held = [_merged(held, k, best)]
            if held:
                of, _, at, rows = _merged(held, k, best)
                for i in range(0, len(of), SENT):
                    one = rows.take(pa.array(at[i : i + SENT]))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of[i : i + SENT])), one.column("uid"), one.column("vec")], names=["query_id", "uid", "vec"])

        found = vectors.mapInArrow(run, out).join(some, "query_id")
        return ranked(found.select("query_id", "uid", exact.alias("distance")), "query_id", k)

    return _in_blocks(queries.select("query_id", "qvec"), nearest, most=max(1, min(MOST_QUERIES, KEPT // k))) if k > 0 else queries.limit(0).selectExpr("query_id", "'' AS uid", "0D AS distance", "0 AS rank")


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by the length of their vector, and the vectors as a matrix; null vectors are left out."""
    sizes, out = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        out[n] = at, column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), n)
    return out


def _block_distances(q: np.ndarray, x: np.ndarray, distance: str) -> np.ndarray:
    """Numbers in the order of DISTANCES for all queries and rows, up to rounding."""
    if distance == "euclidean":
        return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0)
    if distance == "cosine":
        a, b = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        zero = (a[:, None] == 0) | (b[None] == 0)
        return np.where(zero, 1.0, -(q @ x.T) / np.where(zero, 1, a[:, None] * b[None]))
    same = np.stack([np.minimum(x, row).sum(1) for row in q])
    return same if distance == "farthest" else -same


def _merged(held: list, k: int, best: np.ndarray):
    """Of kept rows (query, distance, place in the table beside it) those that can still be among the k best of their query."""
    of, d = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    starts = np.cumsum([0, *(h[3].num_rows for h in held[:-1])])
    at = np.concatenate([h[2] + s for h, s in zip(held, starts, strict=True)])
    rows = pa.Table.from_batches([h[3] for h in held])
    order = np.lexsort((d, of))
    first = np.searchsorted(of[order], np.arange(len(best)))
    end = np.searchsorted(of[order], np.arange(len(best)), "right")
    full = end - first >= k
    kth = d[order][np.minimum(first[full] + k - 1, len(d) - 1)]
    best[full] = np.minimum(best[full], kth + 1e-9 * (1 + np.abs(kth)))
    keep = np.flatnonzero(d <= best[of])
    used, at = np.unique(at[keep], return_inverse=True)
    rows = rows.take(pa.array(used)).combine_chunks()
    return of[keep], d[keep], at, rows.to_batches()[0] if rows.num_rows else pa.RecordBatch.from_pylist([], schema=rows.schema)


def ranked(pairs: DataFrame, key: str, k: int) -> DataFrame:
    """Best k rows per key by distance, then uid: the filter on the rank lets Spark cut each task's rows to k first."""
    w = Window.partitionBy(key).orderBy("distance", "uid")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_sampled(vectors: DataFrame, queries: DataFrame, k: int, above: int, fraction: float, seed: int = 7) -> DataFrame:
    """knn, but over a seeded share of the vectors (2 k of them at least) where there are more than ``above``."""
    n = vectors.count()
    if n <= above:
        return knn(vectors, queries, k)
    share = max(fraction, 2 * k / n)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "uid").cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return knn(vectors.where(h < share), queries, k)


class Itq:
    """A mean and a rotated projection, whose signs are the bits of a code."""

    def __init__(self, mean: np.ndarray, projection: np.ndarray):
        self.mean, self.projection = mean, projection

    def bits(self, x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return ((x / np.where(n > 0, n, 1) - self.mean) @ self.projection > 0).astype(np.uint8)


def itq_fit(vectors: DataFrame, bits: int, rounds: int = 10, seed: int = 0) -> Itq:
    """Normalise, centre, project on principal axes, then turn the axes so that signs fit best.

    Tasks give sums of products; the driver sees matrices of dimension x dimension only.
    """

    def moments(batches):
        s, c, n = 0, 0, 0
        for b in batches:
            x = _matrix(b.column("vec"))
            s, c, n = s + x.sum(0), c + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()]), pa.array([c.tobytes()])], names=["n", "s", "c"])

    rows = vectors.select("vec").mapInArrow(moments, "n long, s binary, c binary")
    n, s, c = 0, 0, 0
    for r in rows.toLocalIterator():
        n, s, c = n + r.n, s + np.frombuffer(r.s), c + np.frombuffer(r.c)
    mean = s / n
    d = len(mean)
    _, axes = np.linalg.eigh(c.reshape(d, d) / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :bits]
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(rounds):
        turn = axes @ rotation

        def fit(batches, turn=turn):
            m = 0
            for b in batches:
                v = (_matrix(b.column("vec")) - mean) @ axes
                m = m + np.where(v @ (axes.T @ turn) > 0, 1.0, -1.0).T @ v
            if not np.isscalar(m):
                yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()])], names=["m"])

        total = sum(np.frombuffer(r.m) for r in vectors.select("vec").mapInArrow(fit, "m binary").toLocalIterator())
        u, _, w = np.linalg.svd(total.reshape(bits, bits))
        rotation = w.T @ u.T
    return Itq(mean, axes @ rotation)


def _matrix(column: pa.Array) -> np.ndarray:
    x = np.stack(column.to_numpy(zero_copy_only=False)).astype(float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def itq_hash(vectors: DataFrame, model: Itq) -> DataFrame:
    """uid and code (long; at most 63 bits) of every vector."""

    def run(batches):
        for b in batches:
            bits = model.bits(np.stack(b.column("vec").to_numpy(zero_copy_only=False)).astype(float))
            code = bits.astype(np.int64) @ (1 << np.arange(bits.shape[1], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(code)], names=["uid", "code"])

    return vectors.select("uid", "vec").mapInArrow(run, "uid string, code long")


def hash_index(codes: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """code -> uids; with an old index only uids that it lacks are added."""
    if old is not None:
        known = old.select(F.explode("uids").alias("uid"))
        codes = codes.join(known, "uid", "left_anti").unionByName(old.select(F.explode("uids").alias("uid"), "code"))
    return codes.groupBy("code").agg(F.array_sort(F.collect_set("uid")).alias("uids"))


def hamming_topn(codes: DataFrame, queries: DataFrame, n: int, bits: int | None = None) -> DataFrame:
    """All uids of the n nearest distinct codes of each query (query_id, qcode), equal distances by code.

    bits: the width of the codes; None: up to the highest bit that any code has, as a part that is 0 in all codes tells nothing.
    """
    codes = stored(codes.select("uid", "code"), "codes")
    count, used = codes.agg(F.count_distinct("code"), F.bit_or("code")).first()
    cut = hashing.parts(bits or _width(used or 0), count)
    index = stored(hashing.sub_codes(codes, cut), "sub-codes")
    return hashing.nearest_codes(index, cut, queries, n).join(codes, "code").select("query_id", "uid", "code", "distance", "rank")


def _width(code: int) -> int:
    """The bits up to the highest one of a long; below zero that is its sign."""
    return hashing.BITS if code < 0 else max(1, code.bit_length())


def knn_lsh(vectors: DataFrame, codes: DataFrame, queries: DataFrame, query_codes: DataFrame, k: int, multiplier: int = 10) -> DataFrame:
    """Candidates by code (k x multiplier codes), ranked by exact distance."""
    cand = hamming_topn(codes, query_codes, k * multiplier).select("query_id", "uid")
    j = cand.join(vectors.select("uid", "vec"), "uid").join(queries.select("query_id", "qvec"), "query_id")
    return ranked(j.select("query_id", "uid", V.euclidean(F.col("vec"), F.col("qvec")).alias("distance")), "query_id", k)


def working_set(exemplars: DataFrame, neighbours: DataFrame) -> DataFrame:
    return exemplars.select("uid").union(neighbours.select("uid")).distinct()


def auto_negatives(vectors: DataFrame, positives: DataFrame, r: int) -> DataFrame:
    """For each positive in order of uid the r farthest vectors by histogram intersection that none before took.

    All positives ask at once for their best r; a vector stays with the first positive that asks for it, and the
    others ask for their next ones, until nobody is turned down. That gives what taking turns gives, as every
    vector goes to the first in the order that comes to want it. Who has run out of candidates gets a longer list.
    """
    free = vectors.join(positives.select("uid"), "uid", "left_anti")
    n, k = free.count(), 4 * r
    while True:
        far = stored(knn(free, positives.selectExpr("uid AS query_id", "vec AS qvec"), k, "farthest").select(F.col("query_id").alias("pos"), "uid", "rank"), "farthest")
        left = far
        while True:
            nth = F.row_number().over(Window.partitionBy("pos").orderBy("rank"))
            asked = left.withColumn("nth", nth).where(F.col("nth") <= r).withColumn("first", F.min("pos").over(Window.partitionBy("uid")))
            asked = stored(asked, "asked")
            lost = asked.where("pos <> first").select("pos", "uid")
            if lost.isEmpty():
                break
            left = stored(left.join(lost, ["pos", "uid"], "left_anti"), "candidates")
        short = asked.groupBy("pos").agg(F.count("*").alias("n")).where(F.col("n") < r)
        if k >= n or (short.isEmpty() and asked.select("pos").distinct().count() == positives.count()):
            return asked.select("pos", "uid")
        k *= 4


#: Similarity by distance, as a share.
SIMILARITIES = {"euclidean": lambda d: 1 / (1 + d), "cosine": lambda d: 1 - d, "intersection": lambda d: 1 - d}


def rank_by_similarity(vectors: DataFrame, positives: DataFrame, negatives: DataFrame | None = None, distance: str = "intersection") -> DataFrame:
    """Mean similarity to the positives; exemplars are forced to 1 and 0.

    The sum of intersections is one of each component, told by its place among those of the positives: no pairs are made.
    """
    d = DISTANCES[distance](F.col("vec"), F.col("qvec"))

    def pairs(some: DataFrame, vectors: DataFrame = vectors) -> DataFrame:
        return vectors.join(some).groupBy("uid").agg(F.sum(SIMILARITIES[distance](d)).alias("s"), F.count("*").alias("n"))

    def sums(some: DataFrame) -> DataFrame:
        whole = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
        size, most, ok = some.agg(F.min(F.size("qvec")), F.max(F.size("qvec")), F.bool_and(whole("qvec"))).first()
        if distance != "intersection" or not ok or not 0 < size == most:
            return pairs(some)
        plain = whole("vec") & (F.size("vec") == size)  # others, which are few, meet the positives one by one
        plain = F.coalesce(plain, F.lit(False))
        return _intersection_sums(vectors.where(plain), some).unionByName(pairs(some, vectors.where(~plain)))

    s = _in_blocks(positives.selectExpr("uid AS pos", "vec AS qvec"), sums, "pos").groupBy("uid").agg((F.sum("s") / F.sum("n")).alias("score"))
    return forced(s, positives, negatives)


def _intersection_sums(vectors: DataFrame, positives: DataFrame) -> DataFrame:
    """uid, s and n: the sum of intersections with the positives (qvec; at most MOST_QUERIES), and their number; all of one length, without nulls and NaN."""
    rows = positives.select("qvec").toArrow().column("qvec").combine_chunks()
    n, matrix = len(rows), lambda c: c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(c), -1)
    ordered = np.sort(matrix(rows), axis=0)
    below = np.vstack([np.zeros((1, ordered.shape[1])), np.cumsum(ordered, axis=0)])

    def run(batches):
        for b in batches:
            s = np.zeros(b.num_rows)
            for j, x in enumerate(matrix(b.column("vec")).T if b.num_rows else ()):
                at = np.searchsorted(ordered[:, j], x, side="right")
                s += below[at, j] + np.where(at < n, x, 0) * (n - at)
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(s), pa.array(np.full(b.num_rows, n))], names=["uid", "s", "n"])

    return vectors.select("uid", "vec").mapInArrow(run, f"uid {vectors.schema['uid'].dataType.simpleString()}, s double, n long")


def forced(scores: DataFrame, positives: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """Scores with those of the exemplars set to 1 and 0."""
    s = scores.join(positives.select("uid", F.lit(1.0).alias("p")), "uid", "left")
    if negatives is not None:
        s = s.join(negatives.select("uid", F.lit(0.0).alias("q")), "uid", "left").withColumn("p", F.coalesce("p", "q")).drop("q")
    return s.select("uid", F.coalesce("p", "score").alias("score"))


def turned(scores: DataFrame, positives: DataFrame) -> DataFrame:
    """Scores between 0 and 1, turned round (1 - score) where the positives' mean is below that of all: a model may have its labels the other way."""
    s = scores.join(positives.select("uid", F.lit(True).alias("p")), "uid", "left")
    means = s.agg(F.avg("score").alias("all"), F.avg(F.when(F.col("p"), F.col("score"))).alias("pos"))  # one row
    return s.crossJoin(F.broadcast(means)).select("uid", F.when(F.col("pos") < F.col("all"), 1 - F.col("score")).otherwise(F.col("score")).alias("score"))


def rank_by_classifier(vectors: DataFrame, positives: list[str], negatives: list[str], kind: str = "svm") -> DataFrame:
    """Scores of a linear classifier, or of boosted trees, fitted to the exemplars."""
    from pyspark.ml.classification import GBTClassifier, LinearSVC
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = vectors.select("uid", array_to_vector(F.transform("vec", lambda v: v.cast("double"))).alias("features"))
    label = F.when(F.col("uid").isin(positives), 1.0).when(F.col("uid").isin(negatives), 0.0)
    train = x.withColumn("label", label).where("label IS NOT NULL")
    model = (LinearSVC(maxIter=20, regParam=0.01) if kind == "svm" else GBTClassifier(maxIter=5, seed=1)).fit(train)
    return model.transform(x).select("uid", vector_to_array("rawPrediction")[1].alias("score"))


def feedback_order(scores: DataFrame, n: int, boundary: float | None = 0.5) -> DataFrame:
    """The rows to ask about first: nearest to the boundary, or without a model from the middle rank outward.

    From the middle, ranks by falling score above and below it take turns, those above first; the middle row itself comes last.
    Only rows whose scores lie between two exact ranks are sorted.
    """
    if boundary is not None:
        d = scores.select("uid", "score", F.abs(F.col("score") - boundary).alias("d"))
        return d.orderBy("d", "uid").limit(n).withColumn("rank", F.row_number().over(Window.orderBy("d", "uid")))
    total = scores.count()
    mid, reach = total // 2, n // 2 + 1
    ends = quantiles.at_ranks(scores, -F.col("score"), {"a": lambda c: F.greatest(F.lit(0), F.lit(mid - reach)), "b": lambda c: F.least(F.lit(mid + reach), c - 1)}, []).first() if total else None
    if ends is None:
        return scores.select("uid", "score", F.lit(0.0).alias("d"), F.lit(0).alias("rank")).limit(0)
    band = scores.where((-F.col("score") >= ends["a"]) & (-F.col("score") <= ends["b"])).select("uid", "score")
    before = scores.where(-F.col("score") < ends["a"]).count()
    p = F.row_number().over(Window.orderBy(F.desc("score"), "uid")) - 1 + before  # about n rows, and those that equal the ends
    place = F.when(p < mid, 2 * (mid - p) - 1).when(p > mid, 2 * (p - mid)).otherwise(total)
    d = band.withColumn("d", place.cast("double"))
    return d.orderBy("d").limit(n).withColumn("rank", F.row_number().over(Window.orderBy("d")))


def feedback_scores(ordered: DataFrame, most: int) -> DataFrame:
    """Relevancy falling from 1 to 0 over the ranks of the rows returned."""
    n = F.count("*").over(Window.partitionBy())
    return ordered.where(F.col("rank") <= most).withColumn("relevancy", F.when(n > 1, 1 - (F.col("rank") - 1) / (n - 1)).otherwise(1.0))


def top_rows(df: DataFrame, key: str, n: int, score: str) -> DataFrame:
    """The n rows of each key with the largest scores, ties by uid: each task keeps n per key, what is left of all tasks is merged.

    For few keys and small n: a task holds n rows of each key at most.
    """
    import pandas as pd

    schema, columns = df.schema, df.columns

    def cut(d: pd.DataFrame) -> pd.DataFrame:
        return d.sort_values([score, "uid"], ascending=[False, True], kind="stable").groupby(key, sort=False).head(n)

    def some(batches):
        held = []
        for b in batches:
            held = [cut(pd.concat([*held, b]))]
        yield from held

    return df.mapInPandas(some, schema).groupBy(key).applyInPandas(lambda d: cut(d)[columns], schema)


def category_models(vectors: DataFrame, labels: list[str] | None = None, most_pos: int = 75, most_neg: int = 750, neighbours_only: bool = False, rerank: bool = True, background: str = "background", distance: str = "euclidean") -> DataFrame:
    """Linear one-against-rest weights of every label of (uid, label, vec), with hard negatives found in the whole table.

    Positives: at most most_pos of a label, by hash. Their nearest neighbours among all vectors (most_neg / most_pos each, at
    least 2) that have another label are the candidates. Of these the nearest to the positives' mean, half of most_neg,
    fit a first model; its highest false scores among the candidates, again as many, are the hard negatives. They and as
    many others by hash fit the model. neighbours_only: no others, and twice as many neighbours and hard negatives.
    rerank: whether the first model chooses. Vectors count as unit vectors; no model is made for the background.

    All labels go together: neighbours of all positives in blocks of queries over one scan each, and then a group of
    bounded size per label.
    """
    hashed = F.xxhash64("uid").cast("double")
    unit = F.transform("vec", lambda x: x.cast("double") / F.greatest(V.norm(F.col("vec")), F.lit(1e-300)))
    rows = vectors.select(F.col("uid").cast("string").alias("uid"), F.col("label").cast("string").alias("label"), unit.alias("vec"), (-hashed).alias("h"))
    rows = stored(rows.where("uid IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL"), "labelled")
    mine = rows.where(F.col("label") != background)
    mine = mine if labels is None else mine.where(F.col("label").isin(labels))
    positives = stored(top_rows(mine, "label", most_pos, "h"), "positives")
    seeds = max(2, most_neg // most_pos * (2 if neighbours_only else 1))
    hard = most_neg if neighbours_only else most_neg // 2
    near = knn(rows, positives.selectExpr("uid AS query_id", "vec AS qvec"), seeds, distance).select("query_id", "uid")
    near = near.join(positives.selectExpr("uid AS query_id", "label AS model"), "query_id").select("model", "uid").distinct()
    candidates = near.join(rows, "uid").where("label <> model").select("model", "uid", "vec", "h", F.lit(0).alias("kind"))
    sample = positives.select(F.col("label").alias("model"), "uid", "vec", "h", F.lit(1).alias("kind")).unionByName(candidates)
    if not neighbours_only:
        # of all labels' rows the first by hash; a label finds most_neg that aren't its own among them, or all there are
        first = top_rows(rows, "label", most_neg, "h")
        names = positives.select(F.col("label").alias("model")).distinct()  # one row per label
        sample = sample.unionByName(top_rows(first.join(names, F.col("label") != F.col("model")).select("model", "uid", "vec", "h", F.lit(2).alias("kind")), "model", most_neg, "h"))

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("uid", kind="stable")
        take = lambda d: np.c_[np.stack(d.vec.to_numpy()).astype(float), np.ones(len(d))] if len(d) else np.empty((0, dim))
        dim = len(pdf.vec.iloc[0]) + 1
        pos, cand, more = (pdf[pdf.kind == k] for k in (1, 0, 2))
        x, c = take(pos), take(cand)
        chosen = np.argsort(-(c @ np.r_[x[:, :-1].mean(0), 0.0]), kind="stable")[:hard] if len(x) else []
        if rerank and len(chosen):
            w = _squared_hinge(np.concatenate([x, c[chosen]]), np.r_[np.ones(len(x)), -np.ones(len(chosen))])
            chosen = np.argsort(-(c @ w), kind="stable")[:hard]
        taken = set(cand.uid.iloc[chosen])
        more = more[~more.uid.isin(taken)].sort_values(["h", "uid"], ascending=[False, True], kind="stable").head(most_neg // 2)
        negatives = np.concatenate([c[chosen], take(more)])
        if not len(x) or not len(negatives):
            return pd.DataFrame({"model": [], "bias": [], "weights": []})
        w = _squared_hinge(np.concatenate([x, negatives]), np.r_[np.ones(len(x)), -np.ones(len(negatives))])
        return pd.DataFrame({"model": [str(pdf.model.iloc[0])], "bias": [float(w[-1])], "weights": [w[:-1].tolist()]})

    return sample.groupBy("model").applyInPandas(fit, "model string, bias double, weights array<double>")


def _squared_hinge(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, steps: int = 30) -> np.ndarray:
    """Weights of a linear classifier (the last one the bias, unpenalised) by Newton steps on the rows inside the margin."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty * len(y)] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        inside = y * (x @ w) < 1
        a = x[inside]
        new = np.linalg.solve(a.T @ a + ridge, a.T @ y[inside])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def apply_models(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """The best model and score of every vector; models are a table with one row per label."""
    s = vectors.join(F.broadcast(models)).select("uid", "model", (V.dot(F.col("vec"), F.col("weights")) + F.col("bias")).alias("score"))
    return s.groupBy("uid").agg(F.max_by("model", F.struct("score", "model")).alias("model"), F.max("score").alias("score"))


def lookup(asked: DataFrame, vectors: DataFrame, missing: str = "null") -> DataFrame:
    """The vectors of asked uids; missing ones stay as nulls ("null"), are left out ("skip") or stop the job when they are met ("error")."""
    j = asked.join(vectors, "uid", "inner" if missing == "skip" else "left")
    return j.where(F.assert_true(F.col("vec").isNotNull(), F.concat(F.lit("no vector of "), "uid")).isNull()) if missing == "error" else j


def attach(states: DataFrame, vectors: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """States of tracks (seq_id, track_id, frame_id) with their vectors: by a column uid of their own, or by a table from them to uid."""
    states = states if mapping is None else states.join(mapping, ["seq_id", "track_id", "frame_id"])
    return states.join(vectors, "uid")


def histories(states: DataFrame, *columns: str) -> DataFrame:
    """Each track with the list of its states in order of frames (h: frame_id, det_id and the columns) and their number n."""
    return states.groupBy("seq_id", "track_id").agg(F.array_sort(F.collect_list(F.struct("frame_id", "det_id", *columns))).alias("h"), F.count("*").alias("n"))


def above(results: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Results of at least a relevancy."""
    return results.where(F.col(score) >= least)


def selected_query(primary: DataFrame, fallback: DataFrame, key: str = "query_id") -> DataFrame:
    """The rows of the primary query of each key, and those of the fallback where it has none."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti").select(*primary.columns))


def results_as_tracks(results: DataFrame, history: DataFrame) -> DataFrame:
    """Boxes of the results' histories (uid) as tracks: new ids by rank from 0, the relevancy (score) as confidence."""
    ids = results.select("uid", "score", (F.row_number().over(Window.orderBy("rank", "uid")) - 1).alias("track_id"))  # one row per result
    return history.join(ids, "uid").withColumn("conf", F.col("score")).drop("score", "uid")
