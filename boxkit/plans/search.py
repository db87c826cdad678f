"""Queries of descriptor search. The query set is every vector whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hashing
from ..operators import search as op
from ..registry import query
from ..shared import shared_path
from .views import view, with_views


def _v(spark, sf):
    return view(spark, sf, "descriptors")


def _q(spark, sf):
    return _v(spark, sf).where("CAST(uid AS LONG) % 100 = 0").select(F.col("uid").alias("query_id"), F.col("vec").alias("qvec"))


def _hist(spark, sf):
    """Vectors as histograms: absolute values of unit sum."""
    return _v(spark, sf).withColumn("vec", F.transform("vec", lambda x: F.abs(x.cast("double")))).withColumn("vec", F.expr("transform(vec, x -> x / aggregate(vec, 0D, (s, y) -> s + y))"))


_Q = "(SELECT uid AS query_id, vec AS qvec FROM descriptors WHERE uid::BIGINT % 100 = 0)"


@query("knn_exact", with_views(f"SELECT query_id, uid, rank, round(d, 5) AS distance FROM (SELECT query_id, uid, d, row_number() OVER (PARTITION BY query_id ORDER BY d, uid) AS rank FROM (SELECT query_id, uid, list_distance(vec::DOUBLE[], qvec::DOUBLE[]) AS d FROM descriptors, {_Q} q)) WHERE rank <= 10"))
def knn_exact(spark, sf):
    return op.knn(_v(spark, sf), _q(spark, sf), 10).withColumn("distance", F.round("distance", 5))


@query("knn_cosine", with_views(f"SELECT query_id, uid, rank, round(d, 5) AS distance FROM (SELECT query_id, uid, d, row_number() OVER (PARTITION BY query_id ORDER BY d, uid) AS rank FROM (SELECT query_id, uid, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(vec::DOUBLE[], qvec::DOUBLE[])))) / pi() AS d FROM descriptors, {_Q} q WHERE uid <> query_id)) WHERE rank <= 5"))
def knn_cosine(spark, sf):
    out = op.knn(_v(spark, sf), _q(spark, sf), 6, "cosine").where("uid <> query_id")
    from pyspark.sql.window import Window

    w = Window.partitionBy("query_id").orderBy("distance", "uid")
    return out.withColumn("rank", F.row_number().over(w)).where("rank <= 5").withColumn("distance", F.round("distance", 5))


@query("knn_sampled")
def knn_sampled(spark, sf):
    return op.knn_sampled(_v(spark, sf), _q(spark, sf), 5, 400, 0.5)


def _codes(spark, sf):
    return op.itq_hash(_v(spark, sf), op.itq_fit(_v(spark, sf), 16, 5))


@query("itq_hash")
def itq_hash(spark, sf):
    return _codes(spark, sf)


#: Codes by the sign of all 64 components: these need no fit, so SQL can give them.
_BITS = " + ".join(f"CASE WHEN vec[{i + 1}] > 0 THEN {1 << i if i < 63 else -(1 << 63)} ELSE 0 END" for i in range(64))
_CODES = f"(SELECT uid, ({_BITS})::BIGINT AS code FROM descriptors)"


def _signs(spark, sf):
    code = F.expr("aggregate(transform(vec, (x, i) -> CASE WHEN x > 0 THEN shiftleft(1L, i) ELSE 0L END), 0L, (s, b) -> s | b)")
    return _v(spark, sf).select("uid", code.alias("code"))


@query("hash_index", with_views(f"SELECT code, string_agg(uid, ',' ORDER BY uid) AS uids FROM {_CODES} GROUP BY code"))
def hash_index(spark, sf):
    c = _signs(spark, sf)
    old = op.hash_index(c.where("CAST(uid AS LONG) % 2 = 0"))
    return op.hash_index(c, old).select("code", F.array_join("uids", ",").alias("uids"))


_NEAR_CODES = with_views(f"WITH d AS MATERIALIZED {_CODES} SELECT query_id, uid, code, distance::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, code) AS rank FROM (SELECT q.uid AS query_id, c.code, bit_count(xor(c.code, q.code)) AS distance FROM (SELECT DISTINCT code FROM d) c, (SELECT * FROM d WHERE uid::BIGINT % 100 = 0) q)) JOIN d USING (code) WHERE rank <= 20")


def _code_queries(c):
    return c.where("CAST(uid AS LONG) % 100 = 0").selectExpr("uid AS query_id", "code AS qcode")


@query("hamming_topn", _NEAR_CODES)
def hamming_topn(spark, sf):
    c = _signs(spark, sf)
    return op.hamming_topn(c, _code_queries(c), 20).select("query_id", "uid", "code", "distance")


@query("hash_index_stored", _NEAR_CODES)
def hash_index_stored(spark, sf):
    """The same from a stored index, to which a half of the codes was added later, twice."""
    c, path = _signs(spark, sf), shared_path(spark, "hash-index")
    hashing.write_index(c.where("CAST(uid AS LONG) % 2 = 0"), path)
    for _ in range(2):
        hashing.add_to_index(c, path)
    return hashing.search_index(spark, path, _code_queries(c), 20, few_pairs=0).select("query_id", "uid", "code", "distance")


@query("knn_lsh")
def knn_lsh(spark, sf):
    c = _codes(spark, sf)
    q = c.where("CAST(uid AS LONG) % 100 = 0").selectExpr("uid AS query_id", "code AS qcode")
    return op.knn_lsh(_v(spark, sf), c, _q(spark, sf), q, 5)


@query("working_set", with_views(f"SELECT DISTINCT uid FROM (SELECT query_id AS uid FROM {_Q} UNION ALL SELECT uid FROM (SELECT uid, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(vec::DOUBLE[], qvec::DOUBLE[]), uid) AS rank FROM descriptors, {_Q} q) WHERE rank <= 10)"))
def working_set(spark, sf):
    q = _q(spark, sf)
    return op.working_set(q.selectExpr("query_id AS uid"), op.knn(_v(spark, sf), q, 10))


_HIST = "(SELECT uid, list_transform(vec, lambda x: abs(x::DOUBLE) / list_sum(list_transform(vec, lambda y: abs(y::DOUBLE)))) AS vec FROM descriptors)"
_SIM = "list_sum(list_transform(list_zip(h.vec, p.vec), lambda z: least(z[1], z[2])))"


@query("auto_negatives")
def auto_negatives(spark, sf):
    h = _hist(spark, sf)
    return op.auto_negatives(h, h.where("CAST(uid AS LONG) % 100 = 0"), 3)


@query("rank_similarity", with_views(f"SELECT h.uid, round(CASE WHEN h.uid::BIGINT % 100 = 0 THEN 1.0 ELSE avg({_SIM}) END, 6) AS score FROM {_HIST} h, (SELECT * FROM {_HIST} WHERE uid::BIGINT % 100 = 0) p GROUP BY h.uid"))
def rank_similarity(spark, sf):
    h = _hist(spark, sf)
    return op.rank_by_similarity(h, h.where("CAST(uid AS LONG) % 100 = 0")).withColumn("score", F.round("score", 6))


_TURN = "(1 / (1 + exp(vec[1]::DOUBLE * 4)))"


@query("rank_turned", with_views(f"WITH s AS (SELECT uid, {_TURN} AS score, uid::BIGINT % 100 = 0 AS p FROM descriptors), b AS (SELECT uid FROM (SELECT uid, row_number() OVER (ORDER BY vec[1]::DOUBLE DESC, uid) AS rank FROM descriptors) WHERE rank <= 20), m AS (SELECT avg(score) AS every, avg(score) FILTER (uid IN (SELECT uid FROM b)) AS pos FROM s) SELECT uid, round(CASE WHEN uid IN (SELECT uid FROM b) THEN 1.0 WHEN p THEN 0.0 WHEN pos < every THEN 1 - score ELSE score END, 9) AS score FROM s, m"))
def rank_turned(spark, sf):
    """Scores of a model that has its labels the other way, turned round; exemplars are forced."""
    v = _v(spark, sf).withColumn("first", F.col("vec")[0].cast("double"))
    pos = v.orderBy(F.desc("first"), "uid").limit(20)
    neg = v.where("CAST(uid AS LONG) % 100 = 0").join(pos.select("uid"), "uid", "left_anti")
    s = v.select("uid", (1 / (1 + F.exp(F.col("first") * 4))).alias("score"))
    return op.forced(op.turned(s, pos), pos, neg).withColumn("score", F.round("score", 9))


@query("rank_svm")
def rank_svm(spark, sf):
    pos, neg = [str(i * 10) for i in range(20)], [str(i * 10 + 5) for i in range(40)]
    return op.rank_by_classifier(_v(spark, sf), pos, neg)


_SC = "(SELECT l_orderkey * 10 + l_linenumber AS uid, any_value((l_partkey * 7919 % 100003) / 100003.0::DOUBLE) AS score FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_partkey FROM lineitem) GROUP BY 1)"


def _scores(spark, sf):
    return view(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid")).agg(F.min("l_partkey").alias("p")).selectExpr("uid", "(p * 7919 % 100003) / 100003.0D AS score")


@query("feedback_order", f"SELECT uid, round(score, 6) AS score, row_number() OVER (ORDER BY abs(score - 0.5), uid) AS rank FROM {_SC} ORDER BY rank LIMIT 50")
def feedback_order(spark, sf):
    return op.feedback_order(_scores(spark, sf), 50).select("uid", F.round("score", 6).alias("score"), "rank")


@query("feedback_order_middle", f"WITH r AS (SELECT *, row_number() OVER (ORDER BY score DESC, uid) - 1 AS p, count(*) OVER () AS n FROM {_SC}), o AS (SELECT *, CASE WHEN p < n // 2 THEN 2 * (n // 2 - p) - 1 WHEN p > n // 2 THEN 2 * (p - n // 2) ELSE n END AS o FROM r) SELECT uid, round(score, 6) AS score, row_number() OVER (ORDER BY o) AS rank FROM o ORDER BY rank LIMIT 50")
def feedback_order_middle(spark, sf):
    """Without a model: above and below the middle rank by turns."""
    return op.feedback_order(_scores(spark, sf), 50, None).select("uid", F.round("score", 6).alias("score"), "rank")


@query("feedback_scores", f"SELECT uid, rank, round(1 - (rank - 1) / 39.0, 6) AS relevancy FROM (SELECT uid, row_number() OVER (ORDER BY abs(score - 0.5), uid) AS rank FROM {_SC}) WHERE rank <= 40")
def feedback_scores(spark, sf):
    return op.feedback_scores(op.feedback_order(_scores(spark, sf), 50), 40).select("uid", "rank", F.round("relevancy", 6).alias("relevancy"))


@query("category_models")
def category_models(spark, sf):
    v = _v(spark, sf).withColumn("label", F.col("label").cast("string"))
    return op.category_models(v).select("model", "bias", F.posexplode("weights").alias("dim", "weight"))


@query("apply_category_models", with_views("WITH s AS (SELECT uid, m, vec[m + 1]::DOUBLE * 2 - vec[m + 2]::DOUBLE + 0.01 * m AS score FROM descriptors, range(3) r(m)) SELECT uid, 'c' || arg_max(m, score) AS model, round(max(score), 6) AS score FROM s GROUP BY uid"))
def apply_category_models(spark, sf):
    w = [[2.0 if d == m else -1.0 if d == m + 1 else 0.0 for d in range(64)] for m in range(3)]
    models = spark.createDataFrame([(f"c{m}", 0.01 * m, w[m]) for m in range(3)], "model string, bias double, weights array<double>")
    return op.apply_models(_v(spark, sf), models).withColumn("score", F.round("score", 6))


@query("query_threshold", f"SELECT uid, round(score, 6) AS score FROM {_SC} WHERE score >= 0.9")
def query_threshold(spark, sf):
    return op.above(_scores(spark, sf), 0.9).select("uid", F.round("score", 6).alias("score"))


@query("io_query_results_write", with_views("WITH r AS (SELECT uid, row_number() OVER (ORDER BY uid::BIGINT) - 1 AS track_id FROM descriptors WHERE uid::BIGINT % 50 = 0) SELECT r.track_id, c.frame_id, c.det_id, round(1.0 - r.track_id / 1000.0, 6) AS conf FROM r JOIN computed c ON (c.det_id // 10) % 1000 = r.uid::BIGINT"))
def io_query_results_write(spark, sf):
    """Results as tracks: new ids by rank, relevancy as confidence, boxes from the history."""
    r = _v(spark, sf).where("CAST(uid AS LONG) % 50 = 0").select(F.col("uid").cast("long").alias("uid")).withColumn("rank", F.col("uid") / 50 + 1).withColumn("score", 1.0 - (F.col("rank") - 1) / 1000)
    c = view(spark, sf, "computed").select(F.expr("det_id DIV 10 % 1000").alias("uid"), "frame_id", "det_id")
    return op.results_as_tracks(r, c).select("track_id", "frame_id", "det_id", F.round("conf", 6).alias("conf"))


@query("itq_fit")
def itq_fit(spark, sf):
    """The fitted projection, one row per dimension and bit, with the mean of the dimension."""
    model = op.itq_fit(_v(spark, sf), 16, 5)
    rows = [(d, b, float(model.mean[d]), float(model.projection[d, b])) for d in range(model.projection.shape[0]) for b in range(model.projection.shape[1])]
    return spark.createDataFrame(rows, "dim int, bit int, mean double, weight double")
