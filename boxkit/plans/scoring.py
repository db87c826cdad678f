"""Queries of the scores; the SQL of those that match boxes is in folds.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as m
from ..operators import scoring as op
from ..registry import query
from .views import view, with_views

SEQ = ["seq_id"]


def _both(spark, sf):
    keep = ["seq_id", "frame_id", "det_id", "track_id", "x1", "y1", "x2", "y2", "conf", "cls"]
    return view(spark, sf, "computed").select(*keep), view(spark, sf, "truth").select(*keep)


def _matched(spark, sf):
    c, t = _both(spark, sf)
    return c, t, op.matched_boxes(c, t)


@query("score_detection")
def score_detection(spark, sf):
    return op.detection(*_both(spark, sf))


@query("score_localization")
def score_localization(spark, sf):
    return op.localization(_matched(spark, sf)[2], SEQ)


@query("score_mot")
def score_mot(spark, sf):
    return op.mot(*_both(spark, sf))


@query("id_switch")
def id_switch(spark, sf):
    _, t, mm = _matched(spark, sf)
    return op.id_events(mm, t)


@query("score_idf1")
def score_idf1(spark, sf):
    return op.idf1(*_matched(spark, sf))


@query("track_coverage")
def track_coverage(spark, sf):
    c, t, mm = _matched(spark, sf)
    return op.track_coverage(t, mm, c)


@query("score_hota")
def score_hota(spark, sf):
    return op.hota(*_both(spark, sf))


@query("score_kwant")
def score_kwant(spark, sf):
    c, t = _both(spark, sf)
    mm = op.matched_tracks(c, t)
    one = lambda df, side: op.kwant(df, mm, side).groupBy("seq_id").agg(F.avg("continuity").alias("continuity"), F.avg("purity").alias("purity"), F.avg((F.col("hits") > 0).cast("double")).alias("hit_share")).withColumn("side", F.lit(side))
    return one(c, "c").unionByName(one(t, "t"))


@query("score_track_quality")
def score_track_quality(spark, sf):
    _, t, mm = _matched(spark, sf)
    return op.track_quality(t, mm)


@query("score_ap")
def score_ap(spark, sf):
    return op.ap_over_thresholds(*_both(spark, sf))


@query("score_per_class")
def score_per_class(spark, sf):
    return op.per_class(*_both(spark, sf))


@query("score_cls_accuracy")
def score_cls_accuracy(spark, sf):
    return _matched(spark, sf)[2].groupBy("seq_id").agg(F.avg((F.col("c_cls") == F.col("t_cls")).cast("double")).alias("accuracy"))


def _curve(spark, sf):
    c, t = _both(spark, sf)
    return op.pr_curve(c, t, m.match_by_confidence(c, t), SEQ), c, t


@query("pr_curve")
def pr_curve(spark, sf):
    return _curve(spark, sf)[0]


@query("pr_best_f1")
def pr_best_f1(spark, sf):
    return _curve(spark, sf)[0].groupBy("seq_id").agg(F.max("f1").alias("f1"), F.max_by("conf", F.struct("f1", "conf")).alias("threshold"))


_POINTS = "(SELECT c_nationkey AS k, floor(c_acctbal / 100) AS c, count(*) AS n FROM customer GROUP BY ALL)"


@query("ap_11pt", f"""WITH p AS (SELECT k, 1 - (c + 10) / 200.0::DOUBLE AS recall, 0.2::DOUBLE + (n % 7) / 10.0::DOUBLE AS precision FROM {_POINTS}),
r AS (SELECT i / 10.0::DOUBLE AS r FROM range(11) t(i)), b AS (SELECT k, r, max(precision) AS p FROM p, r WHERE recall >= r GROUP BY k, r)
SELECT k, round(sum(p) / 11, 9) AS ap11 FROM b GROUP BY k""")
def ap_11pt(spark, sf):
    pts = view(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k"), F.floor(F.col("c_acctbal") / 100).alias("c")).agg(F.count("*").alias("n"))
    pts = pts.selectExpr("k", "1 - (c + 10) / 200.0D AS recall", "0.2D + (n % 7) / 10.0D AS precision")
    return op.ap_11pt(pts, ["k"]).withColumn("ap11", F.round("ap11", 9))


@query("roc_curve")
def roc_curve(spark, sf):
    curve, c, t = _curve(spark, sf)
    return op.roc(curve, c.select("seq_id", "frame_id").unionByName(t.select("seq_id", "frame_id")).distinct(), SEQ)


@query("confusion")
def confusion(spark, sf):
    c, t = _both(spark, sf)
    return op.confusion(c, t, m.match_greedy(c, t))


@query("score_histograms")
def score_histograms(spark, sf):
    c, _, mm = _matched(spark, sf)
    k = op.kwant(c, mm, "c")
    one = lambda df, col, bins: op.histogram(df, col, bins).withColumn("what", F.lit(col))
    return one(mm, "iou", 20).unionByName(one(k, "purity", 10)).unionByName(one(k, "continuity", 10))


@query("threshold_sweep")
def threshold_sweep(spark, sf):
    return op.best_of_sweep(op.threshold_sweep(*_both(spark, sf)))


@query("filter_from_sweep")
def filter_from_sweep(spark, sf):
    """Thresholds per sequence from a sweep, and the default."""
    best = op.best_of_sweep(op.threshold_sweep(*_both(spark, sf)))
    return op.filter_thresholds(best.withColumnRenamed("seq_id", "k"), "k")


@query("frame_universe", with_views("SELECT seq_id, frame_id FROM computed UNION SELECT seq_id, frame_id FROM truth"))
def frame_universe(spark, sf):
    c, t = _both(spark, sf)
    return c.select("seq_id", "frame_id").union(t.select("seq_id", "frame_id")).distinct()


@query("class_universe", with_views("SELECT cls FROM computed UNION SELECT cls FROM truth"))
def class_universe(spark, sf):
    c, t = _both(spark, sf)
    return c.select("cls").union(t.select("cls")).distinct()


@query("union_sets", with_views("SELECT det_id, cls FROM computed UNION ALL SELECT det_id, cls FROM truth"))
def union_sets(spark, sf):
    c, t = _both(spark, sf)
    return c.select("det_id", "cls").unionByName(t.select("det_id", "cls"))


@query("uncovered_names", with_views("SELECT 'f' || frame_id AS name, 'unrequested' AS kind FROM (SELECT DISTINCT frame_id FROM computed WHERE frame_id % 5 <> 0) UNION ALL SELECT 'f' || frame_id, 'without annotations' FROM (SELECT DISTINCT frame_id FROM truth WHERE frame_id % 5 = 0) t WHERE frame_id NOT IN (SELECT frame_id FROM computed)"))
def uncovered_names(spark, sf):
    c, t = _both(spark, sf)
    a = c.select(F.concat(F.lit("f"), "frame_id").alias("name")).distinct()
    b = t.where("frame_id % 5 = 0").select(F.concat(F.lit("f"), "frame_id").alias("name")).distinct()
    all5 = c.where("frame_id % 5 = 0").select(F.concat(F.lit("f"), "frame_id").alias("name")).distinct()
    return a.join(all5, "name", "left_anti").withColumn("kind", F.lit("unrequested")).unionByName(b.join(a, "name", "left_anti").withColumn("kind", F.lit("without annotations")))


@query("id_intersection", with_views("SELECT seq_id, frame_id FROM computed WHERE track_id = 1 INTERSECT SELECT seq_id, frame_id FROM computed WHERE track_id = 2"))
def id_intersection(spark, sf):
    c = _both(spark, sf)[0]
    one = lambda k: c.where(F.col("track_id") == k).select("seq_id", "frame_id")
    return one(1).intersect(one(2))
