"""Queries of suppression and fusion: three models are cut from the computed boxes by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion as op
from ..operators import matching as m
from ..registry import query
from ..shared import stored
from .joins import INTER, IOU
from .views import view, with_views

MODELS = ["m0", "m1", "m2"]
W = {"m0": 1.0, "m1": 0.8, "m2": 0.5}


def _m(spark, sf):
    """Boxes of three models: shifted copies of the computed ones."""
    c = view(spark, sf, "computed").select("seq_id", "frame_id", "det_id", "track_id", "x1", "y1", "x2", "y2", "conf", "cls")
    out = None
    for i in range(3):
        d = c.where(f"det_id % 5 <> {i}").withColumn("model", F.lit(f"m{i}")).withColumn("model_no", F.lit(i)).withColumn("det_id", F.col("det_id") * 4 + i)
        d = d.withColumns({k: F.col(k) + 2.0 * i for k in ("x1", "x2")}).withColumn("conf", F.col("conf") * (1 - 0.05 * i))
        out = d if out is None else out.unionByName(d)
    return out


_SQL_M = "(" + " UNION ALL ".join(f"SELECT seq_id, frame_id, det_id * 4 + {i} AS det_id, x1 + {2.0 * i} AS x1, y1, x2 + {2.0 * i} AS x2, y2, conf * (1 - {0.05 * i}::DOUBLE) AS conf, cls, 'm{i}' AS model FROM computed WHERE det_id % 5 <> {i}" for i in range(3)) + ")"


@query("nms")
def nms(spark, sf):
    return op.nms(view(spark, sf, "computed"), 0.5, 4.0)


@query("sort_by_conf", with_views("SELECT det_id, rank FROM (SELECT det_id, row_number() OVER (PARTITION BY seq_id, frame_id ORDER BY round(conf, 6) DESC, det_id) AS rank FROM computed) WHERE rank <= 5"))
def sort_by_conf(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("seq_id", "frame_id").orderBy(F.desc(F.round("conf", 6)), "det_id")
    return view(spark, sf, "computed").select("det_id", F.row_number().over(w).alias("rank")).where("rank <= 5")


@query("fuse_nms")
def fuse_nms(spark, sf):
    return op.fuse_nms(_m(spark, sf), 0.5, 0.2, W)


@query("fuse_soft_nms")
def fuse_soft_nms(spark, sf):
    return op.fuse_soft_nms(_m(spark, sf), 0.5, 0.05, W)


@query("fuse_nmw")
def fuse_nmw(spark, sf):
    return op.fuse_nmw(_m(spark, sf), 0.5)


@query("fuse_wbf")
def fuse_wbf(spark, sf):
    return op.fuse_wbf(_m(spark, sf), 0.5, 3, W)


@query("fuse_proben")
def fuse_proben(spark, sf):
    return op.fuse_proben(_m(spark, sf), 0.5, ["A", "N", "R", "X"], W, 0.2).drop("scores")


@query("contributors", with_views(f"SELECT c_id, model, t_id, round(iou, 6) AS iou FROM (SELECT c.det_id AS c_id, t.model, t.det_id AS t_id, {IOU} AS iou, row_number() OVER (PARTITION BY c.det_id, t.model ORDER BY {IOU} DESC, t.det_id) AS rn FROM truth c JOIN {_SQL_M} t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id AND c.cls = t.cls WHERE {INTER} > 0) WHERE rn = 1"))
def contributors(spark, sf):
    return op.contributors(view(spark, sf, "truth"), _m(spark, sf)).select(F.col("c_det_id").alias("c_id"), F.col("t_model").alias("model"), F.col("t_det_id").alias("t_id"), F.round("iou", 6).alias("iou"))


@query("pseudonyms", with_views(f"WITH b AS (SELECT c.det_id, t.cls, row_number() OVER (PARTITION BY c.det_id ORDER BY {IOU} DESC, t.det_id) AS rn FROM {_SQL_M} c JOIN {_SQL_M} t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id AND c.model <> t.model AND c.cls = 'X' AND t.cls IN ('A', 'R') WHERE {IOU} > 0.3) SELECT m.det_id, coalesce(b.cls, m.cls) AS cls FROM {_SQL_M} m LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (det_id)"))
def pseudonyms(spark, sf):
    allowed = spark.createDataFrame([("X", "A"), ("X", "R")], "generic string, specific string")
    return op.pseudonyms(_m(spark, sf), allowed, 0.3).select("det_id", "cls")


@query("box_anchor", with_views(f"WITH b AS (SELECT c.det_id, t.x1, row_number() OVER (PARTITION BY c.det_id ORDER BY {IOU} DESC, t.det_id) AS rn, {IOU} AS iou FROM truth c JOIN {_SQL_M} t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id AND c.cls = t.cls AND t.model = 'm1' WHERE {INTER} > 0) SELECT c.det_id, coalesce(b.x1, c.x1) AS x1 FROM truth c LEFT JOIN (SELECT * FROM b WHERE rn = 1 AND iou > 0.5) b USING (det_id)"))
def box_anchor(spark, sf):
    return op.box_anchor(view(spark, sf, "truth").select("seq_id", "frame_id", "det_id", "x1", "y1", "x2", "y2", "cls"), _m(spark, sf), "m1", 0.5).select("det_id", "x1")


@query("cross_class_merge")
def cross_class_merge(spark, sf):
    return op.cross_class(_m(spark, sf), 0.6).drop("scores")


@query("stack_features", with_views(f"WITH c AS (SELECT * FROM (SELECT c.det_id, c.conf, t.model, t.conf AS tc, {IOU} AS iou, row_number() OVER (PARTITION BY c.det_id, t.model ORDER BY {IOU} DESC, t.det_id) AS rn FROM truth c JOIN {_SQL_M} t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id AND c.cls = t.cls WHERE {INTER} > 0) WHERE rn = 1) SELECT det_id, round(count(DISTINCT model) / 3, 6) AS agreement, round(avg(iou), 6) AS mean_iou, round(max(tc), 6) AS best, round(coalesce(max(tc) FILTER (model = 'm0'), 0), 6) AS m0, round(coalesce(max(tc) FILTER (model = 'm1'), 0), 6) AS m1, round(coalesce(max(tc) FILTER (model = 'm2'), 0), 6) AS m2 FROM c GROUP BY det_id"))
def stack_features(spark, sf):
    s = op.stack_features(view(spark, sf, "truth"), _m(spark, sf), MODELS)
    return s.select("det_id", *(F.round(k, 6).alias(k) for k in ("agreement", "mean_iou", "best", *MODELS)))


def _samples(spark, sf):
    """Boxes of all models with whether they match truth of their class."""
    b, t = _m(spark, sf), view(spark, sf, "truth")
    hit = m.iou_join(b, t, 0.5).where("c_cls = t_cls").select(F.col("c_det_id").alias("det_id"), F.lit(1.0).alias("hit")).distinct()
    return b.join(hit, "det_id", "left").fillna(0.0, ["hit"])


@query("calibrate_fit")
def calibrate_fit(spark, sf):
    return op.calibrate_fit(_samples(spark, sf))


_MAPS = "(VALUES ('m0', 'A', 0.4, 0.1), ('m0', 'A', 0.6, 0.5), ('m0', 'A', 0.9, 0.8), ('m0', '*', 0.3, 0.2), ('m0', '*', 0.8, 0.6), ('m1', '*', 0.5, 0.4), ('m1', '*', 0.7, 0.7))"


@query("calibrate_apply", with_views(f"""WITH k AS (SELECT model, cls, x::DOUBLE AS x, y::DOUBLE AS y, lead(x::DOUBLE) OVER w AS nx, lead(y::DOUBLE) OVER w AS ny, row_number() OVER w AS i FROM {_MAPS} v(model, cls, x, y) WINDOW w AS (PARTITION BY model, cls ORDER BY x)),
b AS (SELECT m.*, CASE WHEN m.model = 'm0' AND m.cls = 'A' THEN 'A' ELSE '*' END AS kc FROM {_SQL_M} m)
SELECT det_id, round(coalesce(k.y + CASE WHEN k.nx IS NOT NULL AND b.conf > k.x THEN (b.conf - k.x) / (k.nx - k.x) * (k.ny - k.y) ELSE 0 END, b.conf), 6) AS conf
FROM b LEFT JOIN k ON k.model = b.model AND k.cls = b.kc AND (b.conf >= k.x OR k.i = 1) AND (k.nx IS NULL OR b.conf < k.nx)"""))
def calibrate_apply(spark, sf):
    maps = spark.createDataFrame([("m0", "A", 0.4, 0.1), ("m0", "A", 0.6, 0.5), ("m0", "A", 0.9, 0.8), ("m0", "*", 0.3, 0.2), ("m0", "*", 0.8, 0.6), ("m1", "*", 0.5, 0.4), ("m1", "*", 0.7, 0.7)], "model string, cls string, x double, y double")
    return op.calibrate_apply(_m(spark, sf), maps).select("det_id", F.round("conf", 6).alias("conf"))


@query("rescore_fit")
def rescore_fit(spark, sf):
    # written once: it is counted, fitted and scored
    s = stored(_samples(spark, sf).select("det_id", "conf", F.expr("(x2 - x1) * (y2 - y1) / 1000").alias("area"), "hit"), "samples")
    w = op.rescore_fit(s, ["conf", "area"])
    return op.rescore_apply(s, ["conf", "area"], w).select("det_id", "score")


@query("rescore_apply", with_views("SELECT det_id, round(1 / (1 + exp(-(-1.0 + conf * 2.5 + (x2 - x1) * 0.01))), 6) AS score FROM computed"))
def rescore_apply(spark, sf):
    c = view(spark, sf, "computed").withColumn("w", F.expr("x2 - x1"))
    return op.rescore_apply(c, ["conf", "w"], [-1.0, 2.5, 0.01]).select("det_id", F.round("score", 6).alias("score"))


@query("fusion_sweep")
def fusion_sweep(spark, sf):
    """Parameters of fusion by average precision: a grid, seeded weights, and refinement."""
    t = view(spark, sf, "truth").select("seq_id", "frame_id", "det_id", "x1", "y1", "x2", "y2", "conf", "cls")
    out = op.sweep(_m(spark, sf), t, MODELS)
    return out.withColumn("weights", F.array_join(F.transform("weights", lambda w: w.cast("string")), ",")).withColumn("ap", F.round("ap", 9))


@query("fuse_tracks")
def fuse_tracks(spark, sf):
    return op.fuse_tracks(_m(spark, sf), weights={"m0": 2.0}, least_frames=3).withColumn("scores", F.array_join(F.transform(F.map_entries("scores"), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"], 6).cast("string"))), ","))


@query("avg_classification", with_views("""WITH c AS (SELECT *, det_id % 3 = 0 AS lone FROM computed), e AS (SELECT seq_id, track_id, conf, cls, conf AS s FROM c WHERE NOT lone UNION ALL SELECT seq_id, track_id, conf, 'other', (1 - conf) / 2 FROM c WHERE NOT lone),
t AS (SELECT seq_id, track_id, avg(conf) AS mean, sum(conf) AS mass, coalesce(sum(conf) FILTER (lone), 0) AS lone_mass, coalesce(sum(conf) FILTER (NOT lone), 0) AS rest FROM c GROUP BY ALL)
SELECT seq_id, track_id, cls, round((0.1 + 0.9 * any_value(mean)) * sum(s * conf) / any_value(CASE WHEN lone_mass > 0 THEN rest ELSE mass END), 9) AS score FROM e JOIN t USING (seq_id, track_id) GROUP BY seq_id, track_id, cls
UNION ALL SELECT seq_id, track_id, 'none', round((0.1 + 0.9 * avg(conf)) * sum(0.5 * conf) / sum(conf), 9) FROM c GROUP BY seq_id, track_id HAVING bool_and(lone)"""))
def avg_classification(spark, sf):
    """Every third box is of the ignored class alone."""
    mixed = F.create_map(F.col("cls"), F.col("conf"), F.lit("other"), (1 - F.col("conf")) / 2)
    c = view(spark, sf, "computed").withColumn("scores", F.when(F.col("det_id") % 3 == 0, F.create_map(F.lit("none"), F.lit(0.5))).otherwise(mixed))
    return op.mean_distribution(c, "none").withColumn("score", F.round("score", 9))
