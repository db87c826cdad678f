"""Queries of the box joins and matchers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import footprints
from ..operators import matching as op
from ..operators import search, survey
from ..registry import query
from .views import view, with_views

INTER = "(greatest(0.0, least(c.x2, t.x2) - greatest(c.x1, t.x1)) * greatest(0.0, least(c.y2, t.y2) - greatest(c.y1, t.y1)))"
AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
IOU = f"({INTER} / ({AREA.format('c')} + {AREA.format('t')} - {INTER}))"
_PAIRS = f"SELECT c.seq_id, c.frame_id, c.det_id AS c_det_id, t.det_id AS t_det_id, {IOU} AS iou FROM computed c JOIN truth t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id WHERE {IOU} >= 0.5"
IDS = ["seq_id", "frame_id", "c_det_id", "t_det_id"]


def _both(spark, sf):
    return view(spark, sf, "computed"), view(spark, sf, "truth").drop("l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax")


@query("iou_join", with_views(f"SELECT seq_id, frame_id, c_det_id, t_det_id, round(iou, 9) AS iou FROM ({_PAIRS})"))
def iou_join(spark, sf):
    return op.iou_join(*_both(spark, sf), 0.5).select(*IDS, F.round("iou", 9).alias("iou"))


@query("iou_join_grid", with_views(f"SELECT seq_id, frame_id, c_det_id, t_det_id, round(iou, 9) AS iou FROM ({_PAIRS})"))
def iou_join_grid(spark, sf):
    return op.iou_join_grid(*_both(spark, sf), 0.5, 64.0).select(*IDS, F.round("iou", 9).alias("iou"))


@query("match_greedy")
def match_greedy(spark, sf):
    return op.match_greedy(*_both(spark, sf))


@query("match_conf_order")
def match_conf_order(spark, sf):
    return op.match_by_confidence(*_both(spark, sf))


@query("match_optimal")
def match_optimal(spark, sf):
    return op.match_optimal(*_both(spark, sf))


@query("unmatched")
def unmatched(spark, sf):
    c, t = _both(spark, sf)
    m = op.match_greedy(c, t)
    fp = op.unmatched(c, m, "c_id").select("seq_id", "frame_id", "det_id", F.lit("fp").alias("kind"))
    return fp.unionByName(op.unmatched(t, m, "t_id").select("seq_id", "frame_id", "det_id", F.lit("fn").alias("kind")))


@query("align_sequences", with_views("SELECT coalesce(a.name, b.name) AS name, computed, truth FROM (SELECT DISTINCT 'seq' || seq_id AS name, '/c/seq' || seq_id || '_detections.csv' AS computed FROM computed) a FULL JOIN (SELECT DISTINCT 'seq' || (seq_id + 1) AS name, '/t/seq' || (seq_id + 1) || '.csv' AS truth FROM truth) b ON a.name = b.name"))
def align_sequences(spark, sf):
    c, t = _both(spark, sf)
    a = c.select("seq_id").distinct().select(F.concat(F.lit("/c/seq"), "seq_id", F.lit("_detections.csv")).alias("path"))
    b = t.select("seq_id").distinct().select(F.concat(F.lit("/t/seq"), F.col("seq_id") + 1, F.lit(".csv")).alias("path"))
    return op.align_sequences(a, b)


@query("frame_name_reconcile", with_views("SELECT coalesce(a.seq_id, b.seq_id) AS seq_id, coalesce(a.frame_id, b.frame_id) AS frame_id, coalesce(b.n, a.n) AS frame_name, coalesce(a.n <> b.n, false) AS differs FROM (SELECT DISTINCT seq_id, frame_id, 'f' || (frame_id + CASE WHEN frame_id % 50 = 0 THEN 1 ELSE 0 END) AS n FROM computed) a FULL JOIN (SELECT DISTINCT seq_id, frame_id, 'f' || frame_id AS n FROM truth WHERE frame_id % 7 <> 0) b USING (seq_id, frame_id)"))
def frame_name_reconcile(spark, sf):
    c, t = _both(spark, sf)
    name = lambda e: F.concat(F.lit("f"), e).alias("frame_name")
    a = c.select("seq_id", "frame_id", name(F.col("frame_id") + F.when(F.col("frame_id") % 50 == 0, 1).otherwise(0)))
    return op.reconcile_frames(a, t.where("frame_id % 7 <> 0").select("seq_id", "frame_id", name(F.col("frame_id"))))


@query(
    "suppress_in_regions",
    with_views(f"""WITH hit AS (SELECT c.det_id, bool_or(t.cls = 'suppress') AS dropped, bool_or(t.cls = 'borderline') AS border FROM computed c JOIN regions t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id
WHERE {INTER} / {AREA.format('c')} >= 0.4 GROUP BY c.det_id)
SELECT det_id, CASE WHEN coalesce(border, false) THEN conf * 0.5 ELSE conf END AS conf FROM computed LEFT JOIN hit USING (det_id) WHERE NOT coalesce(dropped, false)"""),
)
def suppress_in_regions(spark, sf):
    return op.suppress_in_regions(view(spark, sf, "computed"), view(spark, sf, "regions"), 0.4, "suppress", "borderline").select("det_id", "conf")


@query(
    "coverage_reinforce",
    with_views(f"""WITH e AS (SELECT seq_id, frame_id, det_id, x1 + 15 AS x1, y1 + 5 AS y1, x2 + 15 AS x2, y2 + 5 AS y2, conf FROM computed WHERE det_id % 3 = 0),
b AS (SELECT * FROM computed WHERE det_id % 3 <> 0),
hit AS (SELECT c.det_id, t.det_id AS e_id, {INTER} AS common, {AREA.format('c')} AS area FROM b c JOIN e t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id WHERE {INTER} > 0),
cover AS (SELECT det_id, least(1.0, sum(common) / any_value(area)) AS cover FROM hit GROUP BY det_id)
SELECT det_id, round(conf + 0.5 * coalesce(cover, 0.0) * (1 - conf), 9) AS conf FROM b LEFT JOIN cover USING (det_id)
UNION ALL SELECT det_id, round(0.1 * (x2 - x1) * (y2 - y1) / max((x2 - x1) * (y2 - y1)) OVER (PARTITION BY seq_id, frame_id), 9) FROM e WHERE det_id NOT IN (SELECT e_id FROM hit)"""),
)
def coverage_reinforce(spark, sf):
    c = view(spark, sf, "computed")
    e = c.where("det_id % 3 = 0").withColumns({k: F.col(k) + d for k, d in (("x1", 15), ("y1", 5), ("x2", 15), ("y2", 5))})
    return op.coverage_reinforce(c.where("det_id % 3 <> 0"), e).select("det_id", F.round("conf", 9).alias("conf"))


_PRIOR = "EXISTS (SELECT 1 FROM (SELECT seq_id, x1, y1, x2, y2, min(frame_id) AS frame_id FROM regions GROUP BY ALL) p WHERE p.seq_id = c.seq_id AND p.frame_id < c.frame_id AND (c.x1 + c.x2) / 2 BETWEEN p.x1 AND p.x2 AND (c.y1 + c.y2) / 2 BETWEEN p.y1 AND p.y2)"


@query("suppress_prior_boxes", with_views(f"SELECT det_id FROM computed c WHERE NOT {_PRIOR}"))
def suppress_prior_boxes(spark, sf):
    return op.suppress_prior(view(spark, sf, "computed"), view(spark, sf, "regions")).select("det_id")


@query("boundary_cutoff_boxes", with_views(f"SELECT DISTINCT c.det_id FROM computed c JOIN regions t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id WHERE (c.x1 <= 40 OR c.y1 <= 40 OR c.x2 >= 1880 OR c.y2 >= 1040) AND {INTER} > 0"))
def boundary_cutoff_boxes(spark, sf):
    return op.boundary_cutoff(view(spark, sf, "computed"), view(spark, sf, "regions").withColumn("det_id", F.lit(0)), 1920, 1080, 40).where("cut_off").select("det_id")


def _views_of_two(spark, sf, name):
    """Boxes of two cameras: odd sequences are the second camera of the even ones before them."""
    return view(spark, sf, name).withColumn("camera", F.col("seq_id") % 2).withColumn("seq_id", F.expr("seq_id DIV 2"))


#: Homographies to a reference that changes every ten frames: the cameras move on, with a little perspective.
_H = {"h0": "1", "h1": "0.02", "h2": "180 * (frame_id % 10)", "h3": "0.01 * (frame_id % 3)", "h4": "1", "h5": "7 * (frame_id % 10) + 60 * camera", "h6": "0.00001 * camera", "h7": "0", "h8": "1"}


def _frames_of_two(spark, sf):
    f = _views_of_two(spark, sf, "truth").select("seq_id", "camera", "frame_id").distinct()
    h = F.array(*(F.expr(v).cast("double") for v in _H.values()))
    name = F.concat_ws("_", F.lit("img"), F.col("frame_id"), F.col("camera"))
    return f.select("*", F.expr("frame_id DIV 10").alias("reference"), h.alias("h"), F.lit(300.0).alias("width"), F.lit(200.0).alias("height"), name.alias("name"))


_TWO = f"""WITH fr AS MATERIALIZED (SELECT *, {", ".join(f"({v})::DOUBLE AS {k}" for k, v in _H.items())}, frame_id // 10 AS reference FROM (SELECT DISTINCT seq_id // 2 AS seq_id, seq_id % 2 AS camera, frame_id FROM truth)),
iv AS MATERIALIZED (SELECT seq_id, camera, frame_id, reference, h4 * h8 - h5 * h7 AS a0, h2 * h7 - h1 * h8 AS a1, h1 * h5 - h2 * h4 AS a2, h5 * h6 - h3 * h8 AS a3, h0 * h8 - h2 * h6 AS a4, h2 * h3 - h0 * h5 AS a5, h3 * h7 - h4 * h6 AS a6, h1 * h6 - h0 * h7 AS a7, h0 * h4 - h1 * h3 AS a8 FROM fr),
bx AS MATERIALIZED (SELECT c.seq_id // 2 AS seq_id, c.seq_id % 2 AS camera, c.frame_id, det_id, x1, y1, x2, y2 FROM computed c), """
_REF = lambda x, y: f"(h0 * {x} + h1 * {y} + h2) / (h6 * {x} + h7 * {y} + h8) AS px, (h3 * {x} + h4 * {y} + h5) / (h6 * {x} + h7 * {y} + h8) AS py"
_BACK = ("(a0 * px + a1 * py + a2) / (a6 * px + a7 * py + a8)", "(a3 * px + a4 * py + a5) / (a6 * px + a7 * py + a8)")
_IN = f"{_BACK[0]} >= 0 AND {_BACK[0]} < 300 AND {_BACK[1]} >= 0 AND {_BACK[1]} < 200"
_CENTRE = f"p AS (SELECT bx.*, reference, {_REF('((x1 + x2) / 2)', '((y1 + y2) / 2)')} FROM bx JOIN fr USING (seq_id, camera, frame_id))"


def _suppressed(related: str) -> str:
    return with_views(f"{_TWO}{_CENTRE} SELECT det_id FROM bx WHERE det_id NOT IN (SELECT det_id FROM p JOIN iv o ON o.seq_id = p.seq_id AND o.reference = p.reference WHERE ({related} OR (o.frame_id = p.frame_id AND p.camera = 0 AND o.camera = 1 AND EXISTS (SELECT 1 FROM fr WHERE fr.seq_id = p.seq_id AND fr.frame_id = p.frame_id AND fr.camera = 1))) AND {_IN})")


@query("suppress_prior_frame", _suppressed("o.frame_id < p.frame_id"))
def suppress_prior_frame(spark, sf):
    """Boxes of two cameras that an earlier frame of either shows already."""
    return footprints.suppress(_views_of_two(spark, sf, "computed"), _frames_of_two(spark, sf)).select("det_id")


@query("suppress_neighbour_frame", _suppressed("o.frame_id = (SELECT max(frame_id) FROM fr WHERE fr.seq_id = p.seq_id AND fr.frame_id < p.frame_id)"))
def suppress_neighbour_frame(spark, sf):
    """The same by the frame before only."""
    return footprints.suppress(_views_of_two(spark, sf, "computed"), _frames_of_two(spark, sf), "neighbours").select("det_id")


@query("boundary_cutoff", with_views(f"""{_TWO}k AS (SELECT det_id, unnest([x1, x2, x2, x1]) AS x, unnest([y1, y1, y2, y2]) AS y, seq_id, camera, frame_id FROM bx), p AS (SELECT k.*, reference, {_REF('x', 'y')} FROM k JOIN fr USING (seq_id, camera, frame_id)),
m AS (SELECT p.*, o.frame_id AS f, o.camera AS c, {_BACK[0]} AS qx, {_BACK[1]} AS qy FROM p JOIN iv o ON o.seq_id = p.seq_id AND o.reference = p.reference AND (o.frame_id < p.frame_id OR (o.frame_id = p.frame_id AND o.camera <> p.camera))),
g AS (SELECT det_id, f, c, bool_or((x <= 30 OR y <= 30 OR x >= 269 OR y >= 169) AND qx >= 0 AND qx < 300 AND qy >= 0 AND qy < 200) AS hit, bool_or(x <= 30 OR y <= 30 OR x >= 269 OR y >= 169) AS near, least(min(qx), min(qy), 299 - max(qx), 199 - max(qy)) AS depth FROM m GROUP BY ALL)
SELECT det_id, CASE WHEN max(depth) > 30 THEN 'img_' || arg_max(f, (depth, -f, -c)) || '_' || arg_max(c, (depth, -f, -c)) END AS best_view FROM g WHERE near GROUP BY det_id HAVING bool_or(hit)"""))
def boundary_cutoff(spark, sf):
    """Boxes cut by the border of their image where another frame shows it, and the frame that shows them best."""
    c = _views_of_two(spark, sf, "computed")
    return footprints.boundary_cutoff(c, _frames_of_two(spark, sf), 30.0).where("cut_off").select("det_id", "best_view")


@query("stereo_match_iou")
def stereo_match_iou(spark, sf):
    return op.match_greedy(*_both(spark, sf), 0.3, ["seq_id", "frame_id", "cls"])


@query("stereo_match_keypoint")
def stereo_match_keypoint(spark, sf):
    pts = lambda df: df.select("seq_id", "frame_id", "det_id", F.col("x1").alias("px"), F.col("y1").alias("py"), F.col("x2").alias("qx"), F.col("y2").alias("qy"))
    c, t = _both(spark, sf)
    return op.match_points(pts(c), pts(t), 12.0)


@query("multicam_chain_match")
def multicam_chain_match(spark, sf):
    """Boxes matched between neighbouring cameras, chained to one object per component."""
    c, t = _both(spark, sf)
    third = t.withColumn("x1", F.col("x1") + 3).withColumn("x2", F.col("x2") + 3)
    return op.chain_cameras([c, t, third])


@query("tube_iou", with_views(f"SELECT seq_id, c_track_id, t_track_id, frames, round(mean_iou, 9) AS mean_iou FROM (SELECT c.seq_id, c.track_id AS c_track_id, t.track_id AS t_track_id, count(*) AS frames, avg({IOU}) AS mean_iou FROM computed c JOIN truth t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id GROUP BY ALL HAVING count(*) >= 3 AND avg({IOU}) > 0)"))
def tube_iou(spark, sf):
    return op.tube_iou(*_both(spark, sf), 3).withColumn("mean_iou", F.round("mean_iou", 9))


@query("tube_volume_iou", with_views(f"""WITH g AS (SELECT c.seq_id, c.track_id AS c_track_id, t.track_id AS t_track_id, count(*) AS frames, sum({INTER}) AS common FROM computed c JOIN truth t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id GROUP BY ALL HAVING count(*) >= 3),
a AS (SELECT seq_id, track_id, sum((x2 - x1) * (y2 - y1)) AS s FROM computed GROUP BY ALL), b AS (SELECT seq_id, track_id, sum((x2 - x1) * (y2 - y1)) AS s FROM truth GROUP BY ALL)
SELECT g.seq_id, c_track_id, t_track_id, frames, round(common / (a.s + b.s - common), 9) AS volume_iou FROM g JOIN a ON a.seq_id = g.seq_id AND a.track_id = c_track_id JOIN b ON b.seq_id = g.seq_id AND b.track_id = t_track_id WHERE common > 0"""))
def tube_volume_iou(spark, sf):
    return op.tube_iou(*_both(spark, sf), 3, volume=True).drop("mean_iou").withColumn("volume_iou", F.round("volume_iou", 9))


@query("tile_boundary_merge")
def tile_boundary_merge(spark, sf):
    c = view(spark, sf, "computed").withColumn("tile", (F.col("det_id") % 2).cast("int"))
    strip = spark.createDataFrame([(0, 1, 60.0, 0.0, 260.0, 400.0)], "tile_a int, tile_b int, x1 double, y1 double, x2 double, y2 double")
    return op.tile_boundary_merge(c, strip, 0.5)


@query(
    "chip_truth",
    with_views("""WITH chips AS (SELECT gx * 100.0 AS tx, gy * 60.0 AS ty, gx * 100.0 + 160 AS tx2, gy * 60.0 + 120 AS ty2 FROM range(0, 4) a(gx), range(0, 3) b(gy)),
j AS (SELECT seq_id, frame_id, tx, ty, tx2, ty2, det_id, cls, x1, y1, x2, y2, least(x2 - x1, y2 - y1) < 45 AND cls <> 'N' AS small FROM truth, chips
WHERE greatest(0, least(x2, tx2) - greatest(x1, tx)) * greatest(0, least(y2, ty2) - greatest(y1, ty)) / ((x2 - x1) * (y2 - y1)) >= 0.3),
g AS (SELECT seq_id, frame_id, tx, ty FROM j GROUP BY ALL HAVING NOT bool_or(small))
SELECT seq_id, frame_id, tx::DOUBLE AS tx, ty::DOUBLE AS ty, det_id, cls, (least(greatest(x1, tx), tx2) - tx)::DOUBLE AS x1, (least(greatest(x2, tx), tx2) - tx)::DOUBLE AS x2 FROM j JOIN g USING (seq_id, frame_id, tx, ty)"""),
)
def chip_truth(spark, sf):
    chips = spark.range(0, 4).crossJoin(spark.range(0, 3).withColumnRenamed("id", "gy")).selectExpr("id * 100.0D AS tx", "gy * 60.0D AS ty", "id * 100.0D + 160 AS tx2", "gy * 60.0D + 120 AS ty2")
    return op.chip_truth(_both(spark, sf)[1], chips, 0.3, 45, "N").select("seq_id", "frame_id", "tx", "ty", "det_id", "cls", "x1", "x2")


@query("region_groups")
def region_groups(spark, sf):
    """Overlap-connected boxes of frames with more than four of them, as one hull per group."""
    return op.region_groups(_both(spark, sf)[1], 4)


@query(
    "desc_label_overlap",
    with_views(f"""WITH s AS (SELECT c.seq_id, c.frame_id, c.det_id, coalesce(least({INTER} / {AREA.format('c')}, {INTER} / {AREA.format('t')}), 0) AS share, t.det_id AS t_id, t.cls FROM computed c LEFT JOIN truth t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id),
b AS (SELECT *, row_number() OVER (PARTITION BY seq_id, frame_id, det_id ORDER BY share DESC, t_id) AS rn FROM s)
SELECT det_id, round(share, 9) AS share, CASE WHEN share >= 0.5 THEN cls WHEN share < 0.1 THEN 'background' END AS label FROM b WHERE rn = 1"""),
)
def desc_label_overlap(spark, sf):
    return op.label_overlap(*_both(spark, sf)).select("det_id", F.round("share", 9).alias("share"), "label")


@query("desc_lookup", with_views("SELECT q.uid, video, len(vec)::BIGINT AS n FROM (SELECT CAST(event_id AS VARCHAR) AS uid FROM events WHERE event_id % 3 = 0) q LEFT JOIN descriptors USING (uid)"))
def desc_lookup(spark, sf):
    q = view(spark, sf, "events").where("event_id % 3 = 0").selectExpr("CAST(event_id AS STRING) AS uid")
    return search.lookup(q, view(spark, sf, "descriptors")).selectExpr("uid", "video", "CAST(CASE WHEN vec IS NOT NULL THEN size(vec) END AS LONG) AS n")


@query("desc_attach", with_views("SELECT c.seq_id, c.track_id, c.frame_id, d.uid, len(d.vec) AS n, round(list_sum(d.vec::DOUBLE[]), 6) AS total FROM computed c JOIN (SELECT uid, vec FROM descriptors) d ON d.uid = CAST(c.det_id % 1000 AS VARCHAR)"))
def desc_attach(spark, sf):
    m = view(spark, sf, "computed").select("seq_id", "track_id", "frame_id", (F.col("det_id") % 1000).cast("string").alias("uid"))
    vec = F.aggregate("vec", F.lit(0.0), lambda t, x: t + x)
    return search.attach(m, view(spark, sf, "descriptors")).select("seq_id", "track_id", "frame_id", "uid", F.size("vec").cast("long").alias("n"), F.round(vec, 6).alias("total"))


@query("td_history", with_views("SELECT seq_id, track_id, string_agg(frame_id::VARCHAR || ':' || x1::INT, ' ' ORDER BY frame_id, det_id) AS history, count(*) AS n FROM computed GROUP BY seq_id, track_id"))
def td_history(spark, sf):
    h = search.histories(view(spark, sf, "computed").withColumn("x", F.round("x1").cast("int")), "x")
    return h.select("seq_id", "track_id", F.array_join(F.transform("h", lambda s: F.concat(s["frame_id"], F.lit(":"), s["x"])), " ").alias("history"), "n")


@query(
    "asof_nearest",
    with_views("""WITH a AS (SELECT stream_id, frame_id, epoch_us(ts) AS us FROM frames WHERE modality = 'click'), b AS (SELECT stream_id, frame_id, epoch_us(ts) AS us FROM frames WHERE modality = 'view'),
n AS (SELECT a.stream_id, a.frame_id, b.frame_id AS r_id, abs(a.us - b.us) AS off, row_number() OVER (PARTITION BY a.stream_id, a.frame_id ORDER BY abs(a.us - b.us), b.us, b.frame_id) AS rn
FROM a JOIN b ON a.stream_id = b.stream_id AND b.us BETWEEN a.us - 600000000 AND a.us + 600000000)
SELECT a.stream_id, a.frame_id AS id, r_id, off FROM a LEFT JOIN (SELECT * FROM n WHERE rn = 1) n ON a.stream_id = n.stream_id AND a.frame_id = n.frame_id"""),
)
def asof_nearest(spark, sf):
    f = view(spark, sf, "frames").select("stream_id", F.col("frame_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "modality")
    return op.nearest_in_time(f.where("modality = 'click'").drop("modality"), f.where("modality = 'view'").drop("modality"), 600_000_000, ["stream_id"])


@query("pair_count_join")
def pair_count_join(spark, sf):
    c, t = _both(spark, sf)
    m = op.match_greedy(c, t)
    m = m.join(c.select("seq_id", "frame_id", F.col("det_id").alias("c_id"), F.col("track_id").alias("c_track")), ["seq_id", "frame_id", "c_id"])
    m = m.join(t.select("seq_id", "frame_id", F.col("det_id").alias("t_id"), F.col("track_id").alias("t_track")), ["seq_id", "frame_id", "t_id"])
    return m.groupBy("seq_id", "t_track", "c_track").agg(F.count("*").alias("n"))


_CD = "sqrt(((c.x1 + c.x2) / 2 - (t.x1 + t.x2) / 2) ^ 2 + ((c.y1 + c.y2) / 2 - (t.y1 + t.y2) / 2) ^ 2)"


@query("close_pairs", with_views(f"SELECT c.seq_id, c.frame_id, c.track_id AS a, t.track_id AS b, round({_CD}, 6) AS distance FROM truth c JOIN truth t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id AND c.track_id < t.track_id WHERE {_CD} < 40"))
def close_pairs(spark, sf):
    return op.close_pairs(_both(spark, sf)[1], 40).selectExpr("seq_id", "frame_id", "c_track_id AS a", "t_track_id AS b", "round(distance, 6) AS distance")


@query("inter_object_overlap", with_views(f"SELECT c.seq_id, count(*) AS pairs, count(*) FILTER ({IOU} >= 0.3) AS heavy FROM truth c JOIN truth t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id AND c.det_id < t.det_id WHERE {INTER} > 0 GROUP BY 1"))
def inter_object_overlap(spark, sf):
    return op.overlapping_pairs(_both(spark, sf)[1]).groupBy("seq_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("iou") >= 0.3).alias("heavy"))


@query("link_flightlog", with_views("SELECT i.site, i.frame, l.v AS alt, CASE WHEN l.v IS NULL THEN 'default' ELSE 'log' END AS src FROM (SELECT DISTINCT site, frame, time_utc FROM images) i LEFT JOIN (SELECT event_id AS frame, CAST(ts AS DATE) AS day, max(value) AS v FROM events WHERE event_id % 4 <> 0 GROUP BY ALL) l ON i.frame = l.frame AND CAST(i.time_utc AS DATE) = l.day"))
def link_flightlog(spark, sf):
    """Images to log rows of the same day by frame number; without one the default."""
    log = view(spark, sf, "events").where("event_id % 4 <> 0").select(F.col("event_id").alias("frame"), F.to_date("ts").alias("day"), F.col("value").alias("alt"))
    i = view(spark, sf, "images").select("site", "frame", F.to_date("time_utc").alias("day"), "time_utc").distinct()
    return survey.link_flightlog(i, log, ["alt"]).select("site", "frame", "alt", "src")


@query("link_imagelog")
def link_imagelog(spark, sf):
    """Images of the first pass with the log of the second, per site; images without a position go by order."""
    e = view(spark, sf, "images").select("site", "frame", F.when(F.col("frame") % 11 != 0, F.col("lat")).alias("lat"), "lon", "pass_no")
    log = view(spark, sf, "images").where("pass_no = 2").select("site", "frame", "lat", "lon")
    return survey.link_imagelog(e.where("pass_no = 1").drop("pass_no"), log, "site")
