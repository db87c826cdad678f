"""Queries of the track and sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import matching as m
from ..operators import tracks as op
from ..registry import query
from ..shared import stored
from .views import view, with_views


def _c(spark, sf, name="computed"):
    return view(spark, sf, name).select("seq_id", "frame_id", "det_id", "track_id", "x1", "y1", "x2", "y2", "conf", "cls")


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_W = "WINDOW w AS (PARTITION BY seq_id, track_id ORDER BY frame_id, det_id)"
_CEN = "SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM computed"


@query("track_gaps", with_views(f"SELECT seq_id, track_id, count(*) AS states, count(*) FILTER (step > 1) AS gaps, coalesce(sum(step - 1) FILTER (step > 1), 0)::BIGINT AS missing FROM (SELECT *, frame_id - lag(frame_id) OVER w AS step FROM computed {_W}) GROUP BY ALL"))
def track_gaps(spark, sf):
    return op.gaps(_c(spark, sf))


@query("track_velocity", with_views(f"WITH v AS (SELECT seq_id, track_id, sqrt((cx - lag(cx) OVER w) ^ 2 + (cy - lag(cy) OVER w) ^ 2) / nullif(greatest(frame_id - lag(frame_id) OVER w, 0), 0) AS v FROM ({_CEN}) {_W}), g AS (SELECT seq_id, track_id, avg(v) AS mean, max(v) AS max, stddev_pop(v) AS std FROM v GROUP BY ALL) SELECT seq_id, track_id, round(mean, 6) AS mean, round(max, 6) AS max, round(std, 6) AS std, CASE WHEN mean < 2 THEN 'stationary' WHEN mean < 8 THEN 'slow' ELSE 'fast' END AS kind FROM g WHERE mean IS NOT NULL"))
def track_velocity(spark, sf):
    return _r(op.velocity(_c(spark, sf), 2, 8), "mean", "max", "std")


@query("direction_change", with_views(f"WITH d AS (SELECT *, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy FROM ({_CEN}) {_W}), p AS (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM d {_W}), n AS (SELECT *, sqrt(dx ^ 2 + dy ^ 2) * sqrt(px ^ 2 + py ^ 2) AS n FROM p) SELECT seq_id, track_id, round(avg(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (dx * px + dy * py) / n)))), 6) AS angle FROM n WHERE n > 0 GROUP BY ALL"))
def direction_change(spark, sf):
    return _r(op.direction_change(_c(spark, sf)), "angle")


@query("matched_runs")
def matched_runs(spark, sf):
    from ..operators import scoring

    c, t = _c(spark, sf), _c(spark, sf, "truth")
    return scoring.runs(scoring.status(t, scoring.matched_boxes(c, t), "t"), "track_id")


@query("track_interp", with_views(f"""WITH d AS (SELECT *, lead(frame_id) OVER w AS nf, lead(x1) OVER w AS n1, lead(y2) OVER w AS n2 FROM computed {_W}),
e AS (SELECT *, unnest(range(frame_id, greatest(frame_id + 1, coalesce(nf, frame_id + 1)))) AS f FROM d)
SELECT seq_id, track_id, f AS frame_id, round(CASE WHEN f = frame_id THEN x1 ELSE x1 + (f - frame_id) / (nf - frame_id) * (n1 - x1) END, 6) AS x1, round(CASE WHEN f = frame_id THEN y2 ELSE y2 + (f - frame_id) / (nf - frame_id) * (n2 - y2) END, 6) AS y2, conf, f <> frame_id AS added FROM e"""))
def track_interp(spark, sf):
    return _r(op.interpolate(_c(spark, sf)).select("seq_id", "track_id", "frame_id", "x1", "y2", "conf", "added"), "x1", "y2")


@query("track_resample", with_views(f"""WITH d AS (SELECT *, lead(frame_id) OVER w AS nf, lead(x1) OVER w AS n1, lead(conf) OVER w AS nc, lead(cls) OVER w AS ncls FROM computed {_W}),
o AS (SELECT *, nf IS NOT NULL AND nf - frame_id <= 6 AS op FROM d),
h AS (SELECT *, ceil(frame_id / 0.5 - 0.001)::BIGINT AS lo, CASE WHEN op THEN ceil(nf / 0.5 - 0.001)::BIGINT - 1 ELSE floor(frame_id / 0.5 + 0.001)::BIGINT END AS hi FROM o),
e AS (SELECT *, unnest(range(lo, hi + 1)) AS f FROM h WHERE lo <= hi),
t AS (SELECT *, CASE WHEN op THEN greatest(0.0, (f * 0.5 - frame_id) / (nf - frame_id)) ELSE 0.0 END AS t FROM e),
u AS (SELECT * REPLACE (CASE WHEN abs(t) < 0.001 THEN 0.0 ELSE t END AS t) FROM t)
SELECT seq_id, track_id, f AS frame_id, round(CASE WHEN t = 0 THEN x1 ELSE x1 + t * (n1 - x1) END, 6) AS x1, round(CASE WHEN t = 0 THEN conf ELSE conf + t * (nc - conf) END, 6) AS conf, CASE WHEN t > 0.5 THEN ncls ELSE cls END AS cls FROM u"""))
def track_resample(spark, sf):
    return _r(op.resample(_c(spark, sf), 5.0, 10.0, 6).select("seq_id", "track_id", "frame_id", "x1", "conf", "cls"), "x1", "conf")


def _vectors(spark, sf):
    c = _c(spark, sf).withColumn("uid", (F.col("det_id") % 400).cast("string"))
    return c.join(view(spark, sf, "descriptors").select("uid", "vec"), "uid")


_TOTAL = "aggregate(vec, 0D, (s, x) -> s + x)"
_VEC = "(SELECT c.*, d.vec FROM computed c JOIN descriptors d ON d.uid = CAST(det_id % 400 AS VARCHAR))"


@query("desc_rolling_avg", with_views(f"SELECT seq_id, track_id, frame_id, det_id, round(avg(vec[1]::DOUBLE) OVER (PARTITION BY seq_id, track_id ORDER BY frame_id, det_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS v0, round(avg(vec[64]::DOUBLE) OVER (PARTITION BY seq_id, track_id ORDER BY frame_id, det_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS v63, round(avg(list_sum(vec::DOUBLE[])) OVER (PARTITION BY seq_id, track_id ORDER BY frame_id, det_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS total FROM {_VEC}"))
def desc_rolling_avg(spark, sf):
    out = op.rolling_mean(_vectors(spark, sf), 5)
    return out.select("seq_id", "track_id", "frame_id", "det_id", F.round(F.col("vec")[0], 6).alias("v0"), F.round(F.col("vec")[63], 6).alias("v63"), F.expr(f"round({_TOTAL}, 6) AS total"))


@query("desc_block_avg", with_views(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY seq_id, track_id ORDER BY frame_id, det_id) AS rn FROM {_VEC}), b AS (SELECT *, CASE WHEN rn = 1 THEN -1 ELSE floor((rn - 2) / 3.0) END AS block FROM r) SELECT seq_id, track_id, max(frame_id) AS frame_id, round(avg(vec[1]::DOUBLE), 6) AS v0, round(avg(list_sum(vec::DOUBLE[])), 6) AS total FROM b GROUP BY seq_id, track_id, block HAVING block = -1 OR count(*) = 3"))
def desc_block_avg(spark, sf):
    return op.block_mean(_vectors(spark, sf), 3).select("seq_id", "track_id", "frame_id", F.round(F.col("vec")[0], 6).alias("v0"), F.expr(f"round({_TOTAL}, 6) AS total"))


@query("shot_segments")
def shot_segments(spark, sf):
    return op.segments(view(spark, sf, "frames"), "stream_id", "frame_id", "change_score", 90.0, 5, 60)


_SEQ = "(SELECT label, uid::BIGINT AS uid, vec, lag(vec) OVER (PARTITION BY label ORDER BY uid::BIGINT) AS before FROM descriptors)"


@query("hist_change", with_views(f"SELECT label, uid, round(1 - list_sum(list_transform(list_zip(vec, before), lambda z: least(z[1]::DOUBLE, z[2]::DOUBLE))), 6) AS change FROM {_SEQ} WHERE before IS NOT NULL"))
def hist_change(spark, sf):
    d = view(spark, sf, "descriptors").withColumn("uid", F.col("uid").cast("long"))
    return _r(op.change(d, "label", "uid", V.intersection_distance), "change")


@query("desc_change", with_views(f"SELECT label, uid, round(list_distance(vec::DOUBLE[], before::DOUBLE[]), 6) AS change FROM {_SEQ} WHERE before IS NOT NULL"))
def desc_change(spark, sf):
    d = view(spark, sf, "descriptors").withColumn("uid", F.col("uid").cast("long"))
    return _r(op.change(d, "label", "uid", V.euclidean), "change")


_POS = "(SELECT event_id AS frame, user_id % 5 AS site, (event_id * 7 % 101)::DOUBLE AS e, (event_id * 13 % 89)::DOUBLE AS n FROM events)"


@query("heading", f"SELECT site, frame, round((degrees(atan2(coalesce(lead(e) OVER w, e) - coalesce(lag(e) OVER w, e), coalesce(lead(n) OVER w, n) - coalesce(lag(n) OVER w, n))) + 360) % 360, 6) AS heading FROM {_POS} WINDOW w AS (PARTITION BY site ORDER BY frame)")
def heading(spark, sf):
    p = view(spark, sf, "events").selectExpr("event_id AS frame", "user_id % 5 AS site", "CAST(event_id * 7 % 101 AS DOUBLE) AS e", "CAST(event_id * 13 % 89 AS DOUBLE) AS n")
    return _r(op.headings(p, ["site"], "frame").select("site", "frame", "heading"), "heading")


@query("uid_assign", with_views("SELECT seq_id, track_id, row_number() OVER (ORDER BY seq_id, f, d) - 1 AS uid FROM (SELECT seq_id, track_id, min(frame_id) AS f, arg_min(det_id, (frame_id, det_id)) AS d FROM computed GROUP BY ALL)"))
def uid_assign(spark, sf):
    return op.assign_uids(_c(spark, sf))


@query("concat_parts", with_views("WITH p AS (SELECT seq_id, 1000 + seq_id AS frames FROM computed GROUP BY seq_id), t AS (SELECT seq_id, max(track_id) + 1 AS top FROM computed GROUP BY seq_id), o AS (SELECT seq_id, coalesce(sum(frames) OVER w, 0) AS shift, coalesce(sum(top) OVER w, 0) AS base FROM p JOIN t USING (seq_id) WINDOW w AS (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT det_id, (frame_id + shift)::BIGINT AS frame_id, (track_id + base)::BIGINT AS track_id FROM computed JOIN o USING (seq_id)"))
def concat_parts(spark, sf):
    c = _c(spark, sf).withColumnRenamed("seq_id", "part")
    parts = c.select("part").distinct().withColumn("frames", 1000 + F.col("part"))
    return op.concat_parts(c, parts).select("det_id", "frame_id", "track_id")


@query("mosaic_ranges", with_views("WITH f AS (SELECT stream_id, frame_id, frame_id - frame_id % (40 + stream_id) AS ref FROM frames), d AS (SELECT *, CASE WHEN ref IS DISTINCT FROM lag(ref) OVER w THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY frame_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY frame_id) AS range FROM d) SELECT stream_id, range::BIGINT AS range, ref, min(frame_id) AS first, max(frame_id) AS last FROM r GROUP BY ALL"))
def mosaic_ranges(spark, sf):
    f = view(spark, sf, "frames").withColumn("ref", F.expr("frame_id - frame_id % (40 + stream_id)"))
    return op.mosaic_ranges(f, "stream_id", "frame_id", "ref")


def _frames(spark, sf):
    """Frames of all sequences, those below a bound of confidence without truth."""
    return view(spark, sf, "computed").groupBy("seq_id", "frame_id").agg((F.max("conf") > 0.75).alias("has_truth"))


@query("burst_split")
def burst_split(spark, sf):
    return op.burst_split(_frames(spark, sf), 5, 0.2)


@query("clip_split", with_views("WITH u AS (SELECT seq_id, row_number() OVER (ORDER BY seq_id DESC) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT seq_id FROM computed) WHERE seq_id <> 3) SELECT seq_id, rn <= least(floor(n / 2), greatest(1, floor(n * 0.4))) AS validation FROM u"))
def clip_split(spark, sf):
    clips = _c(spark, sf).select("seq_id").distinct().withColumn("usable", F.col("seq_id") != 3)
    return op.clip_split(clips, 0.4)


@query("neg_ratio")
def neg_ratio(spark, sf):
    return op.negative_ratio(_frames(spark, sf), 0.25)


@query("homog_chain", with_views("SELECT seq_id, frame_id, round(sum((frame_id % 5)::DOUBLE) OVER (PARTITION BY seq_id ORDER BY frame_id), 6) AS tx, round(sum((frame_id % 3)::DOUBLE) OVER (PARTITION BY seq_id ORDER BY frame_id), 6) AS ty FROM (SELECT DISTINCT seq_id, frame_id FROM truth)"))
def homog_chain(spark, sf):
    d = lambda x: F.lit(float(x))
    h = _c(spark, sf, "truth").select("seq_id", "frame_id").distinct()
    h = h.withColumn("h", F.array(d(1), d(0), (F.col("frame_id") % 5).cast("double"), d(0), d(1), (F.col("frame_id") % 3).cast("double"), d(0), d(0), d(1)))
    return op.compose_homographies(h).select("seq_id", "frame_id", F.round(F.col("h")[2], 6).alias("tx"), F.round(F.col("h")[5], 6).alias("ty"))


@query("track_landmarks", with_views("SELECT seq_id, track_id, count(*) AS points, arg_max(x1, (frame_id, det_id)) FILTER (det_id % 2 = 0) AS x, arg_max(y1, (frame_id, det_id)) FILTER (det_id % 2 = 0) AS y, 5.0::DOUBLE AS z FROM truth GROUP BY seq_id, track_id HAVING count(*) FILTER (det_id % 2 = 0) > 0"))
def track_landmarks(spark, sf):
    note = F.when(F.col("det_id") % 2 == 0, F.concat(F.lit(":at=("), "x1", F.lit(", "), "y1", F.lit(", 5.0)")))
    return op.landmarks(_c(spark, sf, "truth"), note)


@query("bg_downsample")
def bg_downsample(spark, sf):
    return op.thin_background(_frames(spark, sf), 3, 1)


@query("frame_downsample", with_views("SELECT seq_id, frame_id FROM (SELECT seq_id, frame_id, row_number() OVER (PARTITION BY seq_id ORDER BY frame_id) - 1 AS i FROM (SELECT DISTINCT seq_id, frame_id FROM computed)) WHERE i = 0 OR floor(i / 2.5) <> floor((i - 1) / 2.5)"))
def frame_downsample(spark, sf):
    return op.thin_frames(_frames(spark, sf), 2.5).select("seq_id", "frame_id")


@query("link_iou_greedy")
def link_iou_greedy(spark, sf):
    return op.link_greedy(_c(spark, sf)).select("seq_id", "frame_id", "det_id", "linked_track")


@query("link_bytetrack")
def link_bytetrack(spark, sf):
    return op.link_two_stage(_c(spark, sf))


@query("link_ocsort")
def link_ocsort(spark, sf):
    return op.link_two_stage(_vectors(spark, sf), vec="vec", direction=0.2, appearance=0.3)


@query("link_iou_homography")
def link_iou_homography(spark, sf):
    """Greedy links of boxes that move with the camera, ended where the reference frame changes."""
    d = lambda x: F.lit(float(x))
    # written once: it is matched with itself and its frames, and linked
    c = stored(_c(spark, sf).select("seq_id", "frame_id", "det_id", "x1", "y1", "x2", "y2", F.expr("frame_id DIV 100").alias("ref")), "boxes")
    h = c.select("seq_id", "frame_id").distinct().where("frame_id % 7 <> 0")
    h = h.withColumn("h", F.array(d(1), d(0), (F.col("frame_id") % 3).cast("double"), d(0), d(1), (F.col("frame_id") % 2).cast("double"), d(0), d(0), d(1)))
    return op.link_greedy(c, 0.2, h, "ref").select("seq_id", "frame_id", "det_id", "linked_track")


def _pairs(spark, sf):
    """Left and right tracks of matched boxes."""
    c, t = _c(spark, sf), _c(spark, sf, "truth")
    mm = m.match_greedy(c, t)
    key = lambda df, k: df.select("seq_id", "frame_id", F.col("det_id").alias(f"{k}_id"), (F.col("track_id") * 8 + F.col("seq_id")).alias(f"{k}t"))
    j = mm.join(key(t, "t"), ["seq_id", "frame_id", "t_id"]).join(key(c, "c"), ["seq_id", "frame_id", "c_id"])
    return j.select("seq_id", "frame_id", F.col("tt").alias("left_id"), F.col("ct").alias("right_id"))


@query("stereo_link_components")
def stereo_link_components(spark, sf):
    return op.stereo_components(_pairs(spark, sf))


@query("stereo_pair_most_likely")
def stereo_pair_most_likely(spark, sf):
    return op.stereo_most_likely(_pairs(spark, sf))


@query("stereo_pair_split")
def stereo_pair_split(spark, sf):
    return op.stereo_split(_pairs(spark, sf), 3)


@query("pair_quality_gate", with_views("SELECT c.det_id FROM computed c JOIN truth t ON c.det_id = t.det_id WHERE abs((c.y1 + c.y2) / 2 - (t.y1 + t.y2) / 2) <= 4 AND sqrt((c.x1 - t.x1) ^ 2 + (c.y1 - t.y1) ^ 2) <= 6"))
def pair_quality_gate(spark, sf):
    t = view(spark, sf, "truth").select("det_id", *(F.col(k).alias(f"t_{k}") for k in ("x1", "y1", "x2", "y2")))
    j = _c(spark, sf).join(t, "det_id")
    return j.where(F.abs(F.expr("(y1 + y2) / 2 - (t_y1 + t_y2) / 2")) <= 4).where(F.sqrt(F.expr("power(x1 - t_x1, 2) + power(y1 - t_y1, 2)")) <= 6).select("det_id")
