"""Queries of the summaries and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as m
from ..operators import scoring
from ..operators import stats as op
from ..registry import query
from .views import view, with_views

A, W, H = "(x2 - x1) * (y2 - y1)", "(x2 - x1)", "(y2 - y1)"


def _c(spark, sf):
    return view(spark, sf, "computed")


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _simple(name, sql, f):
    query(name, with_views(sql))(f)


_simple("type_list", "SELECT DISTINCT cls FROM computed WHERE regexp_matches(cls, '[A-Z]')", lambda s, d: op.type_list(_c(s, d), True))
_simple("track_count", "SELECT count(DISTINCT (seq_id, track_id)) AS tracks, count(*) AS states FROM computed", lambda s, d: op.track_count(_c(s, d)))
_simple("type_track_count", "SELECT cls, count(DISTINCT (seq_id, track_id)) AS tracks FROM computed GROUP BY cls", lambda s, d: op.type_track_count(_c(s, d)))
_simple("counts_per_frame", "SELECT seq_id, frame_id, cls, count(*) AS n FROM computed GROUP BY ALL", lambda s, d: op.counts_per_frame(_c(s, d)))
_simple("avg_box_size", f"SELECT cls, round(avg({A}), 6) AS area, count(*) AS n FROM computed GROUP BY cls", lambda s, d: _r(op.avg_box_size(_c(s, d)), "area"))
_simple("comp_matrix", "SELECT seq_id, count(DISTINCT track_id) FILTER (cls = 'A') AS A, count(DISTINCT track_id) FILTER (cls = 'N') AS N, count(DISTINCT track_id) FILTER (cls = 'R') AS R, count(DISTINCT track_id) FILTER (cls = 'X') AS X FROM computed GROUP BY seq_id", lambda s, d: op.comp_matrix(_c(s, d), ["A", "N", "R", "X"]))
_simple("only_single", "SELECT DISTINCT frame_id * 8 + seq_id AS seq_id FROM truth WHERE frame_id * 8 + seq_id NOT IN (SELECT frame_id * 8 + seq_id FROM truth GROUP BY frame_id * 8 + seq_id, l_partkey % 3 HAVING count(*) > 1)", lambda s, d: op.only_single(view(s, d, "truth").selectExpr("frame_id * 8 + seq_id AS seq_id", "l_partkey % 3 AS track_id"), view(s, d, "truth").selectExpr("frame_id * 8 + seq_id AS seq_id").distinct()))
_simple("max_count", "WITH c AS (SELECT seq_id, cls, frame_id, count(*) AS n FROM computed GROUP BY ALL), s AS (SELECT *, max(n) OVER (PARTITION BY seq_id, cls ORDER BY frame_id RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM c) SELECT seq_id, cls, smooth AS max_n, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, cls ORDER BY smooth DESC, frame_id) AS rn FROM s) WHERE rn = 1", lambda s, d: op.max_count(_c(s, d)))
_simple("ranked_frames", "SELECT seq_id, frame_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, frame_id) AS rank FROM (SELECT seq_id, frame_id, count(*) AS n FROM computed GROUP BY ALL)) WHERE rank <= 10", lambda s, d: op.ranked_frames(_c(s, d), 10))


def _pick(e, share):
    return f"list_sort(list({e}))[(least(floor(count(*) * {share}), count(*) - 1) + 1)::INT]"


_STATS = ", ".join(f"min({e}) AS {k}_min, max({e}) AS {k}_max, round(avg({e}), 6) AS {k}_mean, {_pick(e, 0.1)} AS {k}_p10, {_pick(e, 0.5)} AS {k}_median, {_pick(e, 0.9)} AS {k}_p90" for k, e in (("width", W), ("height", H), ("area", A)))
_simple("det_stats", f"SELECT cls, count(*) AS n, {_STATS}, count(*) FILTER ({A} < 1024) AS small, count(*) FILTER ({A} >= 1024 AND {A} < 9216) AS medium, count(*) FILTER ({A} >= 9216) AS large FROM computed GROUP BY cls", lambda s, d: _r(op.det_stats(_c(s, d), ["cls"]), "width_mean", "height_mean", "area_mean"))
_simple("aspect_stats", f"SELECT cls, round(avg({W} / {H}), 6) AS mean, round(stddev_pop({W} / {H}), 6) AS std, count(*) FILTER ({W} / {H} < 0.5) AS tall, count(*) FILTER ({W} / {H} BETWEEN 0.5 AND 2) AS square, count(*) FILTER ({W} / {H} > 2) AS wide FROM computed GROUP BY cls", lambda s, d: _r(op.aspect_stats(_c(s, d), ["cls"]), "mean", "std"))
_simple("density_stats", "WITH f AS (SELECT DISTINCT seq_id, frame_id FROM truth), n AS (SELECT f.seq_id, count(c.det_id) AS n FROM f LEFT JOIN (SELECT * FROM computed WHERE conf >= 0.9) c ON c.seq_id = f.seq_id AND c.frame_id = f.frame_id GROUP BY f.seq_id, f.frame_id) SELECT seq_id, round(avg(n), 6) AS mean, max(n) AS max, count(*) FILTER (n >= 5) AS crowded, count(*) FILTER (n > 0 AND n <= 2) AS sparse, count(*) FILTER (n = 0) AS empty FROM n GROUP BY seq_id", lambda s, d: _r(op.density_stats(_c(s, d).where("conf >= 0.9"), view(s, d, "truth").select("seq_id", "frame_id").distinct(), 5, 2), "mean"))
_simple("scale_stats", f"SELECT cls, round(var_pop(sqrt({A})), 6) AS variance, round(max({A}) / min({A}), 6) AS ratio, max({A}) / min({A}) > 100 AS multi_scale FROM computed GROUP BY cls", lambda s, d: _r(op.scale_stats(_c(s, d), ["cls"]), "variance", "ratio"))
_simple("class_balance", "WITH c AS (SELECT cls, count(*) AS n FROM computed GROUP BY cls) SELECT round(max(n) / min(n), 6) AS imbalance, count(*) FILTER (n < 3000) AS rare, count(*) FILTER (n > 12000) AS dominant FROM c", lambda s, d: _r(op.class_balance(_c(s, d), 3000, 12000), "imbalance"))
_simple("edge_stats", "SELECT seq_id, count(*) FILTER (x1 <= 30 OR y1 <= 30 OR x2 >= w - 30 OR y2 >= h - 30) AS near, count(*) AS n FROM (SELECT *, max(x2) OVER (PARTITION BY seq_id) AS w, max(y2) OVER (PARTITION BY seq_id) AS h FROM computed) GROUP BY seq_id", lambda s, d: op.edge_stats(_c(s, d), 30))
_simple("mask_fraction", "SELECT cls, round(avg(CASE WHEN det_id % 4 = 0 THEN 0.0 ELSE 1.0 END), 6) AS share FROM computed GROUP BY cls", lambda s, d: _r(op.mask_fraction(_c(s, d).withColumn("polygon", F.when(F.col("det_id") % 4 != 0, F.array("x1", "y1"))), ["cls"], "polygon"), "share"))
_simple("track_stats", f"WITH t AS (SELECT seq_id, count(*) AS n FROM computed GROUP BY seq_id, track_id) SELECT seq_id, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, count(*) FILTER (n < 10) AS short, count(*) FILTER (n BETWEEN 10 AND 19) AS medium, count(*) FILTER (n >= 20) AS long, {_pick('n', 0.5)}::DOUBLE AS median FROM t GROUP BY seq_id", lambda s, d: _r(op.track_stats(_c(s, d), 10, 20), "mean"))
_simple("concurrency_stats", "SELECT seq_id, round(avg(n), 6) AS mean, max(n) AS max, count(*) FILTER (n >= 5) AS crowded, count(*) FILTER (n <= 2) AS sparse FROM (SELECT seq_id, count(DISTINCT track_id) AS n FROM computed GROUP BY seq_id, frame_id) GROUP BY seq_id", lambda s, d: _r(op.concurrency_stats(_c(s, d), 5, 2), "mean"))
_simple("size_cv", f"SELECT seq_id, round(avg(cv), 6) AS mean_cv, round(avg(CASE WHEN cv > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS high_share FROM (SELECT seq_id, stddev_pop({A}) / avg({A}) AS cv FROM computed GROUP BY seq_id, track_id) GROUP BY seq_id", lambda s, d: _r(op.size_cv(_c(s, d), 0.05), "mean_cv", "high_share"))
_LEN = "x1 - 60 + y1 % 7"
_simple("length_agg", f"WITH t AS (SELECT seq_id, track_id, list_sort(list({_LEN})) AS v, count(*) AS n FROM computed WHERE {_LEN} > 0 GROUP BY ALL) SELECT seq_id, track_id, n::INT AS n, round(list_sum(v) / n, 6) AS mean, round(CASE WHEN n % 2 = 1 THEN v[n // 2 + 1] ELSE (v[n // 2] + v[n // 2 + 1]) / 2 END, 6) AS median, round(CASE WHEN n < 4 THEN list_sum(v) / n ELSE list_avg(v[n // 4 + 1 : n // 4 + greatest(3 * n // 4 - n // 4, 1)]) END, 6) AS trimmed FROM t", lambda s, d: _r(op.length_agg(_c(s, d).withColumn("length", F.expr(_LEN))), "mean", "median", "trimmed"))
_simple("gsd_estimate", f"WITH g AS (SELECT seq_id, frame_id, ({_LEN}) / {W} AS ratio, CASE WHEN {_LEN} > 0 AND x1 > 50 AND y1 > 60 AND x2 < 1870 AND y2 < 1030 THEN 0 WHEN {_LEN} > 0 THEN 1 ELSE 2 END AS grade FROM computed), b AS (SELECT *, min(grade) OVER (PARTITION BY seq_id, frame_id) AS best FROM g) SELECT seq_id, frame_id, round({_pick('ratio', 0.45)}, 6) AS gsd FROM b WHERE grade = best GROUP BY ALL", lambda s, d: _r(op.gsd(_c(s, d).withColumn("length", F.expr(_LEN)).withColumns({"x1": F.col("x1"), "y1": F.col("y1") - 10, "y2": F.col("y2") - 10}).withColumn("x2", F.col("x2")).withColumn("y2", F.col("y2")), 1920, 1070, 50), "gsd"))
_TH = "quantile_cont(CASE WHEN det_id % 3 > 0 THEN conf END, {})"
_simple("thresholds_fit", f"WITH p AS (SELECT cls, {_TH.format(0.25)} AS p25, {_TH.format(0.02)} AS p2, {_TH.format(0.4)} AS p40, quantile_cont(CASE WHEN det_id % 3 = 0 THEN conf END, 0.6) AS u60 FROM computed GROUP BY cls), h AS (SELECT *, least(0.95, greatest(0.05, p25)) AS h FROM p) SELECT cls, round(h, 6) AS high, round(least(h - 0.05, greatest(0.01, p2, u60)), 6) AS low, round(least(0.95, greatest(h, p40)), 6) AS new FROM h", lambda s, d: _r(op.thresholds(_c(s, d).withColumn("matched", (F.col("det_id") % 3 > 0).cast("int")), ["cls"]), "high", "low", "new"))
_INTER = "(greatest(0.0, least(x2, p2) - greatest(x1, p1)) * greatest(0.0, least(y2, q2) - greatest(y1, q1)))"
_LINKS = f"(SELECT *, frame_id - pf AS dt, {_INTER} / ({A} + (p2 - p1) * (q2 - q1) - {_INTER}) AS iou, sqrt(((x1 + x2) / 2 - (p1 + p2) / 2) ^ 2 + ((y1 + y2) / 2 - (q1 + q2) / 2) ^ 2) AS moved FROM (SELECT *, lag(x1) OVER w AS p1, lag(y1) OVER w AS q1, lag(x2) OVER w AS p2, lag(y2) OVER w AS q2, lag(frame_id) OVER w AS pf FROM computed WINDOW w AS (PARTITION BY seq_id, track_id ORDER BY frame_id, det_id)))"
_simple("match_gate_fit", f"SELECT seq_id, count(*) AS links, round(1 - least(0.5, greatest(0.02, quantile_cont(iou, 0.05))), 6) AS distance FROM {_LINKS} WHERE dt = 1 GROUP BY seq_id HAVING count(*) >= 100 UNION ALL SELECT seq_id, count(*) FILTER (dt = 1), 0.8 FROM {_LINKS} GROUP BY seq_id HAVING count(*) FILTER (dt = 1) < 100", lambda s, d: _r(op.match_gate(_c(s, d), 95.0), "distance"))
_simple("link_iou", f"SELECT det_id, round(iou, 6) AS iou FROM {_LINKS} WHERE dt = 1", lambda s, d: _r(op.links(_c(s, d)).where("dt = 1").select("det_id", "iou"), "iou"))
_simple("kalman_fit", f"WITH d AS (SELECT *, ((x1 + x2) - (p1 + p2)) / 2 / dt AS vx, ((y1 + y2) - (q1 + q2)) / 2 / dt AS vy FROM {_LINKS} WHERE dt > 0), e AS (SELECT *, vx - lag(vx) OVER w AS ax, vy - lag(vy) OVER w AS ay FROM d WINDOW w AS (PARTITION BY seq_id, track_id ORDER BY frame_id, det_id)) SELECT seq_id, round(greatest(0.01, least(0.5, 2 * median(sqrt(vx * vx + vy * vy) / {H}))), 6) AS position, round(greatest(0.001, least(0.5, 2 * median(sqrt(ax * ax + ay * ay) / {H}))), 6) AS velocity FROM e WHERE dt = 1 GROUP BY seq_id", lambda s, d: _r(op.kalman_fit(_c(s, d)), "position", "velocity"))
_simple("gps_quality", "WITH p AS (SELECT site, camera, round(lat, 6) AS la, round(lon, 6) AS lo, count(*) AS c FROM images GROUP BY ALL), q AS (SELECT site, camera, sum(c)::BIGINT AS n, count(*) / sum(c) AS u, max(c) / sum(c) AS t FROM p GROUP BY ALL) SELECT site, camera, n, round(u, 6) AS unique_share, round(t, 6) AS top_share, n >= 8 AND (u < 0.5 OR t > 0.5) AS frozen FROM q", lambda s, d: _r(op.gps_quality(view(s, d, "images"), ["site", "camera"]), "unique_share", "top_share"))
#: Settings of four trainers, with gates that some sequences miss.
TRAINERS = {
    "small_net": {"annotation_count_preference": "low", "object_size_preference": "small", "required_min_count_per_class": 100},
    "large_net": {"required_min_object_area": 5000.0, "required_percentile": 0.4, "object_size_preference": "medium", "aspect_ratio_preference": "square", "density_preference": "medium"},
    "tiled_net": {"required_max_aspect_ratio_std": 0.9, "required_max_objects_per_frame": 6, "scale_preference": "uniform", "aspect_ratio_preference": "wide"},
    "masked_net": {"required_masks": True},
}
_T = "(x2 - x1) * (y2 - y1)"
_simple("trainer_rank", f"""WITH b AS (SELECT seq_id, count(*) AS n, avg(CASE WHEN {_T} >= 5000 THEN 1.0 ELSE 0.0 END) AS share, stddev_pop((x2 - x1) / (y2 - y1)) AS astd, max({_T}) / min({_T}) > 100 AS multi,
count(*) FILTER ({_T} < 1024) AS ns, count(*) FILTER ({_T} >= 1024 AND {_T} < 9216) AS nm, count(*) FILTER ({_T} >= 9216) AS nl, count(*) FILTER ((x2 - x1) / (y2 - y1) < 0.5) AS nt, count(*) FILTER ((x2 - x1) / (y2 - y1) BETWEEN 0.5 AND 2) AS nq, count(*) FILTER ((x2 - x1) / (y2 - y1) > 2) AS nw FROM truth GROUP BY seq_id),
f AS (SELECT seq_id, avg(n) AS mean, max(n) AS most FROM (SELECT seq_id, count(*) AS n FROM truth GROUP BY seq_id, frame_id) GROUP BY seq_id), k AS (SELECT seq_id, min(n) AS least FROM (SELECT seq_id, count(*) AS n FROM truth GROUP BY seq_id, cls) GROUP BY seq_id), s AS (SELECT * FROM b JOIN f USING (seq_id) JOIN k USING (seq_id)),
o AS (SELECT seq_id, 'small_net' AS trainer, least >= 100 AS eligible, (n < 500)::INT + (ns > nm AND ns >= nl)::INT AS score FROM s UNION ALL SELECT seq_id, 'large_net', share >= 0.4, (nm >= ns AND nm >= nl)::INT + (nq >= nt AND nq >= nw)::INT + (mean > 3 AND mean < 20)::INT FROM s
UNION ALL SELECT seq_id, 'tiled_net', astd <= 0.9 AND most <= 6, (NOT multi)::INT + (nw > nq AND nw > nt)::INT FROM s UNION ALL SELECT seq_id, 'masked_net', false, 0 FROM s)
SELECT seq_id, trainer, eligible, score::DOUBLE AS score, CASE WHEN eligible THEN row_number() OVER (PARTITION BY seq_id, eligible ORDER BY score DESC, trainer) END AS rank FROM o""", lambda s, d: _trainers(s, d).drop("reason"))


def _trainers(spark, sf):
    from ..operators import trainers

    table = trainers.rules(spark, TRAINERS)
    return trainers.evaluate(trainers.detector_statistics(view(spark, sf, "truth"), ["seq_id"], trainers.areas_asked(table)), table, ["seq_id"])




@query("detector_quality")
def detector_quality(spark, sf):
    """Confidences of matched and unmatched boxes, centre error and scale error of matches, lengths of miss runs."""
    return scoring.detector_quality(_c(spark, sf), view(spark, sf, "truth"))


@query("track_buffer_fit")
def track_buffer_fit(spark, sf):
    c, t = _c(spark, sf), view(spark, sf, "truth")
    gaps = scoring.runs(scoring.status(t, scoring.matched_boxes(c, t), "t"), "track_id").where("matched = 0").select("seq_id", F.col("states").alias("misses"))
    return op.track_buffer(gaps)


@query("kmedians")
def kmedians(spark, sf):
    out = op.kmedians(view(spark, sf, "descriptors"), 4, 3)
    return out.select("cluster", F.posexplode("centre").alias("dim", "value"))
