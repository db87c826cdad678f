"""Queries of ground coverage and of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import box, geo
from ..functions import vec as V
from ..operators import survey as op
from ..registry import query
from .views import view, with_views

_I = "(SELECT site, frame AS ord, camera, pass_no, strftime(time_utc, '%Y%m%d') AS day, frame // 3 AS step, lat, lon, (lon + 160) * 60000 AS e, (lat - 55) * 100000 AS n FROM images WHERE site < 5)"
#: Axis-parallel footprints of 400 x 300 m, wound as the operator wants them.
_CELLS = "(SELECT site, ord, camera, pass_no, cx AS cell_x, cy AS cell_y FROM (SELECT *, unnest(range(floor((e - 200) / 50)::BIGINT, floor((e + 200) / 50)::BIGINT + 1)) AS cx FROM " + _I + ") a, range(-10, 60) r(cy) WHERE (cx + 0.5) * 50 BETWEEN e - 200 AND e + 200 AND (cy + 0.5) * 50 BETWEEN n - 150 AND n + 150)"


def _images(spark, sf):
    return view(spark, sf, "images").selectExpr("site", "frame AS ord", "camera", "pass_no", "date_format(time_utc, 'yyyyMMdd') AS day", "frame DIV 3 AS step", "(lon + 160) * 60000 AS e", "(lat - 55) * 100000 AS n")


def _quads(spark, sf):
    q = F.array(*(F.struct((F.col("e") + dx).alias("x"), (F.col("n") + dy).alias("y")) for dx, dy in ((-200.0, 150.0), (200.0, 150.0), (200.0, -150.0), (-200.0, -150.0))))
    return _images(spark, sf).withColumn("quad", q)


@query("footprints", with_views("""WITH o AS (SELECT site, arg_min(lat, (time_utc, frame)) AS lat0, arg_min(lon, (time_utc, frame)) AS lon0 FROM images GROUP BY site),
p AS (SELECT i.*, (lon - lon0) * 111320 * cos(radians(lat0)) AS e, (lat - lat0) * 111320 AS n FROM images i JOIN o USING (site))
SELECT site, frame, round(e, 4) AS e, round(n, 4) AS n, round((degrees(atan2(coalesce(lead(e) OVER w, e) - coalesce(lag(e) OVER w, e), coalesce(lead(n) OVER w, n) - coalesce(lag(n) OVER w, n))) + 360) % 360, 4) AS heading FROM p WINDOW w AS (PARTITION BY site, camera, pass_no ORDER BY frame)"""))
def footprints(spark, sf):
    return op.footprints(view(spark, sf, "images"), 0.6, 0.4).select("site", "frame", *(F.round(k, 4).alias(k) for k in ("e", "n", "heading")))


@query("coverage_first", with_views(f"SELECT site, cell_x, cell_y, min(ord) AS first_ord FROM {_CELLS} GROUP BY ALL"))
def coverage_first(spark, sf):
    once = _quads(spark, sf).groupBy("site", "quad").agg(F.min("ord").alias("ord"))
    return op.first_seen(op.cells(once, 50.0))


_FIRST = f"(SELECT c.*, min(ord) OVER (PARTITION BY site, cell_x, cell_y) AS first_ord FROM {_CELLS} c)"


@query("prior_fraction", with_views(f"SELECT site, ord, round(avg(CASE WHEN first_ord < ord THEN 1.0 ELSE 0.0 END), 6) AS prior, count(*) AS cells FROM {_FIRST} GROUP BY site, ord"))
def prior_fraction(spark, sf):
    return op.footprint_fraction(_quads(spark, sf), 50.0).withColumn("prior", F.round("prior", 6))


_SRC = f"""(SELECT p.*, CASE WHEN a.day IS DISTINCT FROM b.day OR a.pass_no IS DISTINCT FROM b.pass_no OR abs(a.step - b.step) > 17 THEN 'revisit' WHEN a.camera = b.camera THEN 'sequential' ELSE 'cross_camera' END AS kind
FROM (SELECT site, ord, first_ord AS src, count(*) AS shared FROM {_FIRST} WHERE first_ord < ord GROUP BY ALL) p JOIN {_I} a ON a.site = p.site AND a.ord = p.ord JOIN {_I} b ON b.site = p.site AND b.ord = p.src)"""


@query("prior_class", with_views(f"SELECT site, ord, src, shared, kind FROM {_SRC}"))
def prior_class(spark, sf):
    return op.footprint_kinds(_quads(spark, sf), 50.0, 17).select("site", "ord", F.inline("sources"))


@query("revisits", with_views(f"SELECT r.site, r.ord, src, round(shared / cells, 6) AS overlap FROM (SELECT site, ord, arg_max(src, (shared, -src)) AS src, sum(shared) AS shared FROM {_SRC} WHERE kind = 'revisit' GROUP BY ALL) r JOIN (SELECT site, ord, count(*) AS cells FROM {_CELLS} GROUP BY ALL) USING (site, ord)"))
def revisits(spark, sf):
    out = op.revisits(op.footprint_kinds(_quads(spark, sf), 50.0, 17))
    return out.withColumn("overlap", F.round("overlap", 6))


_PTS = "(SELECT DISTINCT o_custkey AS image_id, l_partkey AS point_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _points(spark, sf):
    return view(spark, sf, "orders").join(view(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("image_id"), F.col("l_partkey").alias("point_id")).distinct()


@query("overlap_pairs", f"SELECT image_id, partner, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY shared DESC, partner) AS rank FROM (SELECT a.image_id, b.image_id AS partner, count(*) AS shared FROM {_PTS} a JOIN {_PTS} b ON a.point_id = b.point_id AND a.image_id <> b.image_id GROUP BY ALL)) WHERE rank <= 5")
def overlap_pairs(spark, sf):
    return op.overlap_pairs(_points(spark, sf), 5)


@query("prior_points", f"SELECT image_id, count(*) FILTER (f < image_id) AS prior, count(*) AS points FROM (SELECT *, min(image_id) OVER (PARTITION BY point_id) AS f FROM {_PTS}) GROUP BY image_id")
def prior_points(spark, sf):
    return op.prior_points(_points(spark, sf).withColumn("ord", F.col("image_id")))


@query("fn_box", with_views("SELECT det_id, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x1 + x2) / 2 - (x2 - x1) * 1.5 / 2 AS sx1 FROM truth"))
def fn_box(spark, sf):
    cx, cy = box.centre()
    return view(spark, sf, "truth").select("det_id", box.area().alias("area"), cx.alias("cx"), cy.alias("cy"), box.scaled(1.5)[0].alias("sx1"))


@query("fn_poly", with_views("SELECT det_id, round((x2 - x1) * (y2 - y1) / 2, 6) AS area FROM truth"))
def fn_poly(spark, sf):
    return view(spark, sf, "truth").select("det_id", F.round(geo.polygon_area(F.array("x1", "x2", "x1"), F.array("y1", "y1", "y2")), 6).alias("area"))


@query("fn_rle", "SELECT p_partkey AS id, (p_size * 2 + 7)::BIGINT AS area FROM part")
def fn_rle(spark, sf):
    return view(spark, sf, "part").select(F.col("p_partkey").alias("id"), geo.rle_area(F.array(F.lit(5), F.col("p_size") * 2, F.lit(3), F.lit(7))).alias("area"))


@query("fn_vec", with_views("SELECT uid, round(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 6) AS norm, round(list_sum(list_transform(vec, lambda x: x::DOUBLE)), 5) AS total FROM descriptors"))
def fn_vec(spark, sf):
    v = view(spark, sf, "descriptors")
    return v.select("uid", F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(V.total(F.transform("vec", lambda x: x.cast("double"))), 5).alias("total"))


@query("fn_geo", with_views("SELECT site, frame, round(sign(v) * (floor(abs(v) / 100) + (abs(v) - floor(abs(v) / 100) * 100) / 60), 8) AS deg FROM (SELECT site, frame, -1 * (5500 + frame % 4000 / 100.0)::DOUBLE AS v FROM images)"))
def fn_geo(spark, sf):
    return view(spark, sf, "images").select("site", "frame", F.round(geo.nmea_degrees(-(5500 + F.col("frame") % 4000 / 100.0)), 8).alias("deg"))


@query("fn_string", "SELECT p_partkey AS id, lower(trim(p_name)) AS name, regexp_matches(p_brand, '[A-Z]') AS capital, split_part(p_name, ' ', 1) AS first FROM part")
def fn_string(spark, sf):
    return view(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower(F.trim("p_name")).alias("name"), F.col("p_brand").rlike("[A-Z]").alias("capital"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"))


@query("fn_time", "SELECT event_id, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, (epoch_us(ts) // 100000)::BIGINT AS frame FROM events")
def fn_time(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return view(spark, sf, "events").select("event_id", us.alias("us"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.floor(us / 100000).cast("long").alias("frame"))


@query("fn_pair", "SELECT o_orderkey AS id, ((o_custkey + o_orderkey) * (o_custkey + o_orderkey + 1) // 2 + o_orderkey)::BIGINT AS pair FROM orders")
def fn_pair(spark, sf):
    return view(spark, sf, "orders").selectExpr("o_orderkey AS id", "(o_custkey + o_orderkey) * (o_custkey + o_orderkey + 1) DIV 2 + o_orderkey AS pair")


@query("fn_stereo", with_views("SELECT det_id, round(1000.0 * 0.2 / (8.0 + det_id % 5), 6) AS z, round((x2 - x1) * (1000.0 * 0.2 / (8.0 + det_id % 5)) / 1000.0, 6) AS length FROM truth"))
def fn_stereo(spark, sf):
    """Depth and head-to-tail length from the disparity of a rectified pair (focal length 1000 px, base 0.2 m)."""
    z = 1000.0 * 0.2 / (8.0 + F.col("det_id") % 5)
    return view(spark, sf, "truth").select("det_id", F.round(z, 6).alias("z"), F.round(box.width() * z / 1000.0, 6).alias("length"))
