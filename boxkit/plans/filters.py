"""Queries of the row filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as op
from ..registry import query
from .views import view, with_views

def _scored(spark, sf):
    """A distribution over three classes for each computed box."""
    e = lambda name, score: F.struct(name.alias("name"), score.alias("score"))
    c = view(spark, sf, "computed")
    return c.select("seq_id", "frame_id", "det_id", "conf", F.array(e(F.col("cls"), F.col("conf")), e(F.lit("A"), F.lit(0.6) - F.col("conf") / 4), e(F.lit("R"), F.col("conf") / 2)).alias("scores"))


_LONG = "(SELECT det_id, 1 AS i, cls AS name, conf AS score FROM computed UNION ALL SELECT det_id, 2, 'A', 0.6::DOUBLE - conf / 4 FROM computed UNION ALL SELECT det_id, 3, 'R', conf / 2 FROM computed)"


@query("top_class", with_views(f"SELECT det_id, name AS cls, score AS cls_score FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY score DESC, i) AS rn FROM {_LONG}) WHERE rn = 1"))
def top_class(spark, sf):
    return op.top_class(_scored(spark, sf)).select("det_id", "cls", "cls_score")


@query("conf_filter", with_views("SELECT det_id, conf FROM computed WHERE conf >= 0.6"))
def conf_filter(spark, sf):
    return op.conf_filter(view(spark, sf, "computed"), 0.6).select("det_id", "conf")


@query("type_filter", with_views(f"SELECT det_id, max(score) AS cls_score FROM {_LONG} GROUP BY det_id HAVING max(score) >= 0.7"))
def type_filter(spark, sf):
    return op.type_filter(op.top_class(_scored(spark, sf)), 0.7).select("det_id", "cls_score")


@query("fid_shift", with_views("SELECT det_id, frame_id - 1 AS frame_id FROM computed"))
def fid_shift(spark, sf):
    return op.fid_shift(view(spark, sf, "computed"), -1).select("det_id", "frame_id")


@query("fid_window", with_views("SELECT det_id, frame_id - 100 AS frame_id FROM computed WHERE frame_id >= 100 AND frame_id - 100 <= 500 - 100"))
def fid_window(spark, sf):
    return op.fid_window(view(spark, sf, "computed"), 100, 500).select("det_id", "frame_id")


_N = "SELECT det_id FROM (SELECT *, count(*) OVER (PARTITION BY seq_id, track_id) AS n FROM computed) WHERE n >= {}"


@query("drop_single_state", with_views(_N.format(2)))
def drop_single_state(spark, sf):
    return op.tracks_of_states(view(spark, sf, "computed")).select("det_id")


@query("filter_tracks_states", with_views(_N.format(5)))
def filter_tracks_states(spark, sf):
    return op.tracks_of_states(view(spark, sf, "computed"), 5).select("det_id")


@query("filter_tracks_range", with_views("SELECT det_id FROM computed SEMI JOIN (SELECT seq_id, track_id FROM computed GROUP BY ALL HAVING count(*) BETWEEN 3 AND 20 AND avg((x2 - x1) * (y2 - y1)) BETWEEN 4000 AND 12000) t USING (seq_id, track_id)"))
def filter_tracks_range(spark, sf):
    return op.tracks_in_range(view(spark, sf, "computed"), 3, 20, 4000, 12000).select("det_id")


@query("class_replace", with_views("SELECT det_id, coalesce(canonical, cls) AS cls, CASE WHEN canonical IS NULL THEN conf ELSE 1.0::DOUBLE END AS conf FROM computed LEFT JOIN synonyms ON cls = alias"))
def class_replace(spark, sf):
    return op.replace_class(view(spark, sf, "computed"), F.broadcast(view(spark, sf, "synonyms"))).select("det_id", "cls", "conf")


@query("class_hierarchy", with_views(f"SELECT det_id, canonical AS cls, max(score) AS score FROM {_LONG} JOIN synonyms ON name = alias GROUP BY ALL"))
def class_hierarchy(spark, sf):
    return op.class_hierarchy(_scored(spark, sf), view(spark, sf, "synonyms"))


@query("target_class_view", with_views("SELECT det_id, 'R' AS cls, CASE WHEN cls = 'R' THEN conf ELSE conf / 2 END AS conf FROM computed WHERE CASE WHEN cls = 'R' THEN conf ELSE conf / 2 END >= 0.3"))
def target_class_view(spark, sf):
    return op.class_view(_scored(spark, sf), "R", 0.3).select("det_id", "cls", "conf")


@query("relabel_all", with_views("SELECT det_id, 'object' AS cls FROM computed"))
def relabel_all(spark, sf):
    return view(spark, sf, "computed").select("det_id", F.lit("object").alias("cls"))


@query("top_n_classes", with_views(f"SELECT det_id, rn AS place, name, score FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY score DESC, name) AS rn FROM {_LONG}) WHERE rn <= 2"))
def top_n_classes(spark, sf):
    out = op.top_n_classes(_scored(spark, sf), 2).select("det_id", F.posexplode("scores").alias("place", "e"))
    return out.select("det_id", (F.col("place") + 1).cast("long").alias("place"), "e.name", "e.score")


@query("filter_frames", with_views("SELECT DISTINCT seq_id, frame_id FROM computed WHERE conf >= 0.9"))
def filter_frames(spark, sf):
    c = view(spark, sf, "computed")
    return op.filter_frames(c.select("seq_id", "frame_id").distinct(), c, 0.9)


@query("filter_frames_inverted", with_views("SELECT seq_id, frame_id FROM computed GROUP BY ALL HAVING max(conf) < 0.9"))
def filter_frames_inverted(spark, sf):
    c = view(spark, sf, "computed")
    return op.filter_frames(c.select("seq_id", "frame_id").distinct(), c, 0.9, inverted=True)


@query("filter_frame_index")
def filter_frame_index(spark, sf):
    return op.sample_frames(view(spark, sf, "computed").where("frame_id BETWEEN 10 AND 5000").select("seq_id", "frame_id").distinct(), 7)


@query("suppress_small", with_views("SELECT det_id FROM computed WHERE x2 - x1 >= 55 AND y2 - y1 >= 55"))
def suppress_small(spark, sf):
    c = view(spark, sf, "computed")
    return op.suppress_small(c, 55).select("det_id")


@query("add_fixed", with_views("SELECT seq_id, frame_id, x1, y1, x2, y2, conf, cls FROM computed UNION ALL SELECT DISTINCT seq_id, frame_id, 0.0::DOUBLE, 0.0::DOUBLE, 1920.0::DOUBLE, 1080.0::DOUBLE, 1.0::DOUBLE, 'generic' FROM truth"))
def add_fixed(spark, sf):
    return op.add_fixed(view(spark, sf, "computed"), view(spark, sf, "truth").select("seq_id", "frame_id").distinct(), 1920, 1080, "generic")


@query("to_full_frame", with_views("SELECT seq_id, frame_id, cls, min(det_id) AS det_id, 0.0::DOUBLE AS x1, 1080.0::DOUBLE AS y2 FROM computed GROUP BY seq_id, frame_id, cls"))
def to_full_frame(spark, sf):
    return op.to_full_frame(view(spark, sf, "computed"), 1920, 1080).select("seq_id", "frame_id", "cls", "det_id", "x1", "y2")


@query("notes_to_attrs", "SELECT p_partkey AS id, '(atr) brand ' || p_brand AS attr FROM part UNION ALL SELECT p_partkey, '(atr) size ' || p_size FROM part")
def notes_to_attrs(spark, sf):
    p = view(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.concat(F.lit(":brand="), "p_brand"), F.lit("seen twice"), F.concat(F.lit(":size="), "p_size")).alias("notes"))
    return p.select("id", F.explode(op.notes_to_attrs("notes")).alias("attr"))


@query("ts_from_filename", "SELECT event_id, TIMESTAMP '1970-01-01' + to_microseconds(CASE event_id % 8 WHEN 6 THEN us // 1000000 * 1000000 + 107 WHEN 7 THEN event_id % 1000 + 1000000 WHEN 2 THEN us ELSE us // 1000 * 1000 END) AS ts FROM (SELECT event_id, epoch_us(ts) AS us FROM events)")
def ts_from_filename(spark, sf):
    """Names of each known spelling, and two that have to be found out."""
    e = view(spark, sf, "events")
    t = lambda p: F.date_format("ts", p)
    name = [
        F.concat(F.lit("CHESS_FL1_C_"), t("yyMMdd_HHmmss.SSS"), F.lit("_COLOR-8-BIT.JPG")), F.concat(F.lit("d/CHESS2016_N94S_FL23_P__"), t("yyyyMMddHHmmss.SSS"), F.lit("GMT_THERM-16BIT.PNG")),
        F.concat(F.lit("a_b_"), t("yyyyMMdd_HHmmss.SSSSSS"), F.lit("_rgb.tif")), F.concat(t("yyyyMMdd.HHmmss.SSS"), F.lit(".017459.png")), F.concat(F.lit("00231.00232."), t("yyyyMMdd.HHmmss.SSS"), F.lit(".004021.tif")),
        F.concat(F.lit("201503."), t("yyyyMMdd.HHmmssSSS"), F.lit(".76450.png")), F.concat(F.lit("cam1_"), t("yyyyMMdd_HHmmss"), F.lit("_07.png")), F.concat(F.lit("image-number-"), F.lpad((F.col("event_id") % 1000 + 1000000).cast("string"), 12, "0"), F.lit(".png")),
    ]
    e = e.select("event_id", F.element_at(F.array(*name), (F.col("event_id") % 8 + 1).cast("int")).alias("name"))
    return e.select("event_id", op.ts_from_filename("name").cast("timestamp_ntz").alias("ts"))


@query("name_parse", with_views("SELECT site, frame, strftime(time_utc, '%Y%m%d') AS day, camera, count(*) AS n FROM images GROUP BY ALL"))
def name_parse(spark, sf):
    name = F.concat(F.date_format("time_utc", "yyyyMMdd"), F.lit("_S"), "site", F.lit("_SL"), "camera", F.lpad(F.col("frame").cast("string"), 9, "0"))
    x = view(spark, sf, "images").select(name.alias("name")).select(*(c.alias(k) for k, c in op.parse_name("name").items()))
    return x.groupBy("site", "frame", "day", "camera").agg(F.count("*").alias("n"))


@query("head_tail_to_box", with_views("SELECT det_id, (x1 + x2) / 2 - abs(x1 - x2) * 1.2 / 2 AS x1, (y2 + y1) / 2 - abs(y2 - y1) * 1.2 / 2 AS y1, (x1 + x2) / 2 + abs(x1 - x2) * 1.2 / 2 AS x2, (y2 + y1) / 2 + abs(y2 - y1) * 1.2 / 2 AS y2 FROM (SELECT det_id, x1, y1, x2, y2 FROM truth)"))
def head_tail_to_box(spark, sf):
    c = F.col
    return view(spark, sf, "truth").select("det_id", *op.head_tail_box((c("x1"), c("y2")), (c("x2"), c("y1")), 1.2))


@query("apply_homography_boxes", with_views("SELECT det_id, round(2 * x1 + frame_id % 5, 6) AS x1, round(2 * y1 - 3, 6) AS y1, round(2 * x2 + frame_id % 5, 6) AS x2, round(2 * y2 - 3, 6) AS y2 FROM truth"))
def apply_homography_boxes(spark, sf):
    t = view(spark, sf, "truth")
    d = lambda x: F.lit(float(x))
    h = t.select("seq_id", "frame_id").distinct().withColumn("h", F.array(d(2), d(0), (F.col("frame_id") % 5).cast("double"), d(0), d(2), d(-3), d(0), d(0), d(1)))
    w = op.warp_boxes(t.select("seq_id", "frame_id", "det_id", "x1", "y1", "x2", "y2"), h)
    return w.select("det_id", *(F.round(k, 6).alias(k) for k in ("x1", "y1", "x2", "y2")))


@query(
    "tile_layout",
    """WITH i AS (SELECT p_partkey AS img, 500 + p_size * 10 AS img_w, 400 + p_size * 7 AS img_h FROM part),
x AS (SELECT DISTINCT img, img_w, img_h, least(k * 200, greatest(0, img_w - 300)) AS tx FROM i, range(0, 20) r(k) WHERE k <= greatest(0, ceil((img_w - 300) / 200.0))),
y AS (SELECT DISTINCT img, least(k * 200, greatest(0, img_h - 300)) AS ty FROM i, range(0, 20) r(k) WHERE k <= greatest(0, ceil((img_h - 300) / 200.0)))
SELECT img, tx::BIGINT AS tx, ty::BIGINT AS ty, least(tx + 300, img_w)::BIGINT AS tx2, least(ty + 300, img_h)::BIGINT AS ty2 FROM x JOIN y USING (img)""",
)
def tile_layout(spark, sf):
    i = view(spark, sf, "part").selectExpr("p_partkey AS img", "500 + p_size * 10 AS img_w", "400 + p_size * 7 AS img_h")
    return op.tiles(i, 300, 200).select("img", *(F.col(k).cast("long").alias(k) for k in ("tx", "ty", "tx2", "ty2")))


@query("tile_to_image_coords", with_views("SELECT det_id, x1 / 0.5 + frame_id % 3 * 100 AS x1, y1 / 0.5 + 40 AS y1, x2 / 0.5 + frame_id % 3 * 100 AS x2, y2 / 0.5 + 40 AS y2 FROM computed"))
def tile_to_image_coords(spark, sf):
    c = view(spark, sf, "computed").selectExpr("det_id", "x1", "y1", "x2", "y2", "0.5D AS scale", "frame_id % 3 * 100 AS tx", "40 AS ty")
    return op.tile_to_image(c).select("det_id", "x1", "y1", "x2", "y2")


_CHIPS = "(SELECT gx * 100.0 AS tx, gy * 60.0 AS ty, gx * 100.0 + 160.0 AS tx2, gy * 60.0 + 120.0 AS ty2 FROM range(0, 4) a(gx), range(0, 3) b(gy))"


@query(
    "preferred_tile",
    with_views(f"""SELECT det_id, tx, ty, inside, round(overlap, 6) AS overlap FROM (
SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY inside DESC, CASE WHEN inside THEN margin END DESC NULLS LAST, overlap DESC, tx, ty) AS rn FROM (
SELECT det_id, CAST(tx AS DOUBLE) AS tx, CAST(ty AS DOUBLE) AS ty, x1 >= tx AND y1 >= ty AND x2 <= tx2 AND y2 <= ty2 AS inside, least(x1 - tx, y1 - ty, tx2 - x2, ty2 - y2) AS margin,
greatest(0.0, least(x2, tx2) - greatest(x1, tx)) * greatest(0.0, least(y2, ty2) - greatest(y1, ty)) AS overlap
FROM truth, {_CHIPS} c) WHERE overlap > 0) WHERE rn = 1"""),
)
def preferred_tile(spark, sf):
    chips = spark.range(0, 4).crossJoin(spark.range(0, 3).withColumnRenamed("id", "gy")).selectExpr("id * 100.0D AS tx", "gy * 60.0D AS ty", "id * 100.0D + 160 AS tx2", "gy * 60.0D + 120 AS ty2")
    out = op.preferred_tile(view(spark, sf, "truth").select("det_id", "x1", "y1", "x2", "y2"), F.broadcast(chips))  # twelve chips
    return out.select("det_id", "tx", "ty", "inside", F.round("overlap", 6).alias("overlap"))
