"""Summaries of annotations and statistics of data sets.

Medians and percentiles "by index" are the element at floor(n * share) of the
sorted values, as trainers take them; they are picked by rank, not interpolated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import box
from ..shared import stored
from .quantiles import by_index

TRACK = ["seq_id", "track_id"]
FRAME = ["seq_id", "frame_id"]


def type_list(df: DataFrame, capitals: bool = False) -> DataFrame:
    out = df.select("cls").distinct()
    return out.where(F.col("cls").rlike("[A-Z]")) if capitals else out


def track_count(df: DataFrame) -> DataFrame:
    """Distinct tracks over files, and states."""
    return df.agg(F.countDistinct(*TRACK).alias("tracks"), F.count("*").alias("states"))


def type_track_count(df: DataFrame) -> DataFrame:
    return df.groupBy("cls").agg(F.countDistinct(*TRACK).alias("tracks"))


def counts_per_frame(df: DataFrame) -> DataFrame:
    return df.groupBy(*FRAME, "cls").agg(F.count("*").alias("n"))


def avg_box_size(df: DataFrame) -> DataFrame:
    return df.groupBy("cls").agg(F.avg(box.area()).alias("area"), F.count("*").alias("n"))


def comp_matrix(df: DataFrame, classes: list[str]) -> DataFrame:
    """Distinct tracks per file and class, 0 where there are none."""
    return df.groupBy("seq_id").pivot("cls", classes).agg(F.countDistinct("track_id")).fillna(0)


def only_single(df: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose tracks all have one state, or that have none."""
    many = df.groupBy(*TRACK).count().where("count > 1").select("seq_id")
    return files.join(many, "seq_id", "left_anti")


def max_count(df: DataFrame, around: int = 2) -> DataFrame:
    """Per file and class the frame with the highest count smoothed by a centred maximum; the first of equal ones."""
    c = counts_per_frame(df)
    w = Window.partitionBy("seq_id", "cls").orderBy("frame_id").rangeBetween(-around, around)
    s = c.withColumn("smooth", F.max("n").over(w))
    return s.groupBy("seq_id", "cls").agg(F.max(F.struct("smooth", (-F.col("frame_id")).alias("f"))).alias("m")).select("seq_id", "cls", F.col("m.smooth").alias("max_n"), (-F.col("m.f")).alias("frame_id"))


def ranked_frames(df: DataFrame, most: int) -> DataFrame:
    c = df.groupBy(*FRAME).agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("n"), "frame_id"))).where(F.col("rank") <= most)


def det_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest, largest, mean and indexed percentiles of width, height and area, and counts of size bins."""
    df = stored(df.select(*keys, *box.names()), "boxes")  # read once for each statistic and pass
    base = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *(f(e).alias(f"{k}_{name}") for k, e in (("width", box.width()), ("height", box.height()), ("area", box.area())) for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))),
        F.count_if(box.area() < 32 * 32).alias("small"),
        F.count_if((box.area() >= 32 * 32) & (box.area() < 96 * 96)).alias("medium"),
        F.count_if(box.area() >= 96 * 96).alias("large"),
    )
    # the ranks of all three in the same passes
    measures = (("width", box.width()), ("height", box.height()), ("area", box.area()))
    shares = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    values = df.select(*keys, F.inline(F.array(*(F.struct(F.lit(k).alias("measure"), e.cast("double").alias("v")) for k, e in measures))))
    ranks = by_index(values, F.col("v"), shares, [*keys, "measure"])
    return base.join(ranks.groupBy(*keys).agg(*(F.max(F.when(F.col("measure") == k, F.col(s))).alias(f"{k}_{s}") for k, _ in measures for s in shares)), keys)


def aspect_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    a = box.width() / box.height()
    return df.where(box.height() > 0).groupBy(*keys).agg(F.avg(a).alias("mean"), F.stddev_pop(a).alias("std"), F.count_if(a < 0.5).alias("tall"), F.count_if((a >= 0.5) & (a <= 2)).alias("square"), F.count_if(a > 2).alias("wide"))


def density_stats(df: DataFrame, frames: DataFrame, crowded: int = 20, sparse: int = 3) -> DataFrame:
    """Boxes per frame, empty frames included."""
    n = frames.join(df.groupBy(*FRAME).agg(F.count("*").alias("n")), FRAME, "left").fillna(0, ["n"])
    return n.groupBy("seq_id").agg(F.avg("n").alias("mean"), F.max("n").alias("max"), F.count_if(F.col("n") >= crowded).alias("crowded"), F.count_if((F.col("n") > 0) & (F.col("n") <= sparse)).alias("sparse"), F.count_if(F.col("n") == 0).alias("empty"))


def scale_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.var_pop(F.sqrt(box.area())).alias("variance"), (F.max(box.area()) / F.min(box.area())).alias("ratio")).withColumn("multi_scale", F.col("ratio") > 100)


def class_balance(df: DataFrame, rare: int = 50, dominant: int = 500) -> DataFrame:
    """The largest class over the smallest one, and how many classes have fewer boxes than rare and more than dominant."""
    c = df.groupBy("cls").agg(F.count("*").alias("n"))
    return c.agg((F.max("n") / F.min("n")).alias("imbalance"), F.count_if(F.col("n") < rare).alias("rare"), F.count_if(F.col("n") > dominant).alias("dominant"))


def edge_stats(df: DataFrame, margin: float) -> DataFrame:
    """Boxes near the border of a file's frame, which is estimated by the largest coordinates."""
    size = df.groupBy("seq_id").agg(F.max("x2").alias("w"), F.max("y2").alias("h"))
    near = (F.col("x1") <= margin) | (F.col("y1") <= margin) | (F.col("x2") >= F.col("w") - margin) | (F.col("y2") >= F.col("h") - margin)
    return df.join(size, "seq_id").groupBy("seq_id").agg(F.count_if(near).alias("near"), F.count("*").alias("n"))


def mask_fraction(df: DataFrame, keys: list[str], mask: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(mask).isNotNull().cast("double")).alias("share"))


def track_stats(df: DataFrame, short: int = 10, long: int = 50) -> DataFrame:
    t = df.groupBy(*TRACK).agg(F.count("*").alias("n"))
    base = t.groupBy("seq_id").agg(F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.count_if(F.col("n") < short).alias("short"), F.count_if((F.col("n") >= short) & (F.col("n") < long)).alias("medium"), F.count_if((F.col("n") >= short) & (F.col("n") >= long)).alias("long"))
    return base.join(by_index(t, F.col("n"), {"median": 0.5}, ["seq_id"]), "seq_id")


def concurrency_stats(df: DataFrame, crowded: int = 20, sparse: int = 3) -> DataFrame:
    n = df.groupBy(*FRAME).agg(F.countDistinct("track_id").alias("n"))
    return n.groupBy("seq_id").agg(F.avg("n").alias("mean"), F.max("n").alias("max"), F.count_if(F.col("n") >= crowded).alias("crowded"), F.count_if((F.col("n") > 0) & (F.col("n") <= sparse)).alias("sparse"))


def size_cv(df: DataFrame, high: float = 0.5) -> DataFrame:
    t = df.groupBy(*TRACK).agg((F.stddev_pop(box.area()) / F.avg(box.area())).alias("cv"))
    return t.groupBy("seq_id").agg(F.avg("cv").alias("mean_cv"), F.avg((F.col("cv") > high).cast("double")).alias("high_share"))


def length_agg(df: DataFrame, length: str = "length") -> DataFrame:
    """Per track the mean, median and interquartile mean of its positive lengths."""
    t = df.where(F.col(length) > 0).groupBy(*TRACK).agg(F.sort_array(F.collect_list(length)).alias("v"))
    n = F.size("v")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    median = F.when(n % 2 == 1, F.element_at("v", F.floor(n / 2).cast("int") + 1)).otherwise((F.element_at("v", F.floor(n / 2).cast("int")) + F.element_at("v", F.floor(n / 2).cast("int") + 1)) / 2)
    q1, q3 = F.floor(n / 4).cast("int"), F.floor(3 * n / 4).cast("int")
    inner = F.when(n < 4, F.col("v")).otherwise(F.slice("v", q1 + 1, F.greatest(q3 - q1, F.lit(1))))
    return t.select(*TRACK, n.alias("n"), mean(F.col("v")).alias("mean"), median.alias("median"), mean(inner).alias("trimmed"))


def gsd(df: DataFrame, w: float, h: float, margin: float) -> DataFrame:
    """Per frame the length by box width ratio at index floor(0.45 n) among the best graded boxes.

    Grades: valid and clear of the border, valid, any.
    """
    ratio = F.col("length") / box.width()
    valid = (F.col("length") > 0) & (box.width() > 0)
    clear = (F.col("x1") > margin) & (F.col("y1") > margin) & (F.col("x2") < w - margin) & (F.col("y2") < h - margin)
    g = df.where(box.width() > 0).withColumn("ratio", ratio).withColumn("grade", F.when(valid & clear, 0).when(valid, 1).otherwise(2))
    best = g.groupBy(*FRAME).agg(F.min("grade").alias("grade"))
    return by_index(g.join(best, [*FRAME, "grade"]), F.col("ratio"), {"gsd": 0.45}, FRAME)


def _clip(e: Column, lo, hi) -> Column:
    """Within lo and hi; where they cross, hi."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(as_column(hi), F.greatest(as_column(lo), e))


def thresholds(df: DataFrame, keys: list[str]) -> DataFrame:
    """Score thresholds of a two-stage tracker from matched and unmatched confidences (conf, matched).

    high keeps most of the hits; low lies below it and above most of the misfires; new, for new tracks, above high.
    """
    m, u = F.when(F.col("matched") == 1, F.col("conf")), F.when(F.col("matched") == 0, F.col("conf"))
    p = df.groupBy(*keys).agg(F.percentile(m, 0.25).alias("p25"), F.percentile(m, 0.02).alias("p2"), F.percentile(m, 0.4).alias("p40"), F.percentile(u, 0.6).alias("u60"))
    p = p.withColumn("high", _clip(F.col("p25"), 0.05, 0.95))
    return p.select(*keys, "high", _clip(F.greatest("p2", "u60"), 0.01, F.col("high") - 0.05).alias("low"), _clip(F.col("p40"), F.col("high"), 0.95).alias("new"))


def links(df: DataFrame) -> DataFrame:
    """Consecutive states of tracks: the box before, frames between, overlap."""
    w = Window.partitionBy(*TRACK).orderBy("frame_id", "det_id")
    d = df.withColumns({f"p_{k}": F.lag(k).over(w) for k in (*box.names(), "frame_id")})
    d = d.withColumn("dt", F.col("frame_id") - F.col("p_frame_id"))
    centre = lambda p, k: (F.col(f"{p}{k}1") + F.col(f"{p}{k}2")) / 2
    speed = [F.when(F.col("dt") > 0, (centre("", k) - centre("p_", k)) / F.col("dt")).alias(f"v{k}") for k in "xy"]
    return d.where("dt IS NOT NULL").select(*df.columns, *(f"p_{k}" for k in box.names()), "dt", box.iou("", "p_").alias("iou"), box.distance("", "p_").alias("moved"), *speed)


def kalman_fit(df: DataFrame, least: int = 10) -> DataFrame:
    """Weights of position and velocity noise per sequence: twice the median step, and change of the velocity vector, over box height.

    Steps and changes are those over one frame; a change is that from the link before of the same track. Clipped, and the
    usual 1/20 and 1/160 where there are too few boxes or none to measure.
    """
    w = Window.partitionBy(*TRACK).orderBy("frame_id", "det_id")
    d = links(df).where("dt > 0").withColumn("tall", box.height() > 0)
    d = d.withColumns({f"a{k}": F.col(f"v{k}") - F.lag(f"v{k}").over(w) for k in "xy"})
    size = lambda a, b: F.when((F.col("dt") == 1) & F.col("tall"), F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b)) / box.height())
    fit = d.groupBy("seq_id").agg(F.median(size("vx", "vy")).alias("step"), F.median(size("ax", "ay")).alias("change"))
    n = df.groupBy("seq_id").agg(F.count("*").alias("n"))
    enough = lambda c, lo, hi, usual: F.when((F.col("n") >= least) & F.col(c).isNotNull(), _clip(2 * F.col(c), lo, hi)).otherwise(usual)
    return n.join(fit, "seq_id", "left").select("seq_id", enough("step", 0.01, 0.5, 1 / 20).alias("position"), enough("change", 0.001, 0.5, 1 / 160).alias("velocity"))


def match_gate(df: DataFrame, admitted: float = 99.5, least: int = 100, lowest: float = 0.02, highest: float = 0.5, usual: float = 0.8) -> DataFrame:
    """Per sequence the largest distance (1 - overlap) at which boxes match: links over one frame that are admitted have it or less.

    The overlap that so many percent of the links reach is clipped; with few links the usual value.
    """
    g = links(df).where("dt = 1").groupBy("seq_id").agg(F.count("*").alias("links"), F.percentile("iou", (100 - admitted) / 100).alias("gate"))
    g = df.select("seq_id").distinct().join(g, "seq_id", "left").fillna(0, ["links"])
    return g.select("seq_id", "links", F.when(F.col("links") >= least, 1 - _clip(F.col("gate"), lowest, highest)).otherwise(usual).alias("distance"))


def track_buffer(gaps: DataFrame) -> DataFrame:
    """Frames to keep lost tracks: the 90th percentile of miss runs by 1.5 and 5 more, within 10 and 100."""
    return gaps.groupBy("seq_id").agg(F.greatest(F.lit(10), F.least(F.lit(100), (F.percentile("misses", 0.9) * 1.5 + 5).cast("int"))).alias("buffer"))


def gps_quality(df: DataFrame, keys: list[str]) -> DataFrame:
    """Frozen tracks: of eight positions or more, less than half unique or one held by more than half."""
    p = df.groupBy(*keys, F.round("lat", 6).alias("la"), F.round("lon", 6).alias("lo")).agg(F.count("*").alias("c"))
    q = p.groupBy(*keys).agg(F.sum("c").alias("n"), (F.count("*") / F.sum("c")).alias("unique_share"), (F.max("c") / F.sum("c")).alias("top_share"))
    return q.withColumn("frozen", (F.col("n") >= 8) & ((F.col("unique_share") < 0.5) | (F.col("top_share") > 0.5)))


def kmedians(df: DataFrame, k: int, rounds: int, key: str = "uid", vec: str = "vec", seed: str = "0") -> DataFrame:
    """Centres by city-block distance; a round assigns by k broadcast centres and takes medians per dimension."""
    spark = df.sparkSession
    centres = [r[0] for r in df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))).limit(k).select(vec).collect()]
    for _ in range(rounds):
        table = F.broadcast(spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "c int, centre array<double>"))  # k rows
        d = F.aggregate(F.zip_with(F.col(vec), F.col("centre"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
        near = df.crossJoin(table).groupBy(key).agg(F.min(F.struct(d.alias("d"), "c")).alias("m"), F.first(vec).alias(vec)).select(F.col("m.c").alias("c"), vec)
        med = near.select("c", F.posexplode(vec)).groupBy("c", "pos").agg(F.median("col").alias("v")).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("a"))
        found = {r[0]: [x.v for x in r[1]] for r in med.collect()}
        centres = [found.get(i, c) for i, c in enumerate(centres)]
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cluster int, centre array<double>")
