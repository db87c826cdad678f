"""Scores of computed boxes and tracks against truth.

All scores start from match tables with one row per matched pair; frames are
matched in parallel, and later steps aggregate. Curves first sum rows of equal
confidence; running sums over single detections go by confidence bands, so no
task sorts all detections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import box
from ..shared import stored
from . import matching as m

FRAME = ["seq_id", "frame_id"]
TRACKS = ("c_track_id", "t_track_id")
BANDS = 1024


def ratio(a, b):
    return F.when(b != 0, a / b).otherwise(0.0)


def rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, fdr, miss rate and mcc to tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    df = df.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", ratio(2 * p * r, p + r)).withColumn("fdr", ratio(fp, tp + fp)).withColumn("miss_rate", ratio(fn, tp + fn)).withColumn("mcc", F.sqrt(p * r) - F.sqrt((1 - p) * (1 - r)))


def counts(computed: DataFrame, truth: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tp, fp, fn, n_computed and n_truth."""
    one = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    out = one(computed, "n_computed").join(one(truth, "n_truth"), keys, "full").join(one(matches, "tp"), keys, "left").fillna(0, ["n_computed", "n_truth", "tp"])
    return out.withColumn("fp", F.col("n_computed") - F.col("tp")).withColumn("fn", F.col("n_truth") - F.col("tp"))


def detection(computed: DataFrame, truth: DataFrame, least: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn and rates per key (default: class within sequence); matching within frame and class when keyed by class."""
    keys = keys or ["seq_id", "cls"]
    match_keys = [*FRAME, "cls"] if "cls" in keys else FRAME
    return rates(counts(computed, truth, m.match_greedy(computed, truth, least, match_keys), keys))


def matched_boxes(computed: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Greedy matches with both boxes' columns (c_ and t_)."""
    a = m.match_greedy(computed, truth, least)
    a = a.join(box.prefixed(computed, "c_", FRAME).withColumnRenamed("c_det_id", "c_id"), [*FRAME, "c_id"])
    return a.join(box.prefixed(truth, "t_", FRAME).withColumnRenamed("t_det_id", "t_id"), [*FRAME, "t_id"])


def matched_tracks(computed: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """The same matches with both boxes' tracks only, written once for those that use them several times."""
    return stored(m.match_greedy(computed, truth, least, extra=TRACKS), "matches")


def localization(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and true median overlap, mean centre distance, mean relative area error."""
    err = F.when(box.area("t_") > 0, F.abs(box.area("c_") - box.area("t_")) / box.area("t_"))
    return matches.groupBy(*keys).agg(F.avg("iou").alias("mean_iou"), F.median("iou").alias("median_iou"), F.avg(box.distance("c_", "t_")).alias("centre_distance"), F.avg(err).alias("area_error"))


def id_events(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """seq_id and per match or miss of a truth track: switch, ascend, transfer, fragmented.

    Order: frame, then overlap down, then ids; "previous" is the last match before in that order.
    """
    seen = truth.select("seq_id", "frame_id", F.col("track_id").alias("t_track_id"), F.col("det_id").alias("t_id")).join(matches.select("seq_id", "frame_id", "t_id", F.lit(1).alias("hit")), [*FRAME, "t_id"], "left")
    per = Window.partitionBy("seq_id", "t_track_id").orderBy("frame_id", "t_id")
    frag = seen.withColumn("before", F.lag(F.coalesce("hit", F.lit(0))).over(per)).withColumn("had", F.sum(F.coalesce("hit", F.lit(0))).over(per.rowsBetween(Window.unboundedPreceding, -1)))
    frag = frag.withColumn("frag", (F.coalesce("hit", F.lit(0)) == 1) & (F.col("before") == 0) & (F.col("had") > 0)).groupBy("seq_id").agg(F.count_if("frag").alias("fragmentations"))
    return frag.join(switches(matches), "seq_id", "left").fillna(0)


def switches(matches: DataFrame) -> DataFrame:
    """The part of id_events() that matches alone tell: id_switches, ascends and transfers of each seq_id."""
    order = ["frame_id", F.desc("iou"), "c_id", "t_id"]
    gt = Window.partitionBy("seq_id", "t_track_id").orderBy(*order)
    comp = Window.partitionBy("seq_id", "c_track_id").orderBy(*order)
    e = matches.select("seq_id", "frame_id", "iou", "c_id", "t_id", "c_track_id", "t_track_id")
    e = e.withColumn("last_c", F.lag("c_track_id").over(gt)).withColumn("last_t", F.lag("t_track_id").over(comp))
    e = e.withColumn("idsw", F.coalesce(F.col("last_c") != F.col("c_track_id"), F.lit(False))).withColumn("transfer", F.coalesce(F.col("last_t") != F.col("t_track_id"), F.lit(False)))
    e = e.withColumn("ascend", F.col("idsw") & F.col("last_t").isNotNull())
    return e.groupBy("seq_id").agg(F.count_if("idsw").alias("id_switches"), F.count_if("ascend").alias("ascends"), F.count_if("transfer").alias("transfers"))


def mot(computed: DataFrame, truth: DataFrame, least: float = 0.5, matches: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """MOTA, MOTP (mean overlap), switches and fragmentations per sequence; events: those of id_events() or switches() where they are known."""
    matches = matched_boxes(computed, truth, least) if matches is None else matches
    c = counts(computed, truth, matches, ["seq_id"]).join(id_events(matches, truth) if events is None else events, "seq_id", "left").fillna(0)
    p = matches.groupBy("seq_id").agg(F.avg("iou").alias("motp"))
    return c.join(p, "seq_id", "left").withColumn("mota", F.when(F.col("n_truth") > 0, 1 - (F.col("fn") + F.col("fp") + F.col("id_switches")) / F.col("n_truth")).otherwise(0.0))


def track_pairs(matches: DataFrame) -> DataFrame:
    return matches.groupBy("seq_id", "t_track_id", "c_track_id").agg(F.count("*").alias("n"))


def idf1(computed: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """ID precision, recall and F1 from a greedy assignment of tracks by common matches, per sequence."""
    pairs = track_pairs(matches).select("seq_id", F.col("c_track_id").alias("c_det_id"), F.col("t_track_id").alias("t_det_id"), F.col("n").cast("double").alias("iou"))
    idtp = m.one_to_one_by_rounds(pairs, ["seq_id"]).groupBy("seq_id").agg(F.sum("iou").alias("idtp"))
    c = counts(computed, truth, matches, ["seq_id"]).join(idtp, "seq_id", "left").fillna(0.0, ["idtp"])
    return c.select("seq_id", "idtp", ratio(F.col("idtp"), F.col("n_computed")).alias("idp"), ratio(F.col("idtp"), F.col("n_truth")).alias("idr"), ratio(2 * F.col("idtp"), F.col("n_computed") + F.col("n_truth")).alias("idf1"))


def track_coverage(truth: DataFrame, matches: DataFrame, computed: DataFrame) -> DataFrame:
    """Mostly tracked, partly tracked and mostly lost truth tracks, and false alarms per frame, per sequence."""
    n = truth.groupBy("seq_id", "track_id").agg(F.count("*").alias("n"))
    hit = matches.groupBy("seq_id", F.col("t_track_id").alias("track_id")).agg(F.count("*").alias("hit"))
    share = n.join(hit, ["seq_id", "track_id"], "left").withColumn("share", F.coalesce("hit", F.lit(0)) / F.col("n"))
    t = share.groupBy("seq_id").agg(F.count_if(F.col("share") >= 0.8).alias("mt"), F.count_if((F.col("share") >= 0.2) & (F.col("share") < 0.8)).alias("pt"), F.count_if(F.col("share") < 0.2).alias("ml"), F.count("*").alias("tracks"))
    frames = computed.select(*FRAME).unionByName(truth.select(*FRAME)).distinct().groupBy("seq_id").agg(F.count("*").alias("frames"))
    c = counts(computed, truth, matches, ["seq_id"]).select("seq_id", "fp")
    return t.join(frames, "seq_id").join(c, "seq_id").withColumn("mt_ratio", F.col("mt") / F.col("tracks")).withColumn("ml_ratio", F.col("ml") / F.col("tracks")).withColumn("faf", F.col("fp") / F.col("frames"))


def hota(computed: DataFrame, truth: DataFrame) -> DataFrame:
    """DetA, AssA, LocA and HOTA of a sequence, averaged over the 19 overlap thresholds 0.05, 0.10, ..., 0.95.

    Pairs are taken by falling overlap, so the matches of a threshold are those of the lowest one that reach it:
    one matching serves them all.
    """
    spark = computed.sparkSession
    alphas = F.broadcast(spark.range(19).selectExpr("id AS a", "0.05D + 0.05D * id AS alpha"))  # 19 rows
    # the overlaps of two tracks stay one row until their sizes are known; thresholds come last
    per = m.match_greedy(computed, truth, 0.05, extra=TRACKS).groupBy("seq_id", "c_track_id", "t_track_id").agg(F.collect_list("iou").alias("ious"))
    size = lambda df, p: df.groupBy("seq_id", F.col("track_id").alias(f"{p}_track_id")).agg(F.count("*").alias(f"{p}_n"))
    per = per.join(size(computed, "c"), ["seq_id", "c_track_id"]).join(size(truth, "t"), ["seq_id", "t_track_id"])
    per = per.join(alphas).withColumn("ious", F.filter("ious", lambda x: x >= F.col("alpha"))).withColumn("tpa", F.size("ious").cast("long")).where("tpa > 0").withColumn("iou", F.aggregate("ious", F.lit(0.0), lambda n, x: n + x))
    per = per.withColumn("ass", F.col("tpa") * F.col("tpa") / (F.col("c_n") + F.col("t_n") - F.col("tpa")))
    s = per.groupBy("a", "seq_id").agg(F.sum("tpa").alias("tp"), F.sum("ass").alias("ass"), F.sum("iou").alias("iou"))
    n = counts(computed, truth, truth.limit(0), ["seq_id"]).select("seq_id", "n_computed", "n_truth")
    full = n.crossJoin(alphas).join(s, ["a", "seq_id"], "left").fillna(0, ["tp", "ass", "iou"])  # 19 rows per sequence
    full = full.withColumn("det_a", ratio(F.col("tp"), F.col("n_computed") + F.col("n_truth") - F.col("tp"))).withColumn("ass_a", ratio(F.col("ass"), F.col("tp"))).withColumn("loc_a", ratio(F.col("iou"), F.col("tp")))
    return full.groupBy("seq_id").agg(F.avg("det_a").alias("det_a"), F.avg("ass_a").alias("ass_a"), F.avg("loc_a").alias("loc_a"), F.avg(F.sqrt(F.col("det_a") * F.col("ass_a"))).alias("hota"))


def runs(states: DataFrame, track: str) -> DataFrame:
    """Maximal runs of equal match status along each track: seq_id, track, matched, first and last frame, states."""
    w = Window.partitionBy("seq_id", track).orderBy("frame_id", "det_id")
    s = states.withColumn("new", F.coalesce((F.lag("matched").over(w) != F.col("matched")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    return s.groupBy("seq_id", track, "run", "matched").agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.count("*").alias("states"))


def status(boxes: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Boxes with matched (0 or 1) and the partner's track."""
    other = "t_track_id" if side == "c" else "c_track_id"
    mm = matches.select(*FRAME, F.col(f"{side}_id").alias("det_id"), F.col(other).alias("partner"))
    return boxes.select(*FRAME, "det_id", "track_id").join(mm, [*FRAME, "det_id"], "left").withColumn("matched", F.col("partner").isNotNull().cast("int"))


def kwant(boxes: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Continuity (1 / matched segments, at least one) of every track; purity (largest partner share) of matched ones."""
    s = status(boxes, matches, side)
    seg = runs(s, "track_id").groupBy("seq_id", "track_id").agg(F.sum("matched").alias("segments"), F.sum("states").alias("length"), F.sum(F.col("states") * F.col("matched")).alias("hits"))
    part = s.where("matched = 1").groupBy("seq_id", "track_id", "partner").agg(F.count("*").alias("n")).groupBy("seq_id", "track_id").agg((F.max("n") / F.sum("n")).alias("purity"))
    return seg.join(part, ["seq_id", "track_id"], "left").withColumn("continuity", 1 / F.greatest(F.lit(1), "segments"))


def track_quality(boxes: DataFrame, matches: DataFrame, side: str = "t") -> DataFrame:
    """Per sequence: mean track length, completeness, and mean length of gaps between matched parts."""
    r = runs(status(boxes, matches, side), "track_id")
    w = Window.partitionBy("seq_id", "track_id")
    inner = r.withColumn("lo", F.min(F.when(F.col("matched") == 1, F.col("run"))).over(w)).withColumn("hi", F.max(F.when(F.col("matched") == 1, F.col("run"))).over(w)).where("matched = 0 AND run > lo AND run < hi")
    gaps = inner.groupBy("seq_id").agg(F.avg("states").alias("gap_length"))
    per = r.groupBy("seq_id", "track_id").agg(F.sum("states").alias("n"), F.sum(F.col("states") * F.col("matched")).alias("hits"))
    q = per.groupBy("seq_id").agg(F.avg("n").alias("length"), F.avg(F.col("hits") / F.col("n")).alias("completeness"))
    return q.join(gaps, "seq_id", "left").fillna(0.0)


def running(df: DataFrame, keys: list[str]) -> DataFrame:
    """df (conf, det_id, tp) with its band and n and hits, the numbers of rows and of tp rows down to each row.

    Rows are summed within bands of confidence; the sums of the bands above come from a small table of bands, counted
    before rows are dealt out, so that the rows go through one exchange.
    """
    at = [*keys, "band"]
    df = df.withColumn("band", F.floor(F.col("conf") * BANDS).cast("int"))
    bands = df.groupBy(*at).agg(F.count("*").alias("bn"), F.sum("tp").alias("bt"))
    above = Window.partitionBy(*keys).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("n0", F.coalesce(F.sum("bn").over(above), F.lit(0))).withColumn("t0", F.coalesce(F.sum("bt").over(above), F.lit(0))).drop("bn", "bt")
    w = Window.partitionBy(*at).orderBy(F.desc("conf"), "det_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.repartition(*at).withColumn("n", F.count("*").over(w)).withColumn("hits", F.sum("tp").over(w)).join(F.broadcast(bands), at)
    return df.withColumn("n", F.col("n") + F.col("n0")).withColumn("hits", F.col("hits") + F.col("t0")).drop("n0", "t0")


def average_precision(computed: DataFrame, truth: DataFrame, least: float = 0.5, by_class: bool = False) -> DataFrame:
    """All-point average precision, with matches chosen in order of confidence (within classes if by_class)."""
    keys = ["cls"] if by_class else []
    match = m.match_by_confidence(computed, truth, least, [*FRAME, *keys])
    d = computed.select(*FRAME, "det_id", "conf", *keys).join(match.select(*FRAME, F.col("c_id").alias("det_id"), F.lit(1).alias("tp")), [*FRAME, "det_id"], "left").fillna(0, ["tp"])
    if not by_class:
        d, truth = d.withColumn("cls", F.lit("all")), truth.withColumn("cls", F.lit("all"))
    return area_under(d, truth.groupBy("cls").agg(F.count("*").alias("n_truth")), ["cls"])


def area_under(d: DataFrame, n: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_truth and ap of detections (keys, conf, det_id, tp) and numbers of truth boxes (keys, n_truth).

    Detections are dealt out once, by key and band; all steps below read that exchange, and nothing else that is as large is kept.
    """
    at = [*keys, "band"]
    r = running(d.select(*keys, "conf", "det_id", "tp"), keys).where("tp = 1").select(*at, "conf", "det_id", (F.col("hits") / F.col("n")).alias("_p"))
    # the best precision at or below each hit, which a hit has: within its band, and of the bands below
    peak = r.groupBy(*at).agg(F.max("_p").alias("peak"))
    below = Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    peak = F.broadcast(peak.withColumn("rest", F.coalesce(F.max("peak").over(below), F.lit(0.0))).drop("peak"))
    w = Window.partitionBy(*at).orderBy("conf", F.desc("det_id")).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("env", F.max("_p").over(w)).join(peak, at).withColumn("env", F.greatest("env", "rest"))
    # bands are summed in order, so a sum doesn't depend on what comes first
    s = r.groupBy(*at).agg(F.sum("env").alias("s")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("band", "s"))).alias("s"))
    s = s.withColumn("s", F.aggregate("s", F.lit(0.0), lambda total, x: total + x["s"]))
    return n.join(s, keys, "left").select(*keys, "n_truth", (F.coalesce("s", F.lit(0.0)) / F.col("n_truth")).alias("ap"))


def threshold_hits(computed: DataFrame, truth: DataFrame, least: list[float]) -> DataFrame:
    """conf, det_id and mask of every computed box: bit i says that it is matched at the i-th of rising thresholds.

    Boxes are joined once, those without a partner too, and the pairs of a frame are gathered once and chosen from for each threshold.
    """
    a = box.prefixed(computed.select(*FRAME, "det_id", *box.names(), "conf"), "c_", FRAME)
    b = box.prefixed(truth.select(*FRAME, "det_id", *box.names()), "t_", FRAME)
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in FRAME] + [box.iou("c_", "t_") >= least[0]]
    pair = F.struct((-F.col("c_conf")).alias("k"), F.col("c_det_id").alias("det_id"), (-box.iou("c_", "t_")).alias("niou"), F.col("t_det_id").alias("t_id"))
    keys = [F.col(f"a.{k}").alias(k) for k in FRAME]
    cand = a.alias("a").join(b.alias("b"), on, "left").groupBy(*keys).agg(F.sort_array(F.collect_list(pair)).alias("cand"))
    taken = "CAST(array() AS ARRAY<STRUCT<k: DOUBLE, det_id: BIGINT, niou: DOUBLE, t_id: BIGINT>>)"
    fold = f"aggregate(filter(cand, x -> -x.niou >= l), {taken}, (acc, x) -> IF(exists(acc, m -> m.det_id = x.det_id OR m.t_id = x.t_id), acc, concat(acc, array(x))))"
    hits = f"transform(array({', '.join(f'{x!r}D' for x in least)}), (l, i) -> transform({fold}, m -> struct(m.k AS k, m.det_id AS det_id, shiftleft(1, i) AS mask)))"
    every = "transform(cand, x -> struct(x.k AS k, x.det_id AS det_id, 0 AS mask))"
    rows = cand.selectExpr(*FRAME, f"inline(concat({every}, flatten({hits})))")
    return rows.groupBy(*FRAME, "det_id", "k").agg(F.bit_or("mask").alias("mask")).select((-F.col("k")).alias("conf"), "det_id", "mask")


def ap_over_thresholds(computed: DataFrame, truth: DataFrame) -> DataFrame:
    """ap50, ap75 and the mean over 0.50, 0.55, ..., 0.95; a detection is one row for all thresholds, so they share its place in the order."""
    ths = range(10)
    band = F.floor(F.col("conf") * BANDS).cast("int").alias("band")
    d = stored(threshold_hits(computed, truth, [0.5 + 0.05 * i for i in ths]).select(band, "conf", "det_id", "mask"), "hits")
    bit = [F.shiftright("mask", i).bitwiseAND(1) for i in ths]
    each = lambda f: F.array(*(f(i) for i in ths))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each band
    bands = d.groupBy("band").agg(F.count("*").alias("n"), *(F.sum(bit[i]).alias(f"h{i}") for i in ths))
    bands = F.broadcast(bands.select("band", *(F.coalesce(F.sum(k).over(above), F.lit(0)).alias(f"{k}_0") for k in bands.columns[1:])))
    w = Window.partitionBy("band").orderBy(F.desc("conf"), "det_id").rowsBetween(Window.unboundedPreceding, 0)
    r = d.withColumns({"n": F.count("*").over(w), **{f"h{i}": F.sum(bit[i]).over(w) for i in ths}}).where("mask <> 0").join(bands, "band")
    r = r.select("band", "conf", "det_id", *(F.when(bit[i] == 1, (F.col(f"h{i}") + F.col(f"h{i}_0")) / (F.col("n") + F.col("n_0"))).alias(f"p{i}") for i in ths))
    below = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    rest = r.groupBy("band").agg(*(F.max(f"p{i}").alias(f"p{i}") for i in ths))
    rest = F.broadcast(rest.select("band", *(F.max(f"p{i}").over(below).alias(f"r{i}") for i in ths)))
    up = Window.partitionBy("band").orderBy("conf", F.desc("det_id")).rowsBetween(Window.unboundedPreceding, 0)
    env = r.select("band", *(F.when(F.col(f"p{i}").isNotNull(), F.max(f"p{i}").over(up)).alias(f"e{i}") for i in ths)).join(rest, "band")
    sums = env.agg(*(F.sum(F.when(F.col(f"e{i}").isNotNull(), F.greatest(f"e{i}", f"r{i}"))).alias(f"s{i}") for i in ths))
    ap = sums.crossJoin(truth.agg(F.count("*").alias("n"))).select(each(lambda i: F.coalesce(f"s{i}", F.lit(0.0)) / F.col("n")).alias("ap"))
    mean = F.aggregate("ap", F.lit(0.0), lambda s, x: s + x) / len(ths)
    return ap.select(F.get("ap", F.lit(0)).alias("ap50"), F.get("ap", F.lit(5)).alias("ap75"), mean.alias("ap50_95"))


def per_class(computed: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Rates and average precision per class, matched within classes, and the mean AP of classes with truth."""
    d = detection(computed, truth, least, ["cls"])
    ap = average_precision(computed, truth, least, by_class=True).drop("n_truth")
    return d.join(ap, "cls", "left").withColumn("map", F.avg(F.when(F.col("n_truth") > 0, F.coalesce("ap", F.lit(0.0)))).over(Window.partitionBy()))


def pr_curve(computed: DataFrame, truth: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """One point per distinct confidence: rows of equal confidence are summed first."""
    d = computed.join(matches.select(*FRAME, F.col("c_id").alias("det_id"), F.lit(1).alias("tp")), [*FRAME, "det_id"], "left").fillna(0, ["tp"])
    g = d.groupBy(*keys, "conf").agg(F.sum("tp").alias("t"), F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("tp", F.sum("t").over(w)).withColumn("fp", F.sum("c").over(w) - F.col("tp")).drop("t", "c")
    n = truth.groupBy(*keys).agg(F.count("*").alias("n"))
    g = g.join(n, keys).withColumn("fn", F.col("n") - F.col("tp")).drop("n")
    return rates(g).select(*keys, "conf", "tp", "fp", "fn", "precision", "recall", "f1")


def ap_11pt(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over recalls 0, 0.1, ..., 1 of the best precision at that recall or more."""
    points = F.broadcast(curve.sparkSession.range(11).selectExpr("id / 10.0D AS r"))  # 11 rows
    best = curve.join(points, F.col("recall") >= F.col("r")).groupBy(*keys, "r").agg(F.max("precision").alias("p"))
    return best.groupBy(*keys).agg((F.sum("p") / 11).alias("ap11"))


def roc(curve: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Detection probability against false alarms per frame, from the origin, and the mean over the range covered."""
    n = frames.groupBy(*keys).agg(F.count("*").alias("frames"))
    c = curve.join(n, keys).select(*keys, "conf", F.col("recall").alias("pd"), (F.col("fp") / F.col("frames")).alias("fa"))
    w = Window.partitionBy(*keys).orderBy(F.desc("conf"))
    c = c.withColumn("area", (F.col("fa") - F.coalesce(F.lag("fa").over(w), F.lit(0.0))) * (F.col("pd") + F.coalesce(F.lag("pd").over(w), F.lit(0.0))) / 2)
    return c.groupBy(*keys).agg(F.count("*").alias("points"), F.max("fa").alias("max_fa"), ratio(F.sum("area"), F.max("fa")).alias("mean_pd"))


def confusion(computed: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts of true class x computed class, with background for what has no partner, and the share of its row."""
    c = computed.select(*FRAME, F.col("det_id").alias("c_id"), F.col("cls").alias("c_cls"))
    t = truth.select(*FRAME, F.col("det_id").alias("t_id"), F.col("cls").alias("t_cls"))
    j = matches.select(*FRAME, "c_id", "t_id").join(c, [*FRAME, "c_id"], "full").join(t, [*FRAME, "t_id"], "full")
    j = j.groupBy(F.coalesce("t_cls", F.lit("background")).alias("truth"), F.coalesce("c_cls", F.lit("background")).alias("computed")).agg(F.count("*").alias("n"))
    return j.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts of [0, 1] values in equal bins; 1 falls into the last."""
    b = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def sweep_matches(computed: DataFrame, truth: DataFrame, interval: int, least: float) -> DataFrame:
    """step, FRAME, c_id, t_id, iou, c_track_id and t_track_id: the greedy matches of boxes of conf >= step / interval, for each step.

    Boxes are joined once; the pairs of a frame are gathered once and chosen from for each step.
    """
    pair = F.struct((-F.col("iou")).alias("niou"), F.col("c_det_id").alias("c_id"), F.col("t_det_id").alias("t_id"), F.col("c_track_id"), F.col("t_track_id"), F.col("c_conf").alias("conf"))
    slim = lambda df, *more: df.select(*FRAME, "det_id", "track_id", *box.names(), *more)
    cand = m.iou_join(slim(computed, "conf"), slim(truth), least).groupBy(*FRAME).agg(F.sort_array(F.collect_list(pair)).alias("cand"))
    cand = cand.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(interval - 1))))
    taken = "CAST(array() AS ARRAY<STRUCT<c_id: BIGINT, t_id: BIGINT, iou: DOUBLE, c_track_id: BIGINT, t_track_id: BIGINT>>)"
    fold = f"""inline(aggregate(filter(cand, x -> x.conf >= step / {float(interval)}D), {taken}, (acc, x) -> CASE WHEN exists(acc, m -> m.c_id = x.c_id OR m.t_id = x.t_id)
             THEN acc ELSE concat(acc, array(struct(x.c_id AS c_id, x.t_id AS t_id, -x.niou AS iou, x.c_track_id AS c_track_id, x.t_track_id AS t_track_id))) END))"""
    return cand.selectExpr("step", *FRAME, fold)


def threshold_sweep(computed: DataFrame, truth: DataFrame, interval: int = 10, least: float = 0.5) -> DataFrame:
    """MOTA and IDF1 at confidence thresholds i / interval, per sequence; the thresholds are a key of one job."""
    ts = F.broadcast(computed.sparkSession.range(interval).selectExpr("id AS step", f"id / {float(interval)}D AS threshold"))
    # sequences of different thresholds are kept apart by a widened key
    wide = lambda df: df.withColumn("seq_id", F.col("seq_id") * interval + F.col("step"))
    matches = stored(sweep_matches(computed, truth, interval, least), "matches")
    # only counted, before any exchange
    c = wide(computed.select("seq_id", "conf").join(ts, F.col("conf") >= F.col("threshold"))).select("seq_id")
    t = wide(truth.select("seq_id").crossJoin(ts)).select("seq_id")
    mm = wide(matches).drop("step")
    out = mot(c, t, least, mm, switches(mm)).join(idf1(c, t, mm).select("seq_id", "idf1"), "seq_id")
    return out.select(F.expr(f"seq_id DIV {interval}").alias("seq_id"), ((F.col("seq_id") % interval) / interval).alias("threshold"), "mota", "idf1")


def best_of_sweep(sweep: DataFrame) -> DataFrame:
    """Best value and its threshold for both scores; of equal ones the lowest threshold."""
    low = lambda k: F.max_by("threshold", F.struct(k, -F.col("threshold")))
    return sweep.groupBy("seq_id").agg(F.max("mota").alias("mota"), low("mota").alias("mota_at"), F.max("idf1").alias("idf1"), low("idf1").alias("idf1_at"))


def filter_thresholds(sweep_best: DataFrame, key: str) -> DataFrame:
    """One threshold per key by each rule, and the default: the least of all."""
    r = sweep_best.select(key, F.least("mota_at", "idf1_at").alias("min"), ((F.col("mota_at") + F.col("idf1_at")) / 2).alias("mean"), F.col("idf1_at").alias("idf1"), F.col("mota_at").alias("mota"))
    d = r.agg(*(F.min(k).alias(k) for k in ("min", "mean", "idf1", "mota"))).select(F.lit("default").alias(key), "min", "mean", "idf1", "mota")
    return r.withColumn(key, F.col(key).cast("string")).unionByName(d)


def detector_quality(computed: DataFrame, truth: DataFrame) -> DataFrame:
    """Per sequence what tracker settings are fitted to: mean confidences of matched and unmatched boxes, errors of centre (over the
    true height) and of width, and the mean length of runs of frames in which a true track is missed."""
    mm = matched_boxes(computed, truth)
    centre = F.sqrt(F.pow(F.expr("(c_x1 + c_x2 - t_x1 - t_x2) / 2"), 2) + F.pow(F.expr("(c_y1 + c_y2 - t_y1 - t_y2) / 2"), 2)) / F.expr("t_y2 - t_y1")
    err = mm.groupBy("seq_id").agg(F.avg("c_conf").alias("matched_conf"), F.avg(centre).alias("centre_error"), F.avg(F.abs(F.expr("(c_x2 - c_x1) / (t_x2 - t_x1) - 1"))).alias("scale_error"))
    un = m.unmatched(computed, mm, "c_id").groupBy("seq_id").agg(F.avg("conf").alias("unmatched_conf"))
    miss = runs(status(truth, mm, "t"), "track_id").where("matched = 0").groupBy("seq_id").agg(F.avg("states").alias("miss_run"))
    return err.join(un, "seq_id", "left").join(miss, "seq_id", "left")
