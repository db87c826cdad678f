"""Operators along tracks and sequences, and linking of boxes to tracks.

Windows are partitioned by track or sequence, never global. Where the reference
semantics need state that depends on all rows before (segments with minimal
length, Kalman tracks) a sequence is one group, handled in order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import box
from ..shared import stored
from . import matching as m
from .components import components

TRACK = ["seq_id", "track_id"]
FRAME = ["seq_id", "frame_id"]
BOX = box.names()


def _along(*extra) -> Window:
    return Window.partitionBy(*TRACK).orderBy("frame_id", *extra)


def gaps(df: DataFrame) -> DataFrame:
    """Per track: states, gaps (missing frames between states), frames missing, share of gaps among steps."""
    d = df.withColumn("step", F.col("frame_id") - F.lag("frame_id").over(_along("det_id")))
    return d.groupBy(*TRACK).agg(F.count("*").alias("states"), F.count_if(F.col("step") > 1).alias("gaps"), F.coalesce(F.sum(F.when(F.col("step") > 1, F.col("step") - 1)), F.lit(0)).alias("missing"))


def velocity(df: DataFrame, slow: float, fast: float) -> DataFrame:
    """Per track mean, max and deviation of centre speed in pixels per frame, and its class by mean."""
    cx, cy = box.centre()
    w = _along("det_id")
    d = df.withColumn("cx", cx).withColumn("cy", cy)
    dt = F.col("frame_id") - F.lag("frame_id").over(w)
    v = F.sqrt(F.pow(F.col("cx") - F.lag("cx").over(w), 2) + F.pow(F.col("cy") - F.lag("cy").over(w), 2)) / F.when(dt > 0, dt)
    g = d.withColumn("v", v).groupBy(*TRACK).agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.stddev_pop("v").alias("std")).where("mean IS NOT NULL")
    return g.withColumn("kind", F.when(F.col("mean") < slow, "stationary").when(F.col("mean") < fast, "slow").otherwise("fast"))


def direction_change(df: DataFrame) -> DataFrame:
    """Per track the mean angle between successive centre displacements; standing still is left out."""
    cx, cy = box.centre()
    w = _along("det_id")
    d = df.withColumn("cx", cx).withColumn("cy", cy)
    d = d.withColumn("dx", F.col("cx") - F.lag("cx").over(w)).withColumn("dy", F.col("cy") - F.lag("cy").over(w))
    d = d.withColumn("px", F.lag("dx").over(w)).withColumn("py", F.lag("dy").over(w))
    n = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) * F.sqrt(F.col("px") ** 2 + F.col("py") ** 2)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("dx") * F.col("px") + F.col("dy") * F.col("py")) / n))
    return d.withColumn("n", n).where("n > 0").groupBy(*TRACK).agg(F.avg(F.acos(cos)).alias("angle"))


def interpolate(df: DataFrame) -> DataFrame:
    """A state for every frame between states: boxes linear, confidence and class of the earlier one."""
    w = _along("det_id")
    d = df.withColumns({f"n_{k}": F.lead(k).over(w) for k in (*BOX, "frame_id")})
    d = d.withColumn("at", F.explode(F.sequence(F.col("frame_id"), F.greatest(F.col("frame_id"), F.coalesce(F.col("n_frame_id") - 1, F.col("frame_id"))))))
    t = (F.col("at") - F.col("frame_id")) / (F.col("n_frame_id") - F.col("frame_id"))
    mixed = {k: F.when(F.col("at") == F.col("frame_id"), F.col(k)).otherwise(F.col(k) + t * (F.col(f"n_{k}") - F.col(k))) for k in BOX}
    return d.select(*TRACK, F.col("at").alias("frame_id"), *(mixed[k].alias(k) for k in BOX), "conf", "cls", (F.col("at") != F.col("frame_id")).alias("added"))


def resample(df: DataFrame, rate_in: float, rate_out: float, max_gap: int, linear: bool = True) -> DataFrame:
    """Tracks at another frame rate: frame f of the output lies at f * in / out of the input.

    Boxes and confidence are linear between states at most max_gap apart (or those of the nearer state);
    the class is the nearer state's. Tracks that no output frame hits keep their first state at the nearest frame.
    """
    r, eps = rate_in / rate_out, 1e-3
    w = _along("det_id")
    d = df.withColumns({f"n_{k}": F.lead(k).over(w) for k in (*BOX, "frame_id", "conf", "cls")})
    last = F.col("n_frame_id").isNull()
    open_ = ~last & (F.col("n_frame_id") - F.col("frame_id") <= max_gap)
    lo = F.ceil(F.col("frame_id") / r - eps)
    hi = F.when(open_, F.ceil(F.col("n_frame_id") / r - eps) - 1).otherwise(F.floor(F.col("frame_id") / r + eps))
    d = d.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("at", F.explode(F.sequence("lo", "hi")))
    t = F.when(open_, F.greatest(F.lit(0.0), (F.col("at") * r - F.col("frame_id")) / (F.col("n_frame_id") - F.col("frame_id")))).otherwise(0.0)
    t = F.when(F.abs(t) < eps, 0.0).otherwise(t)
    near = t > 0.5
    share = t if linear else F.when(near, 1.0).otherwise(0.0)
    mix = lambda k: F.when(share == 0, F.col(k)).otherwise(F.col(k) + share * (F.col(f"n_{k}") - F.col(k))).alias(k)
    out = d.select(*TRACK, F.col("at").cast("long").alias("frame_id"), *(mix(k) for k in (*BOX, "conf")), F.when(near, F.col("n_cls")).otherwise(F.col("cls")).alias("cls"))
    short = df.join(out.select(*TRACK).distinct(), TRACK, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return out.unionByName(short.select(*TRACK, F.round(F.col("frame_id") / r).cast("long").alias("frame_id"), *BOX, "conf", "cls"))


def rolling_mean(df: DataFrame, n: int, vec: str = "vec") -> DataFrame:
    """The mean of the last n vectors of each track, per element."""
    w = _along("det_id").rowsBetween(-(n - 1), 0)
    return df.select(*TRACK, "frame_id", "det_id", _mean_vector(F.collect_list(vec).over(w)).alias("vec"))


def _mean_vector(vectors: Column) -> Column:
    """The mean of a few vectors, per element."""
    return F.transform(F.sequence(F.lit(0), F.size(vectors[0]) - 1), lambda i: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.size(vectors))


def block_mean(df: DataFrame, n: int, vec: str = "vec") -> DataFrame:
    """The first vector of each track, then the mean of every n after it (the first belongs to no block)."""
    d = df.withColumn("rn", F.row_number().over(_along("det_id")))
    d = d.withColumn("block", F.when(F.col("rn") == 1, -1).otherwise(F.floor((F.col("rn") - 2) / n)))
    full = d.groupBy(*TRACK, "block").agg(F.count("*").alias("c"), F.max("frame_id").alias("frame_id"), F.collect_list(F.struct("rn", vec)).alias("v")).where((F.col("block") == -1) | (F.col("c") == n))
    return full.select(*TRACK, "frame_id", _mean_vector(F.transform(F.array_sort("v"), lambda x: x[vec])).alias("vec"))


def segments(df: DataFrame, key: str, order: str, score: str, above: float, least: int, most: int) -> DataFrame:
    """Shot numbers: a new one where the score passes the threshold after at least ``least`` frames, or after ``most``.

    Where a shot begins rests on where the one before did, so the scores of one key are a group; a step goes from
    one beginning to the next.
    """

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        hits, n, at = np.flatnonzero(pdf[score].to_numpy(float) > above), len(pdf), 0
        begins = np.zeros(n, np.int32)
        while True:
            k = np.searchsorted(hits, at + least)
            at = min(int(hits[k]) if k < len(hits) else n, at + most)
            if at >= n:
                break
            begins[at] = 1
        return pd.DataFrame({key: pdf[key].to_numpy(), order: pdf[order].to_numpy(), "segment": np.cumsum(begins).astype(np.int32)})

    kinds = {k: df.schema[k].dataType.simpleString() for k in (key, order)}
    return df.select(key, order, score).groupBy(key).applyInPandas(number, f"{key} {kinds[key]}, {order} {kinds[order]}, segment int")


def change(df: DataFrame, key: str, order: str, distance, vec: str = "vec") -> DataFrame:
    """The distance of each row's vector to the one before it in its sequence."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("before", F.lag(vec).over(w)).where("before IS NOT NULL").select(key, order, distance(F.col("before"), F.col(vec)).alias("change"))


def headings(df: DataFrame, keys: list[str], order: str, e: str = "e", n: str = "n") -> DataFrame:
    """Direction of travel in degrees from north, from the positions before and after."""
    w = Window.partitionBy(*keys).orderBy(order)
    de = F.coalesce(F.lead(e).over(w), F.col(e)) - F.coalesce(F.lag(e).over(w), F.col(e))
    dn = F.coalesce(F.lead(n).over(w), F.col(n)) - F.coalesce(F.lag(n).over(w), F.col(n))
    return df.withColumn("heading", F.pmod(F.degrees(F.atan2(de, dn)), F.lit(360.0)))


def assign_uids(df: DataFrame) -> DataFrame:
    """Dense track ids across files: by file, then first appearance. One row per track decides, and the files' numbers add up."""
    t = df.groupBy(*TRACK).agg(F.min(F.struct("frame_id", "det_id")).alias("first"))
    t = t.withColumn("nth", F.row_number().over(Window.partitionBy("seq_id").orderBy("first")))
    files = t.groupBy("seq_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per file
    return t.join(files.select("seq_id", before.alias("before")), "seq_id").select(*TRACK, (F.col("before") + F.col("nth") - 1).alias("uid"))


def concat_parts(df: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts (part, frames) of one recording in a row: frames shifted by the parts before, track ids made distinct per part."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    ids = df.groupBy("part").agg(F.max("track_id").alias("top"))
    off = parts.join(ids, "part", "left").select("part", F.coalesce(F.sum("frames").over(w), F.lit(0)).alias("shift"), F.coalesce(F.sum(F.coalesce("top", F.lit(0)) + 1).over(w), F.lit(0)).alias("base"))
    return df.join(F.broadcast(off), "part").withColumn("frame_id", F.col("frame_id") + F.col("shift")).withColumn("track_id", F.col("track_id") + F.col("base")).drop("shift", "base")


def mosaic_ranges(df: DataFrame, key: str, order: str, ref: str) -> DataFrame:
    """Ranges of frames between changes of the reference frame."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("new", F.coalesce((F.lag(ref).over(w) != F.col(ref)).cast("int"), F.lit(1))).withColumn("range", F.sum("new").over(w))
    return d.groupBy(key, "range", ref).agg(F.min(order).alias("first"), F.max(order).alias("last"))


def burst_split(frames: DataFrame, burst: int, percent: float) -> DataFrame:
    """Adds validation: the first ``burst`` frames of every burst / percent go there; each side has at least one truth frame of a sequence."""
    w = Window.partitionBy("seq_id").orderBy("frame_id")
    segment = max(1, round(burst / percent))
    d = frames.withColumn("i", F.row_number().over(w) - 1).withColumn("validation", F.col("i") % segment < burst)
    t = d.where("has_truth").groupBy("seq_id").agg(F.count_if("validation").alias("v"), F.count_if(~F.col("validation")).alias("t"), F.min("frame_id").alias("first"), F.max("frame_id").alias("last"))
    d = d.join(t, "seq_id", "left")
    return d.withColumn("validation", F.when((F.col("v") == 0) & (F.col("frame_id") == F.col("first")), True).when((F.col("t") == 0) & (F.col("frame_id") == F.col("last")), False).otherwise(F.col("validation"))).select("seq_id", "frame_id", "has_truth", "validation")


def clip_split(clips: DataFrame, share: float) -> DataFrame:
    """The last share of usable clips (rounded down, at least one, at most half) goes to validation; of a single clip nothing. One row per clip."""
    w = Window.orderBy(F.desc("seq_id"))
    u = clips.where("usable").withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    return u.withColumn("validation", F.col("rn") <= F.least(F.floor(F.col("n") / 2), F.greatest(F.lit(1), F.floor(F.col("n") * share)))).select("seq_id", "validation")


def negative_ratio(frames: DataFrame, most: float, seed: str = "0") -> DataFrame:
    """Frames without truth thinned to ``most`` times those with truth, by a seeded hash, if there are more and over ten."""
    n = frames.agg(F.count_if("has_truth").alias("pos"), F.count_if(~F.col("has_truth")).alias("neg"))
    keep = F.col("pos") * most / F.col("neg")
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "seq_id", "frame_id").cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    over = (F.col("neg") > F.col("pos") * most) & (F.col("neg") > 10)
    return frames.crossJoin(F.broadcast(n)).where(F.col("has_truth") | ~over | (h < keep)).select(*frames.columns)  # one row


def compose_homographies(df: DataFrame, block: int = 256) -> DataFrame:
    """Frame-to-frame homographies h (nine values) composed into the first frame of each sequence.

    Products run within blocks of frames first; the blocks' products, a table with one row for each, are composed
    next, and each frame's product is that of the blocks before it times its own.
    """
    w = Window.partitionBy("seq_id").orderBy("frame_id")
    rows = df.select("seq_id", "frame_id", "h").withColumn("block", F.floor((F.row_number().over(w) - 1) / block))

    def running(pdf: pd.DataFrame, order: str) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        now, out = np.eye(3), []
        for h in pdf.h:
            now = now @ np.asarray(h, float).reshape(3, 3)
            out.append(now.ravel().tolist())
        return pdf.assign(h=out)

    inner = stored(rows.groupBy("seq_id", "block").applyInPandas(lambda g: running(g, "frame_id"), "seq_id long, frame_id long, h array<double>, block long"))
    last = inner.groupBy("seq_id", "block").agg(F.max_by("h", "frame_id").alias("h")).withColumn("block", F.col("block") + 1)
    before = last.groupBy("seq_id").applyInPandas(lambda g: running(g, "block"), "seq_id long, block long, h array<double>").withColumnRenamed("h", "b")
    b = F.coalesce("b", F.array(*(F.lit(float(i % 4 == 0)) for i in range(9))))
    product = [sum((b[r * 3 + k] * F.col("h")[k * 3 + c] for k in range(3)), F.lit(0.0)) for r in range(3) for c in range(3)]
    return inner.join(before, ["seq_id", "block"], "left").select("seq_id", "frame_id", F.array(*product).alias("h"))


def landmarks(df: DataFrame, note: Column) -> DataFrame:
    """Per track its image points in order and the last (x, y, z) of its notes."""
    p = r"\(?(-?[\d.]+),\s*(-?[\d.]+),\s*(-?[\d.]+)\)?"
    d = df.withColumn("note", note).withColumn("has", F.col("note").rlike(p))
    g = d.groupBy(*TRACK).agg(F.count("*").alias("points"), F.max_by("note", F.when(F.col("has"), F.struct("frame_id", "det_id"))).alias("last"))
    return g.where("last IS NOT NULL").select(*TRACK, "points", *(F.regexp_extract("last", p, i).cast("double").alias(k) for i, k in ((1, "x"), (2, "y"), (3, "z"))))


def thin_background(frames: DataFrame, n: int, skip: int) -> DataFrame:
    """Keeps frames with truth, and every n-th background frame of a run after ``skip`` ones."""
    w = Window.partitionBy("seq_id").orderBy("frame_id")
    d = frames.withColumn("run", F.sum(F.col("has_truth").cast("int")).over(w))
    d = d.withColumn("i", F.sum((~F.col("has_truth")).cast("int")).over(Window.partitionBy("seq_id", "run").orderBy("frame_id")) - 1)
    return d.where(F.col("has_truth") | ((F.col("i") >= skip) & ((F.col("i") - skip) % n == 0))).select(*frames.columns)


def thin_frames(frames: DataFrame, factor: float) -> DataFrame:
    """Keeps a frame where floor(i / factor) changes."""
    w = Window.partitionBy("seq_id").orderBy("frame_id")
    d = frames.withColumn("i", F.row_number().over(w) - 1)
    return d.where((F.col("i") == 0) | (F.floor(F.col("i") / factor) != F.floor((F.col("i") - 1) / factor))).select(*frames.columns)


def link_greedy(df: DataFrame, least: float = 0.2, homographies: DataFrame | None = None, reference: str | None = None, block: int = 1024) -> DataFrame:
    """Track ids from overlaps with the frame before only: frame pairs match in parallel, links become chains.

    homographies: seq_id, frame_id and h, nine values that take the frame before into this one; its boxes are moved by
    them (frames without one keep theirs). reference: a column; where it changes between two frames tracks end. block:
    frames of a sequence whose links are followed together.
    """
    prev = df.withColumn("frame_id", F.col("frame_id") + 1)
    if homographies is not None:
        h = homographies.select(*FRAME, "h")
        prev = prev.join(h, FRAME, "left")
        at = lambda x, y, r: F.col("h")[3 * r] * F.col(x) + F.col("h")[3 * r + 1] * F.col(y) + F.col("h")[3 * r + 2]
        corners = [(x, y) for x in ("x1", "x2") for y in ("y1", "y2")]
        xs, ys = ([at(x, y, r) / at(x, y, 2) for x, y in corners] for r in (0, 1))
        moved = {"x1": F.least(*xs), "y1": F.least(*ys), "x2": F.greatest(*xs), "y2": F.greatest(*ys)}
        prev = prev.withColumns({k: F.when(F.col("h").isNull(), F.col(k)).otherwise(v) for k, v in moved.items()}).drop("h")
    pairs = m.iou_join(df, prev, least)
    if reference is not None:
        # boxes of two references have no pair, so they don't compete; an equality would become a key of the join, and all would be dealt out anew
        pairs = pairs.where((F.col(f"c_{reference}") <= F.col(f"t_{reference}")) & (F.col(f"c_{reference}") >= F.col(f"t_{reference}")))
    roots = _chains(m.one_to_one(pairs, -F.col("iou"), FRAME), block)
    return df.join(roots, df["det_id"] == roots["node"], "left").withColumn("linked_track", F.coalesce("root", "det_id")).drop("node", "root")


def _chains(links: DataFrame, block: int) -> DataFrame:
    """node and root, the smallest id of its chain, of links (seq_id, frame_id, c_id, t_id) of boxes to boxes of the frame before.

    Chains are followed within blocks of frames. A box of the last frame of a block that has a link to the next block is told
    by both; of chains with such boxes only one link for each of them goes into the search for components.
    """

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_id")
        place = pdf.frame_id.to_numpy() % block
        head, low, open_ = {}, {}, {}
        for c, t, p in zip(pdf.c_id.tolist(), pdf.t_id.tolist(), place.tolist(), strict=True):
            h = head.setdefault(t, t)
            head[c] = h
            low[h] = min(low.get(h, t), c)
            if p == 0:
                open_[t] = open_.get(t, 0) | 1
            if p == block - 1:
                open_[c] = open_.get(c, 0) | 2
        ends = {head[x] for x in open_}
        rows = [(x, low[h], open_.get(x, 0), h in ends) for x, h in head.items()]
        return pd.DataFrame(rows, columns=["node", "root", "side", "open"])

    of = F.expr(f"frame_id - pmod(frame_id, {block})")
    d = links.select("seq_id", of.alias("block"), "frame_id", F.col("c_id").cast("long"), F.col("t_id").cast("long"))
    d = stored(d.groupBy("seq_id", "block").applyInPandas(follow, "node long, root long, side int, open boolean"), "chains")
    before, after = d.where("side >= 2").selectExpr("node", "root AS a"), d.where("side % 2 = 1").selectExpr("node", "root AS b")
    met = components(before.join(after, "node").select("a", "b")).selectExpr("node AS root", "root AS smallest")
    known = d.where("open AND side % 2 = 0").unionByName(d.where("side % 2 = 1").join(before.select("node"), "node", "left_anti"))
    known = known.join(met, "root", "left").select("node", F.coalesce("smallest", "root").alias("root"))
    return d.where("NOT open").select("node", "root").unionByName(known)


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.prod(np.clip(hi - lo, 0, None), axis=2)
    area = lambda x: np.prod(x[:, 2:] - x[:, :2], axis=1)
    union = area(a)[:, None] + area(b)[None] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0)


def _blocks(ok: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of the connected blocks of a matrix of allowed pairs."""
    out, free = [], ok.any(1)
    while free.any():
        rows = np.zeros(len(ok), bool)
        rows[np.argmax(free)] = True
        while True:
            cols = ok[rows].any(0)
            more = ok[:, cols].any(1)
            if (more == rows).all():
                break
            rows = more
        free &= ~rows
        out.append((np.flatnonzero(rows), np.flatnonzero(cols)))
    return out


class Tracker:
    """Two-stage association of boxes to tracks, one frame at a time; the state of one sequence.

    Strong boxes match predicted tracks first, weak ones the tracks left over. A track that has been seen in one frame
    only is not confirmed (but for those that begin where no track was left): it takes part after the others, and ends if nothing
    matches it. With ``direction`` the cost also counts how far a box lies off the way between a track's observed
    boxes, and lost tracks are tried again by their last observed box; with ``appearance`` how far its vector is from
    the track's mean.

    The tracks of a sequence are rows of arrays, predicted and updated all at once. The filter has constant velocities of
    centre, aspect and height; as its noise couples none of the four with another, each is a filter of a value and its
    velocity, with two variances and a covariance.
    """

    def __init__(self, high=0.6, low=0.1, new=0.7, gate=0.2, buffer=30, direction=0.0, appearance=0.0, steps=3):
        self.high, self.low, self.new, self.gate, self.buffer, self.direction, self.appearance, self.steps = high, low, new, gate, buffer, direction, appearance, steps
        self.next, self.frame, self.vec = 1, None, None
        self.ids, self.seen, self.sure = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.mean, self.variance, self.boxes = np.empty((0, 2, 4)), np.empty((0, 3, 4)), np.empty((0, steps + 1, 4))

    def copy(self) -> Tracker:
        """A tracker of the same settings without tracks."""
        return Tracker(self.high, self.low, self.new, self.gate, self.buffer, self.direction, self.appearance, self.steps)

    def rows(self) -> tuple[tuple, list[tuple]]:
        """The counters, and each track as plain values: id, mean, variance, seen, sure, boxes."""
        flat = (x.reshape(len(self.ids), -1).tolist() for x in (self.mean, self.variance, self.boxes))
        mean, variance, boxes = flat
        return (self.next, self.frame), list(zip(self.ids.tolist(), mean, variance, self.seen.tolist(), self.sure.tolist(), boxes, strict=True))

    def restore(self, counters: tuple, rows: list[tuple]) -> None:
        self.next, self.frame = counters
        ids, mean, variance, seen, sure, boxes = zip(*sorted(rows), strict=True) if rows else [[]] * 6
        self.ids, self.seen, self.sure = np.array(ids, np.int64), np.array(seen, np.int64), np.array(sure, bool)
        self.mean, self.variance = np.array(mean, float).reshape(-1, 2, 4), np.array(variance, float).reshape(-1, 3, 4)
        self.boxes = np.array(boxes, float).reshape(-1, self.steps + 1, 4)

    def _predict(self) -> None:
        s = np.maximum(self.mean[:, 0, 3], 1e-6)[:, None]
        value, speed = s / 20 * np.array([1, 1, 0, 1]) + np.array([0, 0, 1e-2, 0]), s / 160 * np.array([1, 1, 0, 1]) + np.array([0, 0, 1e-5, 0])
        v = self.variance
        self.mean[:, 0] += self.mean[:, 1]
        self.variance = np.stack([v[:, 0] + 2 * v[:, 1] + v[:, 2] + value**2, v[:, 1] + v[:, 2], v[:, 2] + speed**2], axis=1)

    def _update(self, at: np.ndarray, z: np.ndarray) -> None:
        s = np.maximum(self.mean[at, 0, 3], 1e-6)[:, None]
        noise = (s / 20 * np.array([1, 1, 0, 1]) + np.array([0, 0, 1e-1, 0])) ** 2
        v = self.variance[at]
        gain, gain_speed = v[:, 0] / (v[:, 0] + noise), v[:, 1] / (v[:, 0] + noise)
        off = z - self.mean[at, 0]
        self.mean[at] += np.stack([gain * off, gain_speed * off], axis=1)
        self.variance[at] = np.stack([v[:, 0] - gain * v[:, 0], v[:, 1] - gain * v[:, 1], v[:, 2] - gain_speed * v[:, 1]], axis=1)

    def _where(self, at: np.ndarray) -> np.ndarray:
        cx, cy, a, h = self.mean[at, 0].T
        return np.stack([cx - a * h / 2, cy - h / 2, cx + a * h / 2, cy + h / 2], axis=1)

    def _match(self, at: np.ndarray, boxes: np.ndarray, vecs=None, use_last=False):
        """Pairs (track, box) of the least cost among those that overlap enough, solved block by block; the tracks and boxes left."""
        none = np.empty(0, np.int64)
        if not len(at) or not len(boxes):
            return none, none, at, np.arange(len(boxes))
        over = _iou(self.boxes[at, -1] if use_last else self._where(at), boxes)
        cost, ok = 1 - over, over >= self.gate
        if self.direction:
            c = (boxes[:, :2] + boxes[:, 2:]) / 2
            first, last = ((b[:, :2] + b[:, 2:]) / 2 for b in (self.boxes[at, 0], self.boxes[at, -1]))
            v, d = last - first, c[None] - last[:, None]
            length = np.hypot(*v.T)
            cos = np.einsum("ijk,ik->ij", d, v) / (np.hypot(d[..., 0], d[..., 1]) * length[:, None] + 1e-9)
            cost += np.where((length > 1e-6)[:, None], self.direction * (np.arccos(np.clip(cos, -1, 1)) / np.pi - 0.5), 0)
        if self.appearance and vecs is not None:
            cost += self.appearance * (1 - self.vec[at] @ vecs.T)
        alone = ok & (ok.sum(1, keepdims=True) == 1) & (ok.sum(0, keepdims=True) == 1)
        i, j = np.nonzero(alone)
        pairs = list(zip(i.tolist(), j.tolist(), strict=True))
        ok[i] = False
        for rows, cols in _blocks(ok):
            if len(rows) == 1 or len(cols) == 1:
                i, j = np.unravel_index(np.where(ok[np.ix_(rows, cols)], cost[np.ix_(rows, cols)], np.inf).argmin(), (len(rows), len(cols)))
                pairs.append((int(rows[i]), int(cols[j])))
            else:
                block = np.where(ok, cost, 1e3)[np.ix_(rows, cols)]
                pairs += [(int(rows[i]), int(cols[j])) for i, j in m.assignment(block) if ok[rows[i], cols[j]]]
        i, j = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (none, none)
        return at[i], j, np.delete(at, i), np.delete(np.arange(len(boxes)), j)

    def _keep(self, which: np.ndarray) -> None:
        for k in ("ids", "seen", "sure", "mean", "variance", "boxes", *([] if self.vec is None else ["vec"])):
            setattr(self, k, getattr(self, k)[which])

    def step(self, frame: int, boxes: np.ndarray, conf: np.ndarray, vecs: np.ndarray | None = None) -> np.ndarray:
        """The track of each box, 0 for none; vecs: unit vectors of the boxes."""
        out = np.zeros(len(boxes), np.int64)
        gap = frame - (frame - 1 if self.frame is None else self.frame)
        self.frame = frame
        if (frame - self.seen > self.buffer).any():
            self._keep(frame - self.seen <= self.buffer)
        fresh = not len(self.ids)
        for _ in range(min(gap, self.buffer) if len(self.ids) else 0):
            self._predict()
        size = boxes[:, 2:] - boxes[:, :2]
        z = np.c_[(boxes[:, :2] + boxes[:, 2:]) / 2, size[:, 0] / np.maximum(size[:, 1], 1e-6), size[:, 1]]
        pick = lambda at: None if vecs is None else vecs[at]

        def take(tracks, at):
            if not len(at):
                return
            self._update(tracks, z[at])
            self.seen[tracks], self.sure[tracks] = frame, True
            self.boxes[tracks] = np.concatenate([self.boxes[tracks, 1:], boxes[at][:, None]], axis=1)
            if vecs is not None:
                v = 0.9 * self.vec[tracks] + 0.1 * vecs[at]
                self.vec[tracks] = v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
            out[at] = self.ids[tracks]

        sure, unsure = np.flatnonzero(self.sure), np.flatnonzero(~self.sure)
        strong, weak = np.flatnonzero(conf >= self.high), np.flatnonzero((conf >= self.low) & (conf < self.high))
        tracks, at, left, free = self._match(sure, boxes[strong], pick(strong))
        take(tracks, strong[at])
        strong = strong[free]
        tracks, at, _, _ = self._match(left[frame - self.seen[left] <= max(1, gap)], boxes[weak])
        take(tracks, weak[at])
        if self.direction:
            tracks, at, _, free = self._match(sure[self.seen[sure] != frame], boxes[strong], pick(strong), use_last=True)
            take(tracks, strong[at])
            strong = strong[free]
        tracks, at, gone, free = self._match(unsure, boxes[strong], pick(strong))
        take(tracks, strong[at])
        strong = strong[free]
        if len(gone):
            self._keep(~np.isin(np.arange(len(self.ids)), gone))
        born = strong[conf[strong] >= self.new]
        if len(born):
            n, s = len(born), z[born, 3][:, None]
            flat = np.array([1, 1, 0, 1])
            value, speed = (2 * s / 20 * flat + np.array([0, 0, 1e-2, 0])) ** 2, (10 * s / 160 * flat + np.array([0, 0, 1e-5, 0])) ** 2
            add = lambda a, b: np.concatenate([a, b])
            out[born] = new = np.arange(self.next, self.next + n)
            self.ids, self.seen, self.sure = add(self.ids, new), add(self.seen, np.full(n, frame)), add(self.sure, np.full(n, fresh))
            self.mean, self.variance = add(self.mean, np.stack([z[born], np.zeros((n, 4))], axis=1)), add(self.variance, np.stack([value, np.zeros((n, 4)), speed], axis=1))
            self.boxes = add(self.boxes, np.repeat(boxes[born][:, None], self.steps + 1, axis=1))
            if vecs is not None:
                self.vec = vecs[born] if self.vec is None else add(self.vec, vecs[born])
            self.next += n
        return out

    def run(self, frames: np.ndarray, boxes: np.ndarray, conf: np.ndarray, vecs: np.ndarray | None = None) -> np.ndarray:
        """The track of each box, as step() gives it, for the rows of any number of frames in order.

        Frames hold few boxes, where a call of an array costs more than its numbers; so tracks are plain numbers here.
        """
        ends = np.append(np.flatnonzero(np.diff(frames)) + 1, len(frames)).tolist() if len(frames) else []
        starts = [0, *ends[:-1]]
        if not np.isfinite(boxes).all():
            return np.concatenate([self.step(int(frames[lo]), boxes[lo:hi], conf[lo:hi], None if vecs is None else vecs[lo:hi]) for lo, hi in zip(starts, ends, strict=True)])
        tracks = self._plain()
        out: list[int] = []
        at, conf = boxes.tolist(), conf.tolist()
        for lo, hi in zip(starts, ends, strict=True):
            if hi - lo > 64 or len(tracks) > 256:  # arrays pay
                self._hold(tracks, vecs is not None)
                out += self.step(int(frames[lo]), boxes[lo:hi], np.array(conf[lo:hi]), None if vecs is None else vecs[lo:hi]).tolist()
                tracks = self._plain()
            else:
                tracks = self._few(tracks, int(frames[lo]), at[lo:hi], conf[lo:hi], None if vecs is None else vecs[lo:hi], out)
        self._hold(tracks, vecs is not None)
        return np.array(out, np.int64)

    def _plain(self) -> list:
        """The tracks as plain numbers."""
        vec = [None] * len(self.ids) if self.vec is None else list(self.vec)
        return [_Track(*row) for row in zip(self.ids.tolist(), self.seen.tolist(), self.sure.tolist(), self.mean[:, 0].tolist(), self.mean[:, 1].tolist(), self.variance[:, :, 0].tolist(), self.variance[:, :, 2].tolist(), self.boxes.tolist(), vec, strict=True)]

    def _hold(self, tracks: list, with_vec: bool) -> None:
        """Tracks of plain numbers as arrays."""
        n = len(tracks)
        self.ids, self.seen, self.sure = np.array([t.id for t in tracks], np.int64), np.array([t.seen for t in tracks], np.int64), np.array([t.sure for t in tracks], bool)
        self.mean = np.array([[t.value, t.speed] for t in tracks], float).reshape(n, 2, 4)
        own, aspect = np.array([t.var for t in tracks], float).reshape(n, 3), np.array([t.aspect_var for t in tracks], float).reshape(n, 3)
        self.variance = np.stack([own, own, aspect, own], axis=2)
        self.boxes = np.array([t.boxes for t in tracks], float).reshape(n, self.steps + 1, 4)
        if with_vec:
            self.vec = np.array([t.vec for t in tracks]) if n else None

    def _pairs(self, tracks: list, boxes: list, which: list[int], vecs=None, use_last=False) -> list[tuple[int, int]]:
        """What _match() finds, as (place of a track, place in which)."""
        if not tracks or not which:
            return []
        ok, cost, turn = [], [], self.direction
        for t in tracks:
            if use_last:
                x1, y1, x2, y2 = t.boxes[-1]
            else:
                cx, cy, a, h = t.value
                x1, y1, x2, y2 = cx - a * h / 2, cy - h / 2, cx + a * h / 2, cy + h / 2
            area = (x2 - x1) * (y2 - y1)
            hits, costs = [], []
            if turn:
                f, e = t.boxes[0], t.boxes[-1]
                lx, ly = (e[0] + e[2]) / 2, (e[1] + e[3]) / 2
                vx, vy = lx - (f[0] + f[2]) / 2, ly - (f[1] + f[3]) / 2
                length = math.hypot(vx, vy)
            for k in which:
                b1, c1, b2, c2 = boxes[k]
                w, h = (x2 if x2 < b2 else b2) - (x1 if x1 > b1 else b1), (y2 if y2 < c2 else c2) - (y1 if y1 > c1 else c1)
                inter = w * h if w > 0 and h > 0 else 0.0
                union = area + (b2 - b1) * (c2 - c1) - inter
                over = inter / union if union > 0 else 0.0
                hit, c = over >= self.gate, 1 - over
                if hit and turn and length > 1e-6:
                    dx, dy = (b1 + b2) / 2 - lx, (c1 + c2) / 2 - ly
                    cos = (dx * vx + dy * vy) / (math.hypot(dx, dy) * length + 1e-9)
                    c += turn * (math.acos(min(1.0, max(-1.0, cos))) / math.pi - 0.5)
                if hit and vecs is not None and self.appearance:
                    c += self.appearance * (1 - float(t.vec @ vecs[k]))
                hits.append(hit)
                costs.append(c)
            ok.append(hits)
            cost.append(costs)
        out, done = [], set()
        for i in range(len(tracks)):
            if i in done or not any(ok[i]):
                continue
            rows, cols = {i}, {j for j, x in enumerate(ok[i]) if x}
            while True:
                more = {r for r in range(len(tracks)) if r not in rows and any(ok[r][j] for j in cols)}
                if not more:
                    break
                rows |= more
                cols |= {j for r in more for j, x in enumerate(ok[r]) if x}
            done |= rows
            rows, cols = sorted(rows), sorted(cols)
            if len(rows) == 1 or len(cols) == 1:
                out.append(min(((r, j) for r in rows for j in cols if ok[r][j]), key=lambda p: (cost[p[0]][p[1]], p)))
            else:
                block = [[cost[r][j] if ok[r][j] else 1e3 for j in cols] for r in rows]
                out += [(rows[a], cols[b]) for a, b in m.assign_few(block) if ok[rows[a]][cols[b]]]
        return out

    def _few(self, tracks: list, frame: int, boxes: list, conf: list, vecs, out: list) -> list:
        """step() on plain numbers: the tracks after it; the tracks of the boxes go to out."""
        gap = frame - (frame - 1 if self.frame is None else self.frame)
        self.frame = frame
        tracks = [t for t in tracks if frame - t.seen <= self.buffer]
        fresh = not tracks
        for t in tracks:
            for _ in range(min(gap, self.buffer)):
                t.predict()
        of = [0] * len(boxes)

        def match(some, which, with_vecs=True, use_last=False):
            """Takes what matches: the tracks and the boxes left."""
            pairs = self._pairs(some, boxes, which, vecs if with_vecs else None, use_last)
            for i, j in pairs:
                t, k = some[i], which[j]
                t.update(boxes[k])
                t.seen, t.sure = frame, True
                if vecs is not None:
                    v = 0.9 * t.vec + 0.1 * vecs[k]
                    t.vec = v / max(math.sqrt(v @ v), 1e-12)
                of[k] = t.id
            i, j = {i for i, _ in pairs}, {j for _, j in pairs}
            return [t for k, t in enumerate(some) if k not in i], [b for k, b in enumerate(which) if k not in j]

        sure, unsure = [t for t in tracks if t.sure], [t for t in tracks if not t.sure]
        strong, weak = [k for k, c in enumerate(conf) if c >= self.high], [k for k, c in enumerate(conf) if self.low <= c < self.high]
        left, strong = match(sure, strong)
        match([t for t in left if frame - t.seen <= max(1, gap)], weak, False)
        if self.direction:
            _, strong = match([t for t in sure if t.seen != frame], strong, use_last=True)
        gone, strong = match(unsure, strong)
        if gone:
            lost = {id(t) for t in gone}
            tracks = [t for t in tracks if id(t) not in lost]
        for k in strong:
            if conf[k] >= self.new:
                b = boxes[k]
                value = _measured(b)
                s = value[3]
                own, speed, flat, slow = 2 * s / 20, 10 * s / 160, 1e-2, 1e-5
                tracks.append(_Track(self.next, frame, fresh, value, [0.0] * 4, [own * own, 0.0, speed * speed], [flat * flat, 0.0, slow * slow], [b] * (self.steps + 1), None if vecs is None else vecs[k]))
                of[k] = self.next
                self.next += 1
        out += of
        return tracks


def _measured(b: list) -> list:
    """Centre, aspect and height of a box."""
    h = b[3] - b[1]
    return [(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) / max(h, 1e-6), h]


class _Track:
    """A track as plain numbers. Centre and height have the same noise from the start on, so they share their variances."""

    __slots__ = ("id", "seen", "sure", "value", "speed", "var", "aspect_var", "boxes", "vec")

    def __init__(self, id, seen, sure, value, speed, var, aspect_var, boxes, vec):
        self.id, self.seen, self.sure, self.value, self.speed, self.var, self.aspect_var, self.boxes, self.vec = id, seen, sure, value, speed, var, aspect_var, boxes, vec

    def predict(self) -> None:
        (x, y, a, h), (dx, dy, da, dh) = self.value, self.speed
        s = max(h, 1e-6)
        value, speed = s / 20, s / 160
        self.value = [x + dx, y + dy, a + da, h + dh]
        p, q, r = self.var
        self.var = [p + 2 * q + r + value * value, q + r, r + speed * speed]
        p, q, r = self.aspect_var
        self.aspect_var = [p + 2 * q + r + 1e-2 * 1e-2, q + r, r + 1e-5 * 1e-5]

    def update(self, box: list) -> None:
        (x, y, a, h), (dx, dy, da, dh) = self.value, self.speed
        zx, zy, za, zh = _measured(box)
        noise = max(h, 1e-6) / 20
        p, q, r = self.var
        total = p + noise * noise
        g, k = p / total, q / total
        self.var = [p - g * p, q - g * q, r - k * q]
        p, q, r = self.aspect_var
        total = p + 1e-1 * 1e-1
        ga, ka = p / total, q / total
        self.aspect_var = [p - ga * p, q - ga * q, r - ka * q]
        ox, oy, oa, oh = zx - x, zy - y, za - a, zh - h
        self.value = [x + g * ox, y + g * oy, a + ga * oa, h + g * oh]
        self.speed = [dx + k * ox, dy + k * oy, da + ka * oa, dh + k * oh]
        self.boxes = [*self.boxes[1:], box]


def link_two_stage(df: DataFrame, vec: str | None = None, **how) -> DataFrame:
    """det_id and linked_track (0: none) by the two-stage tracker; vec: the column of the boxes' vectors for ``appearance``.

    Each frame needs the state before, but no state lives longer than the buffer: where a sequence has no box for more
    frames than that, the rest of it is a group of its own, whose tracks are numbered by the place where it begins.
    """
    buffer = how.get("buffer", 30)
    w = Window.partitionBy("seq_id").orderBy("frame_id", "det_id")
    cut = F.coalesce((F.col("frame_id") - F.lag("frame_id").over(w) > buffer).cast("int"), F.lit(0))
    df = df.withColumn("piece", F.sum(cut).over(w))

    def run(batches):
        """Rows come piece by piece in order; a tracker goes on from batch to batch, so a task holds a batch, whatever a sequence's length."""
        tracker, now, kept = Tracker(**how), None, None
        for pdf in batches:
            if kept is not None:
                pdf = pd.concat([kept, pdf], ignore_index=True)
            # the last frame may go on in the next batch
            at = pdf[["seq_id", "piece", "frame_id"]].to_numpy()
            whole = np.flatnonzero((at != at[-1]).any(axis=1))
            n = int(whole[-1]) + 1 if len(whole) else 0
            kept = pdf.iloc[n:]
            if n:
                tracker, now, out = part(pdf.iloc[:n], tracker, now)
                yield out
        if kept is not None and len(kept):
            yield part(kept, tracker, now)[2]

    def part(pdf, tracker, now):
        boxes, conf, frames = pdf[BOX].to_numpy(float), pdf.conf.to_numpy(float), pdf.frame_id.to_numpy()
        vecs = None
        if vec:
            vecs = np.stack(pdf[vec].to_numpy()).astype(float)
            vecs /= np.maximum(np.linalg.norm(vecs, axis=1), 1e-12)[:, None]
        groups = pdf[["seq_id", "piece"]].to_numpy()
        ends = np.append(np.flatnonzero((np.diff(groups, axis=0) != 0).any(axis=1)) + 1, len(pdf)).tolist()
        ids = []
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            if tuple(groups[lo]) != now:
                tracker, now = Tracker(**how), tuple(groups[lo])
            ids.append(tracker.run(frames[lo:hi], boxes[lo:hi], conf[lo:hi], None if vecs is None else vecs[lo:hi]))
        return tracker, now, pdf[[*FRAME, "det_id", "piece"]].assign(linked_track=np.concatenate(ids))

    columns = [*FRAME, "det_id", *BOX, "conf", "piece", *([vec] if vec else [])]
    ordered = df.select(*columns).repartition("seq_id", "piece").sortWithinPartitions("seq_id", "piece", "frame_id", "det_id")
    linked = stored(ordered.mapInPandas(run, "seq_id long, frame_id long, det_id long, piece long, linked_track long"), "linked")
    # numbers of the pieces before are added
    tops = linked.groupBy("seq_id", "piece").agg(F.max("linked_track").alias("top"))
    tops = tops.withColumn("before", F.coalesce(F.sum("top").over(Window.partitionBy("seq_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("top")
    track = F.when(F.col("linked_track") > 0, F.col("linked_track") + F.col("before")).otherwise(0)
    return linked.join(tops, ["seq_id", "piece"]).select(*FRAME, "det_id", track.cast("long").alias("linked_track"))


def stereo_components(pairs: DataFrame) -> DataFrame:
    """Left and right tracks that matches unite: side, track_id and the common output id."""
    roots = components(pairs.selectExpr("left_id * 2 AS a", "right_id * 2 + 1 AS b"))
    return roots.selectExpr("CASE WHEN node % 2 = 0 THEN 'left' ELSE 'right' END AS side", "node DIV 2 AS track_id", "root AS object_id")


def stereo_most_likely(pairs: DataFrame, least: int = 1) -> DataFrame:
    """Each right track goes to the left track with most common frames; further fragments join a left track in order
    of their count as long as their frames are disjoint from those already accepted."""
    g = pairs.groupBy("left_id", "right_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("frame_id")).alias("frames")).where(F.col("n") >= least)
    best = g.withColumn("rn", F.row_number().over(Window.partitionBy("right_id").orderBy(F.desc("n"), "left_id"))).where("rn = 1")
    rows = best.groupBy("left_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "right_id", "frames"))).alias("a"))
    fold = """aggregate(a, named_struct('ids', CAST(array() AS ARRAY<BIGINT>), 'f', CAST(array() AS ARRAY<BIGINT>)), (acc, x) ->
              IF(arrays_overlap(acc.f, x.frames), acc, named_struct('ids', concat(acc.ids, array(x.right_id)), 'f', concat(acc.f, x.frames))), acc -> acc.ids)"""
    return rows.select("left_id", F.posexplode(F.expr(fold)).alias("place", "right_id"))


def stereo_split(pairs: DataFrame, least: int) -> DataFrame:
    """Parts of each left track by partner; a change of partner counts once it has lasted ``least`` frames."""

    w = Window.partitionBy("seq_id", "left_id").orderBy("frame_id", "right_id")
    p = pairs.withColumn("new", F.coalesce((F.lag("right_id").over(w) != F.col("right_id")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    along = Window.partitionBy("seq_id", "left_id").orderBy("run")
    runs = p.groupBy("seq_id", "left_id", "run").agg(F.first("right_id").alias("right_id"), F.count("*").alias("n"))
    counts = (F.col("n") >= least) | (F.col("run") == 1)
    before = F.last(F.when(counts, F.col("right_id")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("turn", F.coalesce((counts & (before != F.col("right_id"))).cast("int"), F.lit(0)))
    runs = runs.select("seq_id", "left_id", "run", F.sum("turn").over(along).cast("int").alias("part"))
    return p.join(runs, ["seq_id", "left_id", "run"]).select("seq_id", "left_id", "frame_id", "part")
