"""Joins of boxes: overlap, one-to-one matching, suppression, nearest in time.

All joins have equality keys (sequence and frame, a grid cell, a time bucket), so
they shuffle on those and never compare frames with each other. One-to-one
matching is a fold over the sorted candidate pairs of a frame, inside the JVM.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import box
from ..shared import stored
from .components import components

FRAME = ["seq_id", "frame_id"]
TAKEN = "CAST(array() AS ARRAY<STRUCT<k: DOUBLE, c_id: BIGINT, t_id: BIGINT, iou: DOUBLE>>)"


def iou_join(computed: DataFrame, truth: DataFrame, least: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of boxes of a frame with overlap of at least ``least``; columns c_ and t_, iou."""
    keys = keys or FRAME
    pairs = box.prefixed(computed, "c_", keys).join(box.prefixed(truth, "t_", keys), keys)
    pairs = pairs.withColumn("iou", box.iou("c_", "t_"))
    return pairs.where((F.col("iou") >= least) & (F.col("iou") > 0))


def iou_join_grid(computed: DataFrame, truth: DataFrame, least: float, cell: float, keys: list[str] | None = None) -> DataFrame:
    """The same pairs for dense frames: boxes meet by the grid cells that they touch."""
    keys = keys or FRAME

    def celled(df, p):
        cells = lambda a, b: F.sequence(F.floor(F.col(p + a) / cell), F.floor(F.col(p + b) / cell))
        return df.withColumn("cx", F.explode(cells("x1", "x2"))).withColumn("cy", F.explode(cells("y1", "y2")))

    a, b = celled(box.prefixed(computed, "c_", keys), "c_"), celled(box.prefixed(truth, "t_", keys), "t_")
    pairs = a.join(b, [*keys, "cx", "cy"])
    # a pair counts in the first cell that both touch
    first = (F.col("cx") == F.floor(F.greatest("c_x1", "t_x1") / cell)) & (F.col("cy") == F.floor(F.greatest("c_y1", "t_y1") / cell))
    return pairs.where(first).drop("cx", "cy").withColumn("iou", box.iou("c_", "t_")).where((F.col("iou") >= least) & (F.col("iou") > 0))


def one_to_one(pairs: DataFrame, rank: Column, keys: list[str], *extra: str) -> DataFrame:
    """Pairs taken in ascending (rank, -iou, ids) as long as neither side is taken; keys, c_id, t_id, iou and extra columns of the pairs."""
    kept = [F.col(x) for x in extra]
    cand = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(rank.cast("double").alias("k"), (-F.col("iou")).alias("niou"), F.col("c_det_id").alias("c_id"), F.col("t_det_id").alias("t_id"), *kept))).alias("cand"))
    types = "".join(f", {x}: {pairs.schema[x].dataType.simpleString()}" for x in extra)
    own = "".join(f", x.{x} AS {x}" for x in extra)
    fold = f"""inline(aggregate(cand, {TAKEN.replace("iou: DOUBLE", f"iou: DOUBLE{types}")}, (acc, x) -> CASE WHEN exists(acc, m -> m.c_id = x.c_id OR m.t_id = x.t_id)
             THEN acc ELSE concat(acc, array(struct(x.k AS k, x.c_id AS c_id, x.t_id AS t_id, -x.niou AS iou{own}))) END))"""
    return cand.selectExpr(*keys, fold).drop("k")


def one_to_one_by_rounds(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The same choice by falling iou (then ids) for groups of any size: each round takes the pairs that come first for both sides.

    No pair before such a one shares a side with it, so the fold would take it too; what it rules out leaves before the next round.
    """
    order = [F.desc("iou"), "c_id", "t_id"]
    left, taken = stored(pairs.select(*keys, F.col("c_det_id").alias("c_id"), F.col("t_det_id").alias("t_id"), "iou")), []
    while True:
        first = lambda side: F.row_number().over(Window.partitionBy(*keys, side).orderBy(*order)) == 1  # noqa: E731, B023
        seen = stored(left.withColumn("first_c", first("c_id")).withColumn("best", F.col("first_c") & first("t_id")).drop("first_c"))
        best = seen.where("best").select(*keys, "c_id", "t_id", "iou")
        taken.append(best)
        left = seen.where("NOT best").drop("best").join(best.select(*keys, "c_id"), [*keys, "c_id"], "left_anti").join(best.select(*keys, "t_id"), [*keys, "t_id"], "left_anti").select(*keys, "c_id", "t_id", "iou")
        left = stored(left)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def match_greedy(computed: DataFrame, truth: DataFrame, least: float = 0.5, keys: list[str] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one matches by falling overlap, with extra columns of both (c_ and t_), which then need no join."""
    keys = keys or FRAME
    return one_to_one(iou_join(computed, truth, least, keys), -F.col("iou"), keys, *extra)


def match_by_confidence(computed: DataFrame, truth: DataFrame, least: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """One-to-one matches in which boxes choose by falling confidence, each the best free truth of enough overlap.

    The best free truth fails the threshold only if all free ones do, so pairs below it can go first;
    equal confidences are ordered by id, as a box takes all its candidates in a row.
    """
    keys = keys or FRAME
    return confident(iou_join(computed, truth, least, keys).where(F.col("iou") >= least), keys)


def confident(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The choice of match_by_confidence() among given pairs (iou, c_conf and ids)."""
    cand = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("c_conf")).alias("k"), F.col("c_det_id").alias("c_id"), (-F.col("iou")).alias("niou"), F.col("t_det_id").alias("t_id")))).alias("cand"))
    fold = f"""inline(aggregate(cand, {TAKEN}, (acc, x) -> CASE WHEN exists(acc, m -> m.c_id = x.c_id OR m.t_id = x.t_id)
             THEN acc ELSE concat(acc, array(struct(x.k AS k, x.c_id AS c_id, x.t_id AS t_id, -x.niou AS iou))) END))"""
    return cand.selectExpr(*keys, fold).drop("k")


def assignment(cost) -> list[tuple[int, int]]:
    """The assignment of least total cost of a dense matrix, by potentials (rows at most columns)."""
    import numpy as np

    cost = np.asarray(cost, float)
    turned = cost.shape[0] > cost.shape[1]
    a = cost.T if turned else cost
    n, m = a.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            reduced = a[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(free.argmin()) + 1
            step = free[j1 - 1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(j, i) for i, j in out] if turned else out


def assign_few(cost: list[list[float]]) -> list[tuple[int, int]]:
    """assignment() of a small matrix, by the same steps on plain numbers."""
    turned = len(cost) > len(cost[0])
    a = [list(c) for c in zip(*cost, strict=True)] if turned else cost
    n, m = len(a), len(a[0])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [np.inf] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while match[j0]:
            used[j0] = True
            i0, j1, step = match[j0], 0, np.inf
            for j in range(1, m + 1):
                if not used[j]:
                    reduced = a[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < step or not j1:
                        step, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(j, i) for i, j in out] if turned else out


def assign_sparse(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The one-to-one choice of pairs (row, column, cost below 1) of the least total cost, where a row without a pair costs 1.

    Rows come one after the other, each along the shortest path of changes to a free column or to none, with prices that
    keep costs from being negative. Only the given pairs are held, and a path explores no further than it has to, so a
    row costs about as much as the block of overlapping pairs around it, and blocks that don't touch never meet.
    """
    import heapq

    edges: dict[int, list[tuple[int, float]]] = {}
    for r, c, cost in pairs:
        edges.setdefault(r, []).append((c, cost))
    price: dict = {}  # of columns; a row's own way to stay alone is the column (row,)
    holder: dict = {}
    column: dict[int, object] = {}
    worth: dict[int, float] = {}
    for r in edges:
        edges[r].append(((r,), 1.0))
        worth[r] = min(cost - price.get(c, 0.0) for c, cost in edges[r])
    for start in edges:
        far, back, done, heap = {}, {}, {}, []
        row, at = start, 0.0
        count = 0
        while True:
            for c, cost in edges[row]:
                if c in done:
                    continue
                d = at + cost - price.get(c, 0.0) - worth[row]
                if d < far.get(c, np.inf):
                    far[c], back[c] = d, row
                    count += 1
                    heapq.heappush(heap, (d, count, c))
            while True:
                at, _, c = heapq.heappop(heap)
                if c not in done and at <= far[c]:
                    break
            done[c] = at
            if c not in holder:
                break
            row = holder[c]
        worth[start] += at
        for k, d in done.items():
            if k in holder and k != c:
                worth[holder[k]] += at - d
                price[k] = price.get(k, 0.0) - (at - d)
        while True:
            row = back[c]
            before = column.get(row)
            holder[c], column[row] = row, c
            if row == start:
                break
            c = before
    return sorted((r, c) for r, c in column.items() if not isinstance(c, tuple))


def solve_frames(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """The matches of some frames of a sequence, frame by frame along the sorted pairs."""
    rows = []
    pdf = pdf.sort_values(["frame_id", "c_det_id", "t_det_id"])
    frame, c, t, o = (pdf[k].tolist() for k in ("frame_id", "c_det_id", "t_det_id", "iou"))
    seq, start = pdf.seq_id.iloc[0], 0
    for end in range(1, len(frame) + 1):
        if end < len(frame) and frame[end] == frame[start]:
            continue
        over = {(c[i], t[i]): o[i] for i in range(start, end)}
        chosen = assign_sparse([(*k, 1 - v) for k, v in over.items()])
        rows += [(seq, frame[start], *k, over[k]) for k in chosen if over[k] >= least]
        start = end
    return pd.DataFrame(rows, columns=["seq_id", "frame_id", "c_id", "t_id", "iou"])


def match_optimal(computed: DataFrame, truth: DataFrame, least: float = 0.5, frames: int = 32) -> DataFrame:
    """One-to-one matches of the least sum of 1 - overlap, from the list of overlapping pairs of a frame, no matrix.

    So many frames of a sequence go to Python together; each is solved for itself.
    """

    pairs = iou_join(computed, truth, 0.0).select(*FRAME, "c_det_id", "t_det_id", "iou")
    return pairs.groupBy("seq_id", F.floor(F.col("frame_id") / frames).alias("block")).applyInPandas(lambda pdf: solve_frames(pdf, least), "seq_id long, frame_id long, c_id long, t_id long, iou double")


def unmatched(boxes: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Boxes of a side ('c_id' or 't_id') that no match has."""
    return boxes.join(matches.select(*FRAME, F.col(side).alias("det_id")), [*FRAME, "det_id"], "left_anti")


def align_sequences(computed: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of files by base name without directories, extension and _detections or _tracks; missing partners are null."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[^.]*$", ""), r"_(detections|tracks)$", "")
    a = computed.select(clean(F.col("path")).alias("name"), F.col("path").alias("computed"))
    return a.join(truth.select(clean(F.col("path")).alias("name"), F.col("path").alias("truth")), "name", "full")


def reconcile_frames(computed: DataFrame, truth: DataFrame) -> DataFrame:
    """Frame names of both sides (seq_id, frame_id, frame_name): the joint one, and whether they differ."""
    a = computed.select(*FRAME, F.col("frame_name").alias("a")).distinct()
    b = truth.select(*FRAME, F.col("frame_name").alias("b")).distinct()
    both = a.join(b, FRAME, "full")
    return both.select(*FRAME, F.coalesce("b", "a").alias("frame_name"), F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("differs"))


def suppress_in_regions(boxes: DataFrame, regions: DataFrame, least: float, suppress: str | None = None, borderline: str | None = None, scale: float = 0.5) -> DataFrame:
    """Drops boxes covered by suppression regions for at least a share; scales scores in borderline ones.

    Without both classes any region suppresses.
    """
    hit = box.prefixed(boxes, "c_", FRAME).join(box.prefixed(regions, "t_", FRAME), FRAME)
    hit = hit.where(box.intersection("c_", "t_") / box.area("c_") >= least)
    drop = F.lit(True) if suppress is None and borderline is None else F.col("t_cls") == suppress
    state = hit.groupBy(*FRAME, F.col("c_det_id").alias("det_id")).agg(F.bool_or(F.coalesce(drop, F.lit(False))).alias("dropped"), F.bool_or(F.coalesce(F.col("t_cls") == borderline, F.lit(False)) if borderline else F.lit(False)).alias("border"))
    out = boxes.join(state, [*FRAME, "det_id"], "left").where(~F.coalesce("dropped", F.lit(False)))
    return out.withColumn("conf", F.when(F.coalesce("border", F.lit(False)), F.col("conf") * scale).otherwise(F.col("conf"))).drop("dropped", "border")


def coverage_reinforce(boxes: DataFrame, evidence: DataFrame, alpha: float = 0.5, low: float = 0.1, recover: bool = True, max_evidence_area: float = 0.0) -> DataFrame:
    """Raises scores by the share of a box that evidence covers; evidence that touches no box comes out at low scores, by its area.

    max_evidence_area: larger evidence doesn't count, if over 0. recover: whether loose evidence comes out at all, at low times
    its area over the largest loose one of the frame.
    """
    if max_evidence_area > 0:
        evidence = evidence.where(box.area() <= max_evidence_area)
    hit = box.prefixed(boxes, "c_", FRAME).join(box.prefixed(evidence, "t_", FRAME), FRAME).withColumn("common", box.intersection("c_", "t_")).where("common > 0")
    cover = hit.groupBy(*FRAME, F.col("c_det_id").alias("det_id")).agg((F.sum("common") / F.first(box.area("c_"))).alias("cover"))
    raised = boxes.join(cover, [*FRAME, "det_id"], "left").withColumn("cover", F.least(F.lit(1.0), F.coalesce("cover", F.lit(0.0))))
    raised = raised.withColumn("conf", F.col("conf") + alpha * F.col("cover") * (1 - F.col("conf"))).drop("cover")
    if not recover:
        return raised
    used = hit.select(*FRAME, F.col("t_det_id").alias("det_id")).distinct()
    free = evidence.join(used, [*FRAME, "det_id"], "left_anti")
    largest = free.groupBy(*FRAME).agg(F.max(box.area()).alias("largest"))
    free = free.join(largest, FRAME).withColumn("conf", low * F.when(F.col("largest") > 0, box.area() / F.col("largest")).otherwise(0.0)).drop("largest")
    return raised.unionByName(free.select(*raised.columns))


def suppress_prior(boxes: DataFrame, prior: DataFrame, mark: bool = False, cell: float = 64.0) -> DataFrame:
    """Boxes whose centre lies in an earlier footprint of the sequence (frame < own frame) are dropped, or marked.

    prior: seq_id, frame_id and the footprint as x1..y2. Only the first frame of equal footprints counts, and
    boxes meet footprints by grid cells, so the frames of a sequence aren't compared with each other.
    """
    cx, cy = box.centre()
    b = boxes.withColumn("_cx", cx).withColumn("_cy", cy).withColumn("_gx", F.floor(F.col("_cx") / cell)).withColumn("_gy", F.floor(F.col("_cy") / cell))
    p = prior.groupBy("seq_id", *box.names()).agg(F.min("frame_id").alias("p_frame"))
    p = p.select("seq_id", "p_frame", *(F.col(k).alias(f"p_{k}") for k in box.names()))
    cells = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(z) / cell)))
    p = p.withColumn("p_gx", cells("p_x1", "p_x2")).withColumn("p_gy", cells("p_y1", "p_y2"))
    cond = (b["seq_id"] == p["seq_id"]) & (F.col("_gx") == F.col("p_gx")) & (F.col("_gy") == F.col("p_gy")) & (F.col("p_frame") < b["frame_id"]) & F.col("_cx").between(F.col("p_x1"), F.col("p_x2")) & F.col("_cy").between(F.col("p_y1"), F.col("p_y2"))
    if not mark:
        return b.join(p, cond, "left_anti").drop("_cx", "_cy", "_gx", "_gy")
    seen = b.join(p, cond, "left_semi").select("det_id").distinct().withColumn("seen", F.lit(True))
    return boxes.join(seen, "det_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def boundary_cutoff(boxes: DataFrame, others: DataFrame, w: float, h: float, margin: float) -> DataFrame:
    """Marks boxes whose outline comes near the image border where another camera's region covers it."""
    near = (F.col("c_x1") <= margin) | (F.col("c_y1") <= margin) | (F.col("c_x2") >= w - margin) | (F.col("c_y2") >= h - margin)
    hit = box.prefixed(boxes, "c_", FRAME).join(box.prefixed(others, "t_", FRAME), FRAME).where(near & (box.intersection("c_", "t_") > 0))
    cut = hit.select(*FRAME, F.col("c_det_id").alias("det_id")).distinct().withColumn("cut_off", F.lit(True))
    return boxes.join(cut, [*FRAME, "det_id"], "left").withColumn("cut_off", F.coalesce("cut_off", F.lit(False)))


def match_points(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """Left and right boxes by the mean distance of projected head and tail points (px, py, qx, qy), nearest first."""
    pairs = box.prefixed(left, "c_", FRAME).join(box.prefixed(right, "t_", FRAME), FRAME)
    d = (F.sqrt(F.pow(F.col("c_px") - F.col("t_px"), 2) + F.pow(F.col("c_py") - F.col("t_py"), 2)) + F.sqrt(F.pow(F.col("c_qx") - F.col("t_qx"), 2) + F.pow(F.col("c_qy") - F.col("t_qy"), 2))) / 2
    return one_to_one(pairs.withColumn("iou", -d).where(d <= most), -F.col("iou"), FRAME).withColumnRenamed("iou", "cost").withColumn("cost", -F.col("cost"))


def tube_iou(a: DataFrame, b: DataFrame, least_frames: int = 1, volume: bool = False) -> DataFrame:
    """Overlap of track pairs: mean IoU of common frames, or common volume over united volume."""
    pairs = box.prefixed(a, "c_", FRAME).join(box.prefixed(b, "t_", FRAME), FRAME)
    pairs = pairs.withColumn("iou", box.iou("c_", "t_")).withColumn("common", box.intersection("c_", "t_"))
    g = pairs.groupBy("seq_id", "c_track_id", "t_track_id").agg(F.count("*").alias("frames"), F.avg("iou").alias("mean_iou"), F.sum("common").alias("common")).where(F.col("frames") >= least_frames)
    if not volume:
        return g.drop("common").where("mean_iou > 0")
    size = lambda df, p: df.groupBy("seq_id", F.col("track_id").alias(f"{p}track_id")).agg(F.sum(box.area()).alias(f"{p}size"))
    g = g.join(size(a, "c_"), ["seq_id", "c_track_id"]).join(size(b, "t_"), ["seq_id", "t_track_id"])
    return g.withColumn("volume_iou", F.col("common") / (F.col("c_size") + F.col("t_size") - F.col("common"))).drop("common", "c_size", "t_size").where("volume_iou > 0")


def tile_boundary_merge(boxes: DataFrame, strips: DataFrame, least: float) -> DataFrame:
    """Boxes of neighbouring tiles (tile, cls) that both lie in their overlap strip for a share become their hull.

    strips: tile_a < tile_b and the strip x1..y2. Pairs are merged by falling overlap, each box once.
    """
    a = box.prefixed(boxes, "c_", FRAME).withColumnRenamed("c_tile", "tile_a")
    b = box.prefixed(boxes, "t_", FRAME).withColumnRenamed("t_tile", "tile_b")
    s = strips.select("tile_a", "tile_b", *(F.col(k).alias(f"s_{k}") for k in box.names()))
    pairs = a.join(s, "tile_a").join(b, [*FRAME, "tile_b"]).where("c_cls = t_cls")  # strips: one row per pair of tiles
    pairs = pairs.where((box.intersection("c_", "s_") >= least * box.area("c_")) & (box.intersection("t_", "s_") >= least * box.area("t_"))).withColumn("iou", box.iou("c_", "t_")).where("iou > 0")
    m = one_to_one(pairs, -F.col("iou"), FRAME)
    j = m.join(box.prefixed(boxes, "c_", FRAME).withColumnRenamed("c_det_id", "c_id"), [*FRAME, "c_id"]).join(box.prefixed(boxes, "t_", FRAME).withColumnRenamed("t_det_id", "t_id"), [*FRAME, "t_id"])
    hull = [F.least("c_x1", "t_x1").alias("x1"), F.least("c_y1", "t_y1").alias("y1"), F.greatest("c_x2", "t_x2").alias("x2"), F.greatest("c_y2", "t_y2").alias("y2")]
    merged = j.select(*FRAME, F.col("c_id").alias("det_id"), *hull, F.greatest("c_conf", "t_conf").alias("conf"), F.col("c_cls").alias("cls"))
    gone = m.select(*FRAME, F.col("c_id").alias("det_id")).unionByName(m.select(*FRAME, F.col("t_id").alias("det_id")))
    return boxes.join(gone, [*FRAME, "det_id"], "left_anti").select(*merged.columns).unionByName(merged)


def chip_truth(boxes: DataFrame, chips: DataFrame, overlap: float, least_side: float, ignored: str | None = None) -> DataFrame:
    """Truth on chips in their coordinates; chips with a too small box or without truth are dropped.

    A box is on a chip when this share of its area is; a box of the ignored class keeps its chip.
    """
    j = box.prefixed(boxes, "c_", FRAME).join(F.broadcast(chips))  # the grid of one image size
    inter = F.greatest(F.lit(0.0), F.least("c_x2", "tx2") - F.greatest("c_x1", "tx")) * F.greatest(F.lit(0.0), F.least("c_y2", "ty2") - F.greatest("c_y1", "ty"))
    j = j.where(inter / box.area("c_") >= overlap)
    keep = F.col("c_cls") == ignored if ignored else F.lit(False)
    small = (F.least(box.width("c_"), box.height("c_")) < least_side) & ~keep
    gate = j.groupBy(*FRAME, "tx", "ty").agg(F.bool_or(small).alias("bad")).where("NOT bad").drop("bad")
    cut = lambda k, t, t2: (F.least(F.greatest(F.col(f"c_{k}"), F.col(t)), F.col(t2)) - F.col(t)).alias(k)
    return j.join(gate, [*FRAME, "tx", "ty"], "left_semi").select(*FRAME, "tx", "ty", F.col("c_det_id").alias("det_id"), F.col("c_cls").alias("cls"), cut("x1", "tx", "tx2"), cut("y1", "ty", "ty2"), cut("x2", "tx", "tx2"), cut("y2", "ty", "ty2"))


def label_overlap(descriptors: DataFrame, truth: DataFrame, positive: float = 0.5, background: float = 0.1) -> DataFrame:
    """Class of each descriptor's box by the truth that it shares most with; null in between, 'background' below."""
    j = box.prefixed(descriptors, "c_", FRAME).join(box.prefixed(truth, "t_", FRAME), FRAME, "left")
    share = F.coalesce(F.least(box.intersection("c_", "t_") / box.area("c_"), box.intersection("c_", "t_") / box.area("t_")), F.lit(0.0))
    best = j.groupBy(*FRAME, F.col("c_det_id").alias("det_id")).agg(F.max(F.struct(share.alias("share"), (-F.col("t_det_id")).alias("o"), F.col("t_cls").alias("cls"))).alias("b"))
    return best.select(*FRAME, "det_id", F.col("b.share").alias("share"), F.when(F.col("b.share") >= positive, F.col("b.cls")).when(F.col("b.share") < background, "background").alias("label"))


def nearest_in_time(left: DataFrame, right: DataFrame, most_us: int, keys: list[str], outer: bool = True) -> DataFrame:
    """Each left row (id, us) with the nearest right row within an offset, the earlier of equally near ones.

    Rows meet by time bucket: left rows in their own, right rows in their own and both neighbours.
    """
    a = left.withColumn("_b", F.floor(F.col("us") / most_us))
    b = right.withColumn("_b", F.explode(F.array(*(F.floor(F.col("us") / most_us) + d for d in (-1, 0, 1)))))
    b = b.select(*keys, "_b", F.col("id").alias("r_id"), F.col("us").alias("r_us"))
    near = a.join(b, [*keys, "_b"]).withColumn("off", F.abs(F.col("us") - F.col("r_us"))).where(F.col("off") <= most_us)
    best = near.groupBy(*keys, "id").agg(F.min(F.struct("off", "r_us", "r_id")).alias("m")).select(*keys, "id", F.col("m.r_id").alias("r_id"), F.col("m.off").alias("off"))
    return left.select(*keys, "id").join(best, [*keys, "id"], "left") if outer else best


def close_pairs(df: DataFrame, most: float) -> DataFrame:
    """Pairs of tracks of a frame whose centres are closer than a distance."""
    a, b = box.prefixed(df, "c_", FRAME), box.prefixed(df, "t_", FRAME)
    return a.join(b, FRAME).where("c_track_id < t_track_id").withColumn("distance", box.distance("c_", "t_")).where(F.col("distance") < most)


def overlapping_pairs(df: DataFrame) -> DataFrame:
    a, b = box.prefixed(df, "c_", FRAME), box.prefixed(df, "t_", FRAME)
    return a.join(b, FRAME).where("c_det_id < t_det_id").withColumn("iou", box.iou("c_", "t_")).where("iou > 0")


def chain_cameras(cameras: list[DataFrame], least: float = 0.5) -> DataFrame:
    """object_id, det_id and camera of boxes that are matched from each camera to the next one, frame by frame, chained to one object.

    A chain never leaves its frame, so the matches of a frame are gathered and followed there, from camera to camera.
    """
    n, links = len(cameras), None
    for i, (a, b) in enumerate(zip(cameras, cameras[1:], strict=False)):
        e = match_greedy(a, b, least).select(*FRAME, F.lit(i).alias("i"), F.col("c_id").cast("long"), F.col("t_id").cast("long"))
        links = e if links is None else links.unionByName(e)
    d = links.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("i", "c_id", "t_id"))).alias("links"))
    node = lambda id_, camera: f"{id_} * {n + 1} + {camera}"
    goes_on, put = "p.at = x.i AND p.last = x.c_id", f"struct(x.i + 1 AS at, x.t_id AS last, concat(p.nodes, array({node('x.t_id', '(x.i + 1)')})) AS nodes)"
    new = f"struct(x.i + 1 AS at, x.t_id AS last, array({node('x.c_id', 'x.i')}, {node('x.t_id', '(x.i + 1)')}) AS nodes)"
    none = "CAST(array() AS ARRAY<STRUCT<at: INT, last: BIGINT, nodes: ARRAY<BIGINT>>>)"
    fold = f"aggregate(links, {none}, (acc, x) -> IF(exists(acc, p -> {goes_on}), transform(acc, p -> IF({goes_on}, {put}, p)), concat(acc, array({new}))))"
    d = d.selectExpr(f"explode({fold}) AS p").selectExpr("array_min(p.nodes) AS object_id", "explode(p.nodes) AS node")
    return d.selectExpr("object_id", f"node DIV {n + 1} AS det_id", f"node % {n + 1} AS camera")


def region_groups(regions: DataFrame, more_than: int) -> DataFrame:
    """In frames with more regions than that, the hull of each group of regions that overlap one another directly or by others (n: how many)."""
    many = regions.groupBy(*FRAME).agg(F.count("*").alias("n")).where(F.col("n") > more_than).drop("n")
    t = regions.join(many, FRAME, "left_semi")
    groups = components(overlapping_pairs(t).selectExpr("c_det_id AS a", "t_det_id AS b"))
    j = t.join(groups, t["det_id"] == groups["node"], "left").withColumn("grp", F.coalesce("root", "det_id"))
    return j.groupBy(*FRAME, "grp").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n"))
