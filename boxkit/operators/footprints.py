"""Boxes that other images see: earlier frames and other cameras, brought together in one reference by homographies.

A frame is a row (seq_id, frame_id, camera, reference, h, width, height, name): h, nine
values by row, takes its pixels to the reference; frames of another reference of a
sequence have nothing in common. The footprint of a frame is the quadrilateral of its
corners in the reference. Footprints lie in cells of the reference, with every cell that
they touch, so that a point meets the frames of its cell only; whether it is inside is
then told exactly, by its pixel in that frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import stored

AT = ["seq_id", "reference"]
KNOWN = "back IS NOT NULL AND left IS NOT NULL AND right IS NOT NULL AND top IS NOT NULL AND bottom IS NOT NULL"
#: Cells of frames that are judged at a time.
CELLS = 1 << 17


def warp(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The point under a homography; null where it lies at infinity."""
    v = [F.get(h, F.lit(3 * r)) * x + F.get(h, F.lit(3 * r + 1)) * y + F.get(h, F.lit(3 * r + 2)) for r in range(3)]
    w = F.when(v[2] != 0, v[2])
    return v[0] / w, v[1] / w


def inverse(h: Column) -> Column:
    """The inverse up to a factor, which points don't feel; null without one."""
    m = [F.get(h, F.lit(k)) for k in range(9)]
    minor = lambda a, b, c, d: m[a] * m[d] - m[b] * m[c]
    adjugate = F.array(minor(4, 5, 7, 8), minor(2, 1, 8, 7), minor(1, 2, 4, 5), minor(5, 3, 8, 6), minor(0, 2, 6, 8), minor(2, 0, 5, 3), minor(3, 4, 6, 7), minor(1, 0, 7, 6), minor(0, 1, 3, 4))
    det = m[0] * minor(4, 5, 7, 8) - m[1] * minor(3, 5, 6, 8) + m[2] * minor(3, 4, 6, 7)
    return F.when(det != 0, adjugate)


def compose(second: Column, first: Column) -> Column:
    """The homography that applies first, then second."""
    a, b = (lambda k: F.get(second, F.lit(k))), (lambda k: F.get(first, F.lit(k)))
    return F.array(*(a(3 * r) * b(c) + a(3 * r + 1) * b(3 + c) + a(3 * r + 2) * b(6 + c) for r in range(3) for c in range(3)))


def cell_size(frames: DataFrame, across: int = 2) -> float:
    """A size of cells of which a usual footprint is so many wide: one number from all frames.

    Only the work rests on it: a frame is a row for each cell that it touches (9 at 2 across, 81 at 8), and cells that
    it covers, which rule out later frames, need a side of less than half a footprint's.
    """
    extent = F.sqrt((F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")))
    size = frames.select(F.percentile_approx(extent, 0.5).alias("e")).first()["e"]
    return float(size) / across if size else 1.0


def _corners(h: Column, w: Column, t: Column) -> list[tuple[Column, Column]]:
    zero = F.lit(0.0)
    return [warp(h, x, y) for x, y in ((zero, zero), (w, zero), (w, t), (zero, t))]


def covered_cells(frames: DataFrame, cell: float) -> DataFrame:
    """The prepared frames (as o_ columns, with the inverse of h) once for each cell gx, gy that they touch; full: whether they cover it.

    The cells of a batch of frames are judged together, CELLS at a time.
    """
    told = ("frame_id", "camera", "back", "width", "height", "name")
    d = frames.where(KNOWN).select(*AT, *told, "left", "right", "top", "bottom")
    kind = {f.name: f.dataType.simpleString() for f in d.schema}
    out = [f"{k} {kind[k]}" for k in AT] + ["gx long", "gy long", "full boolean"] + [f"o_{k} {kind[k]}" for k in told]
    names = [x.split(" ")[0] for x in out]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            number = lambda k, b=b: b.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False)
            x0, x1, y0, y1 = (np.floor(np.nan_to_num(number(k) / cell)).astype(np.int64) for k in ("left", "right", "top", "bottom"))
            across, down = x1 - x0 + 1, y1 - y0 + 1
            ends = np.cumsum(across * down)
            back = b.column("back").flatten().to_numpy(zero_copy_only=False).reshape(-1, 9)
            width, height = number("width"), number("height")
            for start in range(0, int(ends[-1]), CELLS):
                flat = np.arange(start, min(start + CELLS, int(ends[-1])))
                of = np.searchsorted(ends, flat, "right")
                place = flat - (ends - across * down)[of]
                gx, gy = x0[of] + place // down[of], y0[of] + place % down[of]
                full, keep = _judged(back[of].T, width[of], height[of], gx, gy, cell)
                rows = b.take(pa.array(of[keep]))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in AT), pa.array(gx[keep]), pa.array(gy[keep]), pa.array(full[keep]), *(rows.column(k) for k in told)], names=names)

    return d.mapInArrow(run, ", ".join(out))


def _judged(back: np.ndarray, width: np.ndarray, height: np.ndarray, gx: np.ndarray, gy: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether frames cover cells, and whether they may touch them: by the pixels of a cell's corners."""
    inside, beside, depths = np.ones(len(gx), bool), np.ones((4, len(gx)), bool), []
    with np.errstate(all="ignore"):
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
            x, y = (gx + i) * cell, (gy + j) * cell
            u, v, w = (back[3 * r] * x + back[3 * r + 1] * y + back[3 * r + 2] for r in range(3))
            u, v, near = u / w, v / w, w != 0  # a corner at infinity is neither inside nor beside
            inside &= near & (u >= 0) & (u < width) & (v >= 0) & (v < height)
            beside &= near & np.stack([u < 0, u >= width, v < 0, v >= height])
            depths.append(w)
    # a cell that the horizon crosses has no corners to judge by
    whole = (np.minimum.reduce(depths) > 0) | (np.maximum.reduce(depths) < 0)
    return whole & inside, ~(whole & beside.any(0))


def earliest(index: DataFrame) -> DataFrame:
    """Of the frames of a cell those that can be the first to see a point of it: up to the first that covers it."""
    first = F.min(F.when(F.col("full"), F.col("o_frame_id"))).over(Window.partitionBy(*AT, "gx", "gy"))
    return index.withColumn("first", first).where(F.col("first").isNull() | (F.col("o_frame_id") < F.col("first")) | (F.col("full") & (F.col("o_frame_id") == F.col("first")))).drop("first")


def placed(boxes: DataFrame, frames: DataFrame, points: Column, cell: float) -> DataFrame:
    """Boxes once for each of their points (an array of x and y), with the point in the reference (px, py) and its cell."""
    d = boxes.join(frames.select("seq_id", "frame_id", "camera", "reference", "h", "width", "height", F.col("cameras")), ["seq_id", "frame_id", "camera"])
    d = d.withColumn("point", F.explode(points))
    px, py = warp(F.col("h"), F.col("point.x"), F.col("point.y"))
    d = d.withColumn("px", px).withColumn("py", py)
    return d.withColumn("gx", F.floor(F.col("px") / cell)).withColumn("gy", F.floor(F.col("py") / cell))


def _prepared(frames: DataFrame) -> DataFrame:
    """Frames with the number of cameras of their time, the inverse of h, and the extent of their footprint; written once."""
    corners = _corners(F.col("h"), F.col("width"), F.col("height"))
    ends = {"left": F.least(*(p[0] for p in corners)), "right": F.greatest(*(p[0] for p in corners)), "top": F.least(*(p[1] for p in corners)), "bottom": F.greatest(*(p[1] for p in corners))}
    frames = frames.withColumns(ends).withColumn("back", inverse(F.col("h")))
    n = frames.groupBy("seq_id", "frame_id").agg((F.max("camera") + 1).alias("cameras"))
    return stored(frames.join(n, ["seq_id", "frame_id"]), "frames")


def _seen(px: str = "px", py: str = "py") -> Column:
    x, y = warp(F.col("o_back"), F.col(px), F.col(py))
    return (x >= 0) & (x < F.col("o_width")) & (y >= 0) & (y < F.col("o_height"))


def _towards_centre() -> Column:
    """Whether another camera of the same time is nearer to the middle one, on the same side."""
    centre, cam, other = F.floor(F.col("cameras") / 2), F.col("camera"), F.col("o_camera")
    return ((cam < centre) & (other > cam) & (other <= centre)) | ((cam > centre) & (other < cam) & (other >= centre))


def suppress(boxes: DataFrame, frames: DataFrame, past: str = "all", mark: bool = False, cell: float | None = None) -> DataFrame:
    """Boxes whose centre another image has already shown are dropped, or marked (seen).

    past: "all": any frame of an earlier time; "neighbours": the time before, by cameras at most one apart. Besides
    these count cameras of the same time that lie nearer to the middle one. Boxes: seq_id, frame_id, camera, det_id and
    x1 to y2; those of unknown frames are kept.
    """
    if past not in ("all", "neighbours"):
        raise ValueError("past: all or neighbours")
    frames = _prepared(frames)
    cell = 1.0 if past == "neighbours" else cell or cell_size(frames)
    centre = F.array(F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")))
    b = placed(boxes.select("seq_id", "frame_id", "camera", "det_id", "x1", "y1", "x2", "y2"), frames, centre, cell)
    b = b.select(*AT, "frame_id", "camera", "cameras", "det_id", "px", "py", "gx", "gy")
    # frames of one time are few, so these meet by time and need no cells
    others = frames.where(KNOWN).select(*AT, *(F.col(k).alias(f"o_{k}") for k in ("frame_id", "camera", "back", "width", "height")))
    same = (F.col("o_frame_id") == F.col("frame_id")) & _towards_centre()
    if past == "all":
        now = b.withColumn("o_frame_id", F.col("frame_id")).join(others, [*AT, "o_frame_id"]).where(same & _seen()).select("seq_id", "det_id")
        before = earliest(covered_cells(frames, cell)).join(b, [*AT, "gx", "gy"]).where((F.col("o_frame_id") < F.col("frame_id")) & _seen()).select("seq_id", "det_id")
        seen = now.unionByName(before)
    else:
        times = frames.select("seq_id", "reference", "frame_id").distinct()
        w = Window.partitionBy("seq_id").orderBy("frame_id")
        before = times.withColumn("before", F.lag("frame_id").over(w)).withColumn("same", F.lag("reference").over(w).eqNullSafe(F.col("reference")))
        b = b.join(before.where("same").select("seq_id", "frame_id", "before"), ["seq_id", "frame_id"], "left")
        b = b.withColumn("o_frame_id", F.explode(F.filter(F.array("frame_id", "before"), lambda x: x.isNotNull())))
        last = (F.col("o_frame_id") == F.col("before")) & (F.abs(F.col("o_camera") - F.col("camera")) <= 1)
        seen = b.join(others, [*AT, "o_frame_id"]).where((same | last) & _seen()).select("seq_id", "det_id")
    seen = seen.distinct()
    if not mark:
        return boxes.join(seen, ["seq_id", "det_id"], "left_anti")
    return boxes.join(seen.withColumn("seen", F.lit(True)), ["seq_id", "det_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def boundary_cutoff(boxes: DataFrame, frames: DataFrame, threshold: float = 1.0, survey: bool = False, cell: float | None = None) -> DataFrame:
    """Boxes with cut_off: whether a point of their outline near the border of their image lies inside a related frame, and best_view.

    Related are earlier frames and all other cameras of the same time; with survey all other frames. best_view is the name
    of the related frame in which the whole outline lies deepest, if it clears the border there by more than threshold.
    outline, an array of points, is used in place of the corners of a box where boxes have that column.
    """
    frames = _prepared(frames)
    cell = cell or cell_size(frames)
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    corners = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))
    outline = F.when(F.size("outline") > 0, F.col("outline")).otherwise(corners) if "outline" in boxes.columns else corners
    b = boxes.select("seq_id", "frame_id", "camera", "det_id", outline.alias("shape"))
    near = lambda p: (p["x"] <= threshold) | (p["y"] <= threshold) | (p["x"] >= F.col("width") - 1 - threshold) | (p["y"] >= F.col("height") - 1 - threshold)
    points = placed(b, frames, F.filter("shape", near), cell)
    other = (F.col("o_frame_id") != F.col("frame_id")) | (F.col("o_camera") != F.col("camera"))
    related = other if survey else (F.col("o_frame_id") < F.col("frame_id")) | ((F.col("o_frame_id") == F.col("frame_id")) & (F.col("o_camera") != F.col("camera")))
    met = covered_cells(frames, cell).join(points, [*AT, "gx", "gy"]).where(related & _seen())
    # a frame that holds the whole outline holds its points near the border too, so it is among those met
    met = met.dropDuplicates(["seq_id", "det_id", "o_frame_id", "o_camera"])
    there = F.transform("shape", lambda p: F.struct(*(c.alias(k) for k, c in zip("xy", warp(F.col("o_back"), *warp(F.col("h"), p["x"], p["y"])), strict=True))))
    met = met.withColumn("there", there)
    xs, ys = F.transform("there", lambda p: p["x"]), F.transform("there", lambda p: p["y"])
    depth = F.least(F.array_min(xs), F.array_min(ys), F.col("o_width") - 1 - F.array_max(xs), F.col("o_height") - 1 - F.array_max(ys))
    clear = F.when((depth > threshold) & F.col("o_name").isNotNull(), F.struct(depth.alias("d"), (-F.col("o_frame_id")).alias("f"), (-F.col("o_camera")).alias("c"), F.col("o_name").alias("name")))
    marks = met.groupBy("seq_id", "det_id").agg(F.lit(True).alias("cut_off"), F.max(clear)["name"].alias("best_view"))
    return boxes.join(marks, ["seq_id", "det_id"], "left").withColumn("cut_off", F.coalesce("cut_off", F.lit(False)))
