"""Row filters and projections over boxes and tracks.

Keys: seq_id (a clip or file), frame_id, det_id, track_id; columns x1..y2, conf, cls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import box

TRACK = ["seq_id", "track_id"]
FRAME = ["seq_id", "frame_id"]


def top_class(df: DataFrame, scores: str = "scores") -> DataFrame:
    """cls and cls_score of the best (name, score) entry; of equal scores the first entry."""
    at = F.array_position(F.transform(scores, lambda e: e["score"]), F.array_max(F.transform(scores, lambda e: e["score"])))
    best = F.element_at(scores, at.cast("int"))
    return df.withColumn("cls", best["name"]).withColumn("cls_score", best["score"])


def conf_filter(df: DataFrame, least: float, truth: bool = False) -> DataFrame:
    """Rows of at least this confidence; truth is never filtered."""
    return df if truth else df.where(F.col("conf") >= least)


def type_filter(df: DataFrame, least: float, score: str = "cls_score") -> DataFrame:
    return df.where(F.col(score) >= least)


def fid_shift(df: DataFrame, by: int) -> DataFrame:
    return df.withColumn("frame_id", F.col("frame_id") + by)


def fid_window(df: DataFrame, lower: int, upper: int) -> DataFrame:
    """Frames from lower on, counted from 0; then those up to upper - lower."""
    return df.where(F.col("frame_id") >= lower).withColumn("frame_id", F.col("frame_id") - lower).where(F.col("frame_id") <= upper - lower)


def tracks_of_states(df: DataFrame, least: int = 2) -> DataFrame:
    """Rows of tracks with at least so many states."""
    n = df.groupBy(*TRACK).count().where(F.col("count") >= least).drop("count")
    return df.join(n, TRACK, "left_semi")


def tracks_in_range(df: DataFrame, min_len: int, max_len: int, min_area: float, max_area: float) -> DataFrame:
    """Rows of tracks whose length and mean box area lie within bounds."""
    t = df.groupBy(*TRACK).agg(F.count("*").alias("n"), F.avg(box.area()).alias("area"))
    t = t.where(F.col("n").between(min_len, max_len) & F.col("area").between(min_area, max_area)).select(*TRACK)
    return df.join(t, TRACK, "left_semi")


def replace_class(df: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Classes by a table (alias, canonical); a replaced class has score 1."""
    out = df.join(synonyms, df["cls"] == synonyms["alias"], "left")
    hit = F.col("canonical").isNotNull()
    return out.withColumn("conf", F.when(hit, 1.0).otherwise(F.col("conf"))).withColumn("cls", F.coalesce("canonical", "cls")).drop("alias", "canonical")


def class_hierarchy(df: DataFrame, synonyms: DataFrame, key: str = "det_id", scores: str = "scores") -> DataFrame:
    """key, canonical class and best score: names are mapped, unknown ones dropped, the best score of each kept."""
    e = df.select(key, F.explode(scores).alias("e")).select(key, F.col("e.name").alias("alias"), F.col("e.score").alias("score"))
    return e.join(synonyms, "alias").groupBy(key, F.col("canonical").alias("cls")).agg(F.max("score").alias("score"))


def class_view(df: DataFrame, cls: str, least: float = 0.0, scores: str = "scores") -> DataFrame:
    """One class's score for every row that has it, whatever its best class."""
    s = F.element_at(F.filter(scores, lambda e: e["name"] == cls), 1)["score"]
    return df.where(F.exists(scores, lambda e: e["name"] == cls)).withColumn("cls", F.lit(cls)).withColumn("conf", s).where(F.col("conf") >= least)


def top_n_classes(df: DataFrame, n: int, scores: str = "scores") -> DataFrame:
    """At most n entries, the highest scores first, of equal ones by name."""
    by = F.array_sort(F.transform(scores, lambda e: F.struct((-e["score"]).alias("s"), e["name"].alias("name"))))
    return df.withColumn(scores, F.transform(F.slice(by, 1, n), lambda e: F.struct(e["name"].alias("name"), (-e["s"]).alias("score"))))


def filter_frames(frames: DataFrame, boxes: DataFrame, least: float, inverted: bool = False) -> DataFrame:
    """Frames with, or without, a box of at least this confidence."""
    return frames.join(boxes.where(F.col("conf") >= least), FRAME, "left_anti" if inverted else "left_semi")


def sample_frames(frames: DataFrame, step: int, order: str = "frame_id", key: str = "seq_id") -> DataFrame:
    """The first frame, then each one that is at least step after the last kept; the ids of one sequence are a group."""
    import numpy as np
    import pandas as pd

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf[order].to_numpy())
        kept, at = [], 0
        while at < len(ids):
            kept.append(ids[at])
            at = int(np.searchsorted(ids, ids[at] + step))
        return pd.DataFrame({key: pdf[key].iloc[0], order: kept})

    ids = frames.select(key, order).distinct()
    kept = ids.groupBy(key).applyInPandas(thin, ids.schema)
    return frames.join(kept, [key, order], "left_semi")


def suppress_small(df: DataFrame, least: float) -> DataFrame:
    return df.where((box.width() >= least) & (box.height() >= least))


def add_fixed(df: DataFrame, frames: DataFrame, w: float, h: float, cls: str) -> DataFrame:
    """The boxes and one whole-image box per frame."""
    whole = frames.select("seq_id", "frame_id", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(float(w)).alias("x2"), F.lit(float(h)).alias("y2"), F.lit(1.0).alias("conf"), F.lit(cls).alias("cls"))
    return df.select(*whole.columns).unionByName(whole)


def to_full_frame(df: DataFrame, w: float, h: float) -> DataFrame:
    """One whole-image row for each class of a frame, that of the first box."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(*FRAME, "cls").orderBy("det_id"))).where("_n = 1").drop("_n")
    return first.withColumns({"x1": F.lit(0.0), "y1": F.lit(0.0), "x2": F.lit(float(w)), "y2": F.lit(float(h))})


def notes_to_attrs(notes: Column | str) -> Column:
    """':key=value' notes as (atr) entries, key and value joined by a blank."""
    keep = F.filter(notes, lambda n: n.rlike(r"^:[^=]+=.*"))
    return F.transform(keep, lambda n: F.concat(F.lit("(atr) "), F.regexp_extract(n, r"^:([^=]+)=(.*)$", 1), F.lit(" "), F.regexp_extract(n, r"^:([^=]+)=(.*)$", 2)))


#: Spellings of a time in a file's name, tried in order: a pattern with year, month, day, hour, minute, second and fraction. Fixed formats.
NAME_TIMES = {
    "flight": r"^CHESS_[^_]*_[^_]*_(\d\d)(\d\d)(\d\d)[^_]*_(\d\d)(\d\d)(\d\d).(\d{3})[^_]*",
    "zone": r"^CHESS[^_]+(?:_[^_]*){2}_[^_]*_(?:_)?(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).(\d{3})GMT",
    "fraction": r"^(?=[^_]*_[^_]*_)(?:[^_]*_)*?(2\d{3})(\d\d)(\d\d)_(\d\d)(\d\d)(\d\d)\.([^_]{3,})",
    "dots": r"^(\d{4})(\d\d)(\d\d)\.(\d\d)(\d\d)(\d\d)\.(\d{1,3})[^.]*\.",
    "counted": r"^[^.]*\.[^.]*\.(\d{4})(\d\d)(\d\d)\.(\d\d)(\d\d)(\d\d)\.(\d{1,3})[^.]*\.[^.]*\.",
    "camera": r"^[^.]{6}\.(\d{4})(\d\d)(\d\d)\.(\d\d)(\d\d)(\d\d)(\d{3})[^.]*\.",
}


def ts_from_filename(name: Column | str, discover: bool = True) -> Column:
    """The time that a file's name tells (its path may stand before it), in UTC; null if there is none.

    discover: where none of the known spellings fits, a number of eight digits is the day, one of six the time of day, and the
    digits after both the fraction; without a number of eight digits the last nine digits are microseconds.
    """
    path = F.col(name) if isinstance(name, str) else name
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    whole = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))

    def at(y, mo, d, h, mi, s, micros):
        t = F.try_make_timestamp(whole(y), whole(mo), whole(d), whole(h), whole(mi), whole(s).cast("decimal(8,6)"), F.lit("UTC"))
        return F.timestamp_micros(F.unix_micros(t) + micros)

    found = []
    for kind, pattern in NAME_TIMES.items():
        g = [F.regexp_extract(base, pattern, i) for i in range(1, 8)]
        micros = whole(g[6]) * 1000
        if kind == "flight":
            g[0] = F.concat(F.lit("20"), g[0])
        elif kind == "fraction":  # of a longer part six characters are microseconds, as far as they are digits
            micros = F.when(F.length(g[6]) < 5, whole(F.substring(g[6], 1, 3)) * 1000).otherwise(whole(F.regexp_extract(F.substring(g[6], 1, 6), r"^\d*", 0)))
        found.append(F.when(base.rlike(pattern), at(*g[:6], micros)))
    if discover:
        digits = F.regexp_extract_all(path, F.lit(r"(\d+)"), F.lit(1))
        size = F.transform(digits, lambda x: F.length(x))
        day, clock = F.array_position(size, F.lit(8)).cast("int") - 1, F.array_position(size, F.lit(6)).cast("int") - 1
        rest = F.array_join(F.filter(digits, lambda _, i: (i != day) & (i != clock)), "")
        after = F.when((day >= 0) & (clock >= 0), F.array_join(F.filter(digits, lambda _, i: i > F.greatest(day, clock)), "")).otherwise("")
        d, c = F.get(digits, day), F.get(digits, clock)
        year = whole(F.substring(d, 1, 4)) + F.when(F.substring(d, 1, 1) == "2", 0).otherwise(1900)
        part = lambda x, i, n=2: F.substring(x, i, n)
        micros = F.when(F.length(after) >= 3, whole(part(after, 1, 3)) * 1000).otherwise(whole(rest))
        midnight = F.lit("0")
        known = F.when(clock >= 0, at(year, part(d, 5), part(d, 7), part(c, 1), part(c, 3), part(c, 5), micros)).otherwise(at(year, part(d, 5), part(d, 7), midnight, midnight, midnight, whole(rest)))
        every = F.array_join(digits, "")
        found.append(F.when(day >= 0, known).when(F.length(every) > 0, F.timestamp_micros(F.substring(every, -9, 9).try_cast("long"))))
    return F.when(F.length(path) > 10, F.coalesce(*found))


def head_tail_box(head: tuple[Column, Column], tail: tuple[Column, Column], scale: float = 1.0) -> list[Column]:
    """The box around two points, scaled about its centre."""
    (hx, hy), (tx, ty) = head, tail
    cx, cy = (hx + tx) / 2, (hy + ty) / 2
    w, h = F.abs(hx - tx) * scale / 2, F.abs(hy - ty) * scale / 2
    return [(cx - w).alias("x1"), (cy - h).alias("y1"), (cx + w).alias("x2"), (cy + h).alias("y2")]


def warp_boxes(df: DataFrame, homographies: DataFrame) -> DataFrame:
    """Boxes under their frame's homography h (nine values by row): the hull of the warped corners."""
    j = df.join(homographies, FRAME)
    h = [F.col("h")[i] for i in range(9)]

    def warp(x, y):
        w = h[6] * x + h[7] * y + h[8]
        return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w

    c = [warp(F.col(x), F.col(y)) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs, ys = [p[0] for p in c], [p[1] for p in c]
    return j.select(*(k for k in df.columns if k not in box.names()), F.least(*xs).alias("x1"), F.least(*ys).alias("y1"), F.greatest(*xs).alias("x2"), F.greatest(*ys).alias("y2"))


def tiles(images: DataFrame, size: int, step: int) -> DataFrame:
    """Chips of each image (img_w, img_h): a grid by step, the last ones moved in from the border."""
    along = lambda n: F.expr(f"array_distinct(transform(sequence(0, greatest(0, CAST(ceil(({n} - {size}) / {step}.0D) AS INT))), i -> least(i * {step}, greatest(0, CAST({n} AS INT) - {size}))))")
    t = images.withColumn("tx", F.explode(along("img_w"))).withColumn("ty", F.explode(along("img_h")))
    return t.withColumn("tx2", F.least(F.col("tx") + size, F.col("img_w"))).withColumn("ty2", F.least(F.col("ty") + size, F.col("img_h")))


def tile_to_image(boxes: DataFrame, scale: str = "scale", tx: str = "tx", ty: str = "ty") -> DataFrame:
    """Boxes found in a scaled chip, in coordinates of the image."""
    return boxes.withColumns({k: F.col(k) / F.col(scale) + F.col(tx if k[0] == "x" else ty) for k in box.names()})


def preferred_tile(boxes: DataFrame, chips: DataFrame, key: str = "det_id") -> DataFrame:
    """For each box the smallest chip that contains it (of equal ones the one with the widest margin), else the one with most overlap."""
    j = boxes.join(chips)
    inside = (F.col("x1") >= F.col("tx")) & (F.col("y1") >= F.col("ty")) & (F.col("x2") <= F.col("tx2")) & (F.col("y2") <= F.col("ty2"))
    margin = F.least(F.col("x1") - F.col("tx"), F.col("y1") - F.col("ty"), F.col("tx2") - F.col("x2"), F.col("ty2") - F.col("y2"))
    common = F.greatest(F.lit(0.0), F.least("x2", "tx2") - F.greatest("x1", "tx")) * F.greatest(F.lit(0.0), F.least("y2", "ty2") - F.greatest("y1", "ty"))
    size = (F.col("tx2") - F.col("tx")) * (F.col("ty2") - F.col("ty"))
    j = j.withColumn("inside", inside).withColumn("overlap", common).where("overlap > 0")
    order = [F.desc("inside"), F.when(F.col("inside"), size), F.desc(F.when(F.col("inside"), margin)), F.desc("overlap"), F.col("tx"), F.col("ty")]
    w = Window.partitionBy(key).orderBy(*order)
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Names of survey images: day, site, camera and frame. Fixed format.
IMAGE_NAME = r"^(\d{8})_S(\d+)_SL([A-Z]+)(\d+)$"


def parse_name(name: Column | str, pattern: str = IMAGE_NAME) -> dict[str, Column]:
    """day, site, camera and frame of an image's name without extension; null where it has another form."""
    c = F.col(name) if isinstance(name, str) else name
    part = lambda i: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, i))
    return {"day": part(1), "site": part(2).try_cast("long"), "camera": part(3), "frame": part(4).try_cast("long")}
