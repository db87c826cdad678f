"""Queries in motion: a table is written as ordered files, streamed a few per batch, and the result is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..shared import shared_path
from ..streaming import streams as op
from .views import view, with_views

LATE, LATE_FRAMES = "10 minutes", "1 minute"
#: Of frames and vectors that have an order but no time: a second each.
_SECONDS = "timestamp_seconds(1700000000 + frame_id)"


def _dir(spark, name):
    return shared_path(spark, name)


def _stream(spark, df, order, name, parts=4, per=2):
    path = _dir(spark, name)
    op.staged(df, order, path, parts)
    return op.source(spark, path, df.schema, per)


def _disordered(spark, df, name, seconds, parts=4):
    """A stream of rows that arrive up to so many seconds after their time, some after rows that follow them, a part per batch."""
    df = df.withColumn("arrival", F.unix_micros("ts") / 1e6 + F.pmod(F.xxhash64(*df.columns), F.lit(1000)) * (seconds / 1000))
    return _stream(spark, df, "arrival", name, parts, 1).drop("arrival")


def _frames(spark, sf):
    return view(spark, sf, "frames").withColumn("ts", F.col("ts").cast("timestamp"))


def _done(spark, stream, name):
    path = _dir(spark, name)
    op.drain(stream, path)
    return spark.read.schema(stream.schema).parquet(path)


_TOP = "(SELECT max(ts) - INTERVAL 10 MINUTES AS mark FROM frames)"


@query("stream_downsample", with_views(f"SELECT stream_id, time_bucket(INTERVAL 30 SECONDS, ts) AS start, arg_min(frame_id, (ts, frame_id)) AS frame_id FROM frames, {_TOP} GROUP BY stream_id, start, mark HAVING start + INTERVAL 30 SECONDS <= mark"))
def stream_downsample(spark, sf):
    out = _done(spark, op.downsample(_stream(spark, _frames(spark, sf), "ts", "frames"), 30, LATE), "downsampled")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_counts", with_views(f"WITH w AS (SELECT stream_id, change_score, mark, time_bucket(INTERVAL 5 MINUTES, ts) - INTERVAL 5 MINUTES * k AS start FROM frames, range(2) r(k), {_TOP} t) SELECT stream_id, start, count(*) AS n, max(change_score) AS top FROM w GROUP BY stream_id, start, mark HAVING start + INTERVAL 10 MINUTES <= mark"))
def stream_counts(spark, sf):
    out = _done(spark, op.counts(_stream(spark, _frames(spark, sf), "ts", "frames"), "10 minutes", "5 minutes", LATE), "counts")
    return out.select("stream_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "top")


@query("stream_sessions", with_views(f"WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 5 MINUTES THEN 1 ELSE 0 END AS new FROM frames WINDOW w AS (PARTITION BY stream_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY ts) AS sid FROM g) SELECT stream_id, min(ts) AS start, count(*) AS n, min(frame_id) AS first FROM s, {_TOP} GROUP BY stream_id, sid, mark HAVING max(ts) + INTERVAL 5 MINUTES <= mark"))
def stream_sessions(spark, sf):
    out = _done(spark, op.sessions(_stream(spark, _frames(spark, sf), "ts", "frames"), "5 minutes", LATE), "sessions")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def before_mark(sql: str, table: str = "frames", us: str = "epoch_us(ts)", late: int = 600_000_000, unit: int = 1000) -> str:
    """sql over the rows of a table, called due there, whose time the watermark has passed at the end of the stream."""
    due = f"due AS (SELECT * FROM {table} WHERE {us} <= (SELECT max({us}) // {unit} * {unit} FROM {table}) - {late})"
    for word in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(word):
            return f"{word}{due}, {sql[len(word):]}"
    return f"WITH {due} {sql}"


@query("stream_align", with_views("""WITH f AS (SELECT stream_id, frame_id, epoch_us(ts) AS us, modality FROM frames WHERE modality IN ('click', 'view')), a AS (SELECT * FROM f WHERE modality = 'click' AND us + 300000000 <= (SELECT max(us // 1000) * 1000 FROM f) - 600000000),
n AS (SELECT a.stream_id, a.frame_id, b.frame_id AS r_id, abs(a.us - b.us) AS off, row_number() OVER (PARTITION BY a.stream_id, a.frame_id ORDER BY abs(a.us - b.us), b.us, b.frame_id) AS rn FROM a JOIN f b ON a.stream_id = b.stream_id AND b.modality = 'view' AND b.us BETWEEN a.us - 300000000 AND a.us + 300000000)
SELECT a.stream_id, a.frame_id AS id, r_id, off FROM a LEFT JOIN (SELECT * FROM n WHERE rn = 1) n ON a.stream_id = n.stream_id AND a.frame_id = n.frame_id"""))
def stream_align(spark, sf):
    f = _frames(spark, sf).where("modality IN ('click', 'view')")
    a = _disordered(spark, f.where("modality = 'click'"), "left", 300)
    b = _disordered(spark, f.where("modality = 'view'"), "right", 300)
    return _done(spark, op.align(a, b, 300, LATE), "aligned")


@query("stream_fixed_windows", with_views(before_mark("WITH r AS (SELECT stream_id, frame_id, row_number() OVER (PARTITION BY stream_id ORDER BY frame_id) - 1 AS i FROM due) SELECT stream_id, min(frame_id) AS first, max(frame_id) AS last FROM r GROUP BY stream_id, i // 8 HAVING count(*) = 8")))
def stream_fixed_windows(spark, sf):
    return _done(spark, op.fixed_windows(_disordered(spark, _frames(spark, sf), "frames", 500), 8, LATE), "windows")


@query("stream_shots")
def stream_shots(spark, sf):
    return _done(spark, op.shots(_disordered(spark, _frames(spark, sf), "frames", 500), 90.0, 5, 60, LATE), "shots")


@query("stream_accumulate", with_views(before_mark("SELECT seq_id, frame_id, n FROM (SELECT *, max(n) OVER (PARTITION BY seq_id ORDER BY frame_id) AS top FROM (SELECT seq_id, frame_id, count(*) AS n FROM due GROUP BY ALL)) WHERE n = top", "computed", "frame_id", 60, 1)))
def stream_accumulate(spark, sf):
    c = view(spark, sf, "computed").groupBy("seq_id", "frame_id").agg(F.count("*").alias("n")).withColumn("ts", F.expr(_SECONDS))
    return _done(spark, op.accumulate(_disordered(spark, c, "counted", 50), LATE_FRAMES), "accumulated")


@query("stream_rolling_desc")
def stream_rolling_desc(spark, sf):
    """The mean vectors, told by their ends, sums and squares."""
    d = view(spark, sf, "descriptors").select(F.col("label").cast("long").alias("track"), F.col("uid").cast("long").alias("frame_id"), "vec").withColumn("ts", F.expr(_SECONDS))
    out = _done(spark, op.rolling(_disordered(spark, d, "vectors", 50), 5, LATE_FRAMES), "rolled")
    told = {"first": F.col("vec")[0], "last": F.col("vec")[63], "total": F.expr("aggregate(vec, 0D, (s, x) -> s + x)"), "square": F.expr("aggregate(vec, 0D, (s, x) -> s + x * x)")}
    return out.select("track", "frame_id", *(F.round(e, 6).alias(k) for k, e in told.items()))


@query("stream_link")
def stream_link(spark, sf):
    c = view(spark, sf, "computed").select("seq_id", "frame_id", "det_id", "x1", "y1", "x2", "y2", "conf").withColumn("ts", F.expr(_SECONDS))
    return _done(spark, op.link(_disordered(spark, c, "boxes", 50), LATE_FRAMES), "linked")


def _measured(spark, sf):
    return _frames(spark, sf).select("stream_id", "frame_id", "ts", F.col("change_score").alias("value"), (F.col("change_score") > 20).alias("ok"))


@query("stream_gsd")
def stream_gsd(spark, sf):
    return _done(spark, op.carry(_disordered(spark, _measured(spark, sf), "measured", 500), late=LATE), "carried")


@query("stream_gsd_history", with_views(before_mark("WITH f AS (SELECT stream_id, frame_id, change_score AS value, change_score > 20 AS ok FROM due), g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY stream_id ORDER BY frame_id) AS k FROM f), o AS (SELECT stream_id, k, avg(value) OVER (PARTITION BY stream_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v FROM g WHERE ok) SELECT g.stream_id, frame_id, round(o.v, 9) AS value FROM g LEFT JOIN o ON o.stream_id = g.stream_id AND o.k = g.k")))
def stream_gsd_history(spark, sf):
    return _done(spark, op.carry(_disordered(spark, _measured(spark, sf), "measured", 500), history=4, late=LATE), "carried").withColumn("value", F.round("value", 9))


@query("stream_merge_tracks", with_views("SELECT det_id, track_id, 0 AS tracker FROM computed WHERE conf >= 0.6 UNION ALL SELECT det_id, track_id + 1000000, 1 FROM truth"))
def stream_merge_tracks(spark, sf):
    keep = ["frame_id", "det_id", "track_id"]
    a = _stream(spark, view(spark, sf, "computed").where("conf >= 0.6").select(*keep), "frame_id", "short")
    b = _stream(spark, view(spark, sf, "truth").select(*keep), "frame_id", "long")
    return _done(spark, op.merge_trackers(a, b, offset=1_000_000), "merged").select("det_id", "track_id", "tracker")


@query("stream_ingest_desc", with_views("SELECT uid, label FROM descriptors"))
def stream_ingest_desc(spark, sf):
    d = view(spark, sf, "descriptors").select("uid", "label")
    path = _dir(spark, "ingested")
    op.ingest(_stream(spark, d, "uid", "arriving"), path)
    return spark.read.parquet(path).select("uid", "label")


@query("stream_late", with_views("WITH c AS (SELECT quantile_cont(epoch_us(ts), 1 / 3) AS c FROM frames) SELECT (SELECT count(*) FROM frames) AS rows, (SELECT count(DISTINCT (stream_id, time_bucket(INTERVAL 30 SECONDS, ts))) FROM frames, c WHERE epoch_us(ts) < c) AS dropped"))
def stream_late(spark, sf):
    """How many groups of an interval and stream come too late when the frames arrive by thirds, the newest first.

    Spark drops what lies behind the watermark of the batch before, so only the third batch has rows to drop.
    """
    f = _frames(spark, sf)
    path, us = _dir(spark, "late"), F.unix_micros("ts")
    low, high = f.selectExpr("percentile(unix_micros(ts), array(1 / 3D, 2 / 3D)) AS c").first().c
    for part in (us >= high, (us >= low) & (us < high), us < low):
        f.where(part).coalesce(1).write.mode("append").parquet(path)
    q = op.drain(op.downsample(op.source(spark, path, f.schema, 1), 30, "1 second"), _dir(spark, "late-out"))
    return spark.createDataFrame([(f.count(), op.dropped_late(q))], "rows long, dropped long")
