"""Operators on moving frames and boxes, with Structured Streaming.

Windows use watermarks and Spark's own state. Where the next row depends on all
rows before it (segments, tracks, carried values, nearest frames), a step runs
over the rows of a key in order of their time (ordered.py): rows wait until the
watermark has passed them, so frames may arrive in any batch that isn't too late.
"""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..shared import shared_path, stored
from .ordered import Ordered, in_order

_STORE = "spark.sql.streaming.stateStore.providerClass"


def source(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, so many per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def staged(df: DataFrame, order: str, path: str, parts: int = 4, rows: int = 1_000_000) -> None:
    """Writes a table as files that arrive in order: one range of the order after the other, each in files of about so many rows at most.

    A stream takes files by the time of their writing, and tasks of one job end in any order; so each file is a job of
    its own, which reads its range only: the table is cut into folders of ranges before.
    """
    schema = StructType([*df.schema.fields, StructField("_range", IntegerType())])
    key = F.col(order).cast("double")
    table = stored(df, "staged")
    files = parts * max(1, -(-table.count() // (parts * rows)))
    cuts = table.select(F.percentile_approx(key, [i / files for i in range(1, files)])).first()[0] if files > 1 else None
    cuts = sorted(set(cuts or []))
    place = F.size(F.filter(F.lit(cuts), lambda c: c < key)) if cuts else F.lit(0)
    ranges = shared_path(df.sparkSession, "ranges")
    table.withColumn("_range", place).write.partitionBy("_range").parquet(ranges)
    ranged = df.sparkSession.read.schema(schema).parquet(ranges)
    for k in range(len(cuts) + 1):
        ranged.where(F.col("_range") == k).drop("_range").coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(path)


@contextmanager
def _state_store(stream: DataFrame):
    """Lists, maps and timers need the store that keeps state on disk."""
    spark = stream.sparkSession
    was = spark.conf.get(_STORE)
    if "TransformWithState" in stream._jdf.queryExecution().analyzed().toString():
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, was)


def drain(stream: DataFrame, path: str, mode: str = "append"):
    """Runs a stream over what is there and writes it as Parquet; gives the finished query."""
    with _state_store(stream):
        q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
        q.awaitTermination()
    return q


def downsample(frames: DataFrame, seconds: int, late: str) -> DataFrame:
    """The first frame of every interval of each stream."""
    w = frames.withWatermark("ts", late).groupBy("stream_id", F.window("ts", f"{seconds} seconds").alias("w"))
    return w.agg(F.min(F.struct("ts", "frame_id")).alias("f")).select("stream_id", F.col("w.start").alias("start"), F.col("f.frame_id").alias("frame_id"))


def counts(frames: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Frames and the highest score per sliding window and stream."""
    g = frames.withWatermark("ts", late).groupBy("stream_id", F.window("ts", width, slide).alias("w"))
    return g.agg(F.count("*").alias("n"), F.max("change_score").alias("top")).select("stream_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "top")


def sessions(frames: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of frames with no pause longer than a gap."""
    g = frames.withWatermark("ts", late).groupBy("stream_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n"), F.min("frame_id").alias("first")).select("stream_id", F.col("w.start").alias("start"), "n", "first")


def align(left: DataFrame, right: DataFrame, seconds: int, late: str) -> DataFrame:
    """Each left frame with the nearest right frame of its stream within an offset, the earlier of equally near ones.

    A left frame waits until the watermark has passed all that could be near it; without a partner it comes out with
    nulls. The state of a stream is the right frames of the last two offsets, and ends with them.
    """
    near, keep = seconds * 1_000_000, 2 * seconds * 1_000_000 + 1000
    side = lambda d, n: d.select("stream_id", "frame_id", "ts", F.unix_micros("ts").alias("us"), F.lit(n).alias("side"), F.lit(n * seconds * 1000).alias("wait"))

    def step(state, rows):
        ids, at = map(list, state)
        out = []
        for stream, frame, us, left in zip(rows.stream_id, rows.frame_id, rows.us, rows.side, strict=True):
            if not left:
                ids.append(int(frame))
                at.append(int(us))
                continue
            first = next((k for k, t in enumerate(at) if t >= us - near), len(at))
            del ids[:first], at[:first]  # no later frame on the left can reach them
            best = min(((abs(t - us), t, i) for t, i in zip(at, ids, strict=True) if abs(t - us) <= near), default=None)
            out.append((stream, frame, None, None) if best is None else (stream, frame, best[2], best[0]))
        fresh = [k for k, t in enumerate(at) if t >= at[-1] - keep]
        return ([ids[k] for k in fresh], [at[k] for k in fresh]), pd.DataFrame(out, columns=["stream_id", "id", "r_id", "off"]).astype({"r_id": "Int64", "off": "Int64"})

    both = side(left, 1).unionByName(side(right, 0))
    return in_order(both, "stream_id", "ts", ["side", "us", "frame_id"], step, ([], []), "ids array<long>, at array<long>", "stream_id long, id long, r_id long, off long", late, 2 * seconds * 1000, "wait")


def shots(frames: DataFrame, above: float, least: int, most: int, late: str = "10 minutes") -> DataFrame:
    """Segments by change of score: a new one past the threshold after ``least`` frames, or after ``most``."""

    def step(state, rows):
        seg, n = state
        out = []
        for s in rows.change_score:
            if n >= most or (s > above and n >= least):
                seg, n = seg + 1, 0
            n += 1
            out.append(seg)
        return (seg, n), pd.DataFrame({"stream_id": rows.stream_id, "frame_id": rows.frame_id, "segment": out})

    return in_order(frames, "stream_id", "ts", ["frame_id"], step, (0, 0), "segment int, n int", "stream_id long, frame_id long, segment int", late)


def fixed_windows(frames: DataFrame, n: int, late: str = "10 minutes") -> DataFrame:
    """Tracks of exactly n frames one after the other; a last, shorter one stays in the state."""

    def step(state, rows):
        held = [*state[0], *rows.frame_id.tolist()]
        full = len(held) // n
        out = [(rows.stream_id.iloc[0], held[i * n], held[i * n + n - 1]) for i in range(full)]
        return (held[full * n :],), pd.DataFrame(out, columns=["stream_id", "first", "last"])

    return in_order(frames, "stream_id", "ts", ["frame_id"], step, ([],), "held array<long>", "stream_id long, first long, last long", late)


def accumulate(counted: DataFrame, late: str = "1 minute") -> DataFrame:
    """Frames whose number of boxes (n) equals the highest so far: the running form of index-by-index tracks."""

    def step(state, rows):
        (top,), out = state, []
        for f, n in zip(rows.frame_id.tolist(), rows.n.tolist(), strict=True):
            top = max(top, n)
            if n == top:
                out.append((rows.seq_id.iloc[0], f, n))
        return (top,), pd.DataFrame(out, columns=["seq_id", "frame_id", "n"])

    return in_order(counted, "seq_id", "ts", ["frame_id"], step, (0,), "top long", "seq_id long, frame_id long, n long", late)


def carry(measured: DataFrame, weight: float = 0.5, history: int = 0, late: str = "10 minutes") -> DataFrame:
    """The last good value (ok) carried forward: averaged exponentially with the ones before it, or the mean of the last ``history`` ones."""

    def step(state, rows):
        last, held = state[0], list(state[1])
        out = []
        for v, ok in zip(rows.value.tolist(), rows.ok.tolist(), strict=True):
            if ok and history:
                held = [*held, v][-history:]
                last = sum(held) / len(held)
            elif ok:
                last = v if last is None else weight * v + (1 - weight) * last
            out.append(last)
        return (last, held), pd.DataFrame({"stream_id": rows.stream_id, "frame_id": rows.frame_id, "value": pd.Series(out, dtype=float).to_numpy()})

    return in_order(measured, "stream_id", "ts", ["frame_id"], step, (None, []), "last double, held array<double>", "stream_id long, frame_id long, value double", late)


def rolling(vectors: DataFrame, n: int, late: str = "1 minute") -> DataFrame:
    """The mean of the last n vectors of each track."""
    import numpy as np

    def step(state, rows):
        held, out = [np.asarray(v, float) for v in state[0]], []
        for v in rows.vec:
            held = [*held, np.asarray(v, float)][-n:]
            out.append(np.mean(held, axis=0).tolist())
        return ([v.tolist() for v in held],), pd.DataFrame({"track": rows.track, "frame_id": rows.frame_id, "vec": out})

    return in_order(vectors, "track", "ts", ["frame_id"], step, ([],), "held array<array<double>>", "track long, frame_id long, vec array<double>", late)


class Linked(Ordered):
    """The state of a tracker: its counters as a value, its tracks as entries of a map by id."""

    def init(self, handle) -> None:
        super().init(handle)
        self.tracks = handle.getMapState("tracks", "id long", "mean array<double>, variance array<double>, seen long, sure boolean, boxes array<double>")

    def load(self):
        tracker = self.start.copy()
        if self.now.exists():
            tracker.restore(tuple(self.now.get()), [(k[0], *v) for k, v in self.tracks.iterator()])
        self.held = {int(k): s for k, s in zip(tracker.ids.tolist(), tracker.seen.tolist(), strict=True)}
        return tracker

    def store(self, was, now) -> None:
        counters, rows = now.rows()
        self.now.update(counters)
        alive = set()
        for id_, *row in rows:
            alive.add(id_)
            self.tracks.updateValue((id_,), tuple(row))
        for gone in set(self.held) - alive:
            self.tracks.removeKey((gone,))

    def ended(self) -> None:
        """The tracks have all been lost for longer than the buffer; the number of the next one stays."""
        self.tracks.clear()
        self.due.clear()


def link(boxes: DataFrame, late: str = "1 minute", frame_ms: int = 1000, **how) -> DataFrame:
    """Two-stage tracking of boxes with the time of their frame (ts), ``frame_ms`` apart.

    A sequence whose newest frame is older than the tracker's buffer has no tracks in the state any more.
    """
    from ..operators.tracks import BOX, Tracker

    def step(tracker, rows):
        ids = tracker.run(rows.frame_id.to_numpy(), rows[BOX].to_numpy(float), rows.conf.to_numpy(float))
        return tracker, rows[["seq_id", "frame_id", "det_id"]].assign(linked_track=ids)

    start = Tracker(**how)
    keep = (start.buffer + 1) * frame_ms
    return in_order(boxes, "seq_id", "ts", ["frame_id", "det_id"], step, start, "next long, frame long", "seq_id long, frame_id long, det_id long, linked_track long", late, keep, using=Linked)


def merge_trackers(*tracks: DataFrame, offset: int = 10_000) -> DataFrame:
    """Boxes of several trackers as one stream; the ids of the k-th are shifted by k x offset."""
    out = None
    for k, t in enumerate(tracks):
        one = t.withColumn("track_id", F.col("track_id") + k * offset).withColumn("tracker", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def ingest(stream: DataFrame, path: str, every: str | None = None) -> None:
    """Appends batches to a table; a batch that is run again replaces what it had written.

    every: the interval at which what has arrived is committed ("10 seconds"), until the stream is stopped; without it
    all that is there is committed and the call returns. How much a batch holds is set at the source (files per batch).
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
    if every:
        q.processAllAvailable()
        q.stop()
    else:
        q.awaitTermination()


def dropped_late(query) -> int:
    """Rows that a finished query dropped because they came after the watermark."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])
