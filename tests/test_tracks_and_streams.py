"""Fusion, tracks and streams on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from boxkit.operators import fusion, search, tracks
from boxkit.streaming import streams

BOXES = "seq_id long, frame_id long, det_id long, track_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls string, model string"


def box(k, x, conf, cls="A", model="m0", f=0, w=10.0, y=0.0, tr=None):
    return (0, f, k, k if tr is None else tr, float(x), y, x + w, y + 10.0, conf, cls, model)


def test_nms_uses_the_smaller_area(spark):
    d = spark.createDataFrame([box(1, 0, 0.9, w=40.0), box(2, 5, 0.8), box(3, 100, 0.7)], BOXES)
    assert {r.det_id for r in fusion.nms(d, 0.5).collect()} == {1, 3}
    assert {r.det_id for r in fusion.nms(d, 0.5, ratio=2.0).collect()} == {1, 2, 3}


def test_weighted_fusion(spark):
    d = spark.createDataFrame([box(1, 0, 0.8, model="a"), box(2, 2, 0.4, model="b"), box(3, 100, 0.6, model="b")], BOXES)
    r = {x.det_id: x for x in fusion.fuse_wbf(d, 0.5, 2).collect()}
    assert r[1].x1 == pytest.approx((0 * 0.8 + 2 * 0.4) / 1.2) and r[1].conf == pytest.approx(0.6)
    assert r[3].conf == pytest.approx(0.3)


def test_soft_nms_lowers_scores(spark):
    d = spark.createDataFrame([box(1, 0, 0.9), box(2, 1, 0.8), box(3, 100, 0.5)], BOXES)
    r = {x.det_id: x.conf for x in fusion.fuse_soft_nms(d, 0.5, 0.0).collect()}
    assert r[1] == 0.9 and r[3] == pytest.approx(0.5) and 0 < r[2] < 0.8


def test_agreeing_distributions_sharpen(spark):
    d = spark.createDataFrame([box(1, 0, 0.7), box(2, 1, 0.7, model="b")], BOXES)
    r = fusion.fuse_proben(d, 0.5, ["A", "B"]).first()
    assert r.cls == "A" and r.conf > 0.7 and sum(r.scores.values()) == pytest.approx(1)


def test_interpolation_fills_gaps(spark):
    d = spark.createDataFrame([box(1, 0, 0.9, f=0, tr=5), box(2, 8, 0.5, f=4, tr=5)], BOXES)
    r = sorted((x.frame_id, x.x1, x.conf) for x in tracks.interpolate(d).collect())
    assert r == [(0, 0.0, 0.9), (1, 2.0, 0.9), (2, 4.0, 0.9), (3, 6.0, 0.9), (4, 8.0, 0.5)]


def test_tracker_keeps_two_objects_apart(spark):
    rows = [box(f * 2 + k, 5 * f + 300 * k, 0.9, f=f) for f in range(8) for k in range(2)]
    out = tracks.link_two_stage(spark.createDataFrame(rows, BOXES)).collect()
    ids = {k: {r.linked_track for r in out if r.det_id % 2 == k} for k in range(2)}
    assert all(len(v) == 1 and 0 not in v for v in ids.values()) and ids[0] != ids[1]


def test_link_greedy_starts_anew_after_a_gap(spark):
    d = spark.createDataFrame([box(1, 0, 1.0, f=0), box(2, 1, 1.0, f=1), box(3, 2, 1.0, f=3)], BOXES)
    r = {x.det_id: x.linked_track for x in tracks.link_greedy(d).collect()}
    assert r[1] == r[2] == 1 and r[3] == 3


def test_stereo(spark):
    p = spark.createDataFrame([(0, f, 1, r) for f, r in ((0, 7), (1, 7), (2, 7), (3, 8), (4, 8), (5, 7))], "seq_id long, frame_id long, left_id long, right_id long")
    assert {(r.left_id, r.right_id) for r in tracks.stereo_most_likely(p).collect()} == {(1, 7), (1, 8)}
    assert [r.part for r in tracks.stereo_split(p, 2).orderBy("frame_id").collect()] == [0, 0, 0, 1, 1, 1]


def test_isotonic_maps_rise(spark):
    d = spark.createDataFrame([("m", "A", i / 100, float((i * 7) % 100 < i)) for i in range(100)], "model string, cls string, conf double, hit double")
    pts = fusion.calibrate_fit(d).where("cls = 'A'").orderBy("x", "y").collect()
    assert 2 <= len(pts) <= 33 and all(a.y <= b.y for a, b in zip(pts, pts[1:]))


def test_search_finds_itself(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("uid"), F.col("embedding").alias("vec"))
    q = v.limit(5).selectExpr("uid AS query_id", "vec AS qvec")
    assert all(r.uid == r.query_id for r in search.knn(v, q, 1).collect())
    model = search.itq_fit(v, 16, 3)
    codes = search.itq_hash(v, model)
    hits = search.knn_lsh(v, codes, q, codes.join(q, codes["uid"] == q["query_id"]).selectExpr("query_id", "code AS qcode"), 1)
    assert all(r.uid == r.query_id for r in hits.collect())


def disordered(spark, table, path, parts=4):
    """Files of rows whose neighbours in time lie in different ones: row k in file k * 7 mod parts of its block of 8 rows."""
    d = table.withColumn("k", F.row_number().over(Window.orderBy("ts", *[c for c in table.columns if c != "ts"])) - 1).withColumn("file", F.floor(F.col("k") / 16) + F.pmod(F.col("k") * 7, F.lit(2)))
    for n in sorted(r.file for r in d.select("file").distinct().collect()):
        d.where(F.col("file") == n).drop("k", "file").coalesce(1).write.mode("append").parquet(path)


CARRIED = "stream_id long, frame_id long, change_score double"


@pytest.mark.parametrize("what", ["shots", "fixed", "carry", "history", "accumulate", "link", "align"])
def test_stream_equals_batch(spark, tmp_path, what):
    """Frames dealt over batches out of order give the rows of the whole table, up to the watermark."""
    at = F.expr("timestamp_seconds(1700000000 + frame_id)")
    f = spark.createDataFrame([(i % 2, i, float((i * 37) % 100)) for i in range(80)], CARRIED).withColumn("ts", at)
    b = spark.createDataFrame([(s, f // 2, 1000 * s + f, 0.0 + f, 0.0, 10.0 + f, 10.0, 0.9 - 0.5 * (f % 7 == 0)) for f in range(80) for s in (0, 1)], "seq_id long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double").withColumn("ts", at)
    good = f.selectExpr("stream_id", "frame_id", "ts", "change_score AS value", "change_score > 30 AS ok")
    side = lambda d, n: d.where(f"frame_id % 5 {n}")
    late = "30 seconds"
    run = {
        "shots": (f, lambda d: streams.shots(d, 80.0, 3, 9, late)),
        "fixed": (f, lambda d: streams.fixed_windows(d, 7, late)),
        "carry": (good, lambda d: streams.carry(d, late=late)),
        "history": (good, lambda d: streams.carry(d, history=3, late=late)),
        "accumulate": (f.selectExpr("stream_id AS seq_id", "frame_id", "cast(change_score / 10 AS long) AS n", "ts"), lambda d: streams.accumulate(d, late)),
        "link": (b, lambda d: streams.link(d, late)),
        "align": (f, lambda d: streams.align(side(d, "= 0"), side(d, "> 2"), 2, late)),
    }
    table, op = run[what]
    path = str(tmp_path / "in")
    disordered(spark, table, path)
    stream = op(streams.source(spark, path, table.schema))
    q = streams.drain(stream, str(tmp_path / "out"))
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    top = table.agg(F.max("frame_id")).first()[0]
    key = {"fixed": "last", "align": "id + 2"}.get(what, "frame_id")
    if what == "align":
        top = 78
    want = sorted(map(str, op(table).where(f"{key} <= {top} - 30").collect()))
    assert sorted(map(str, got.collect())) == want and want
    assert not streams.dropped_late(q)


def test_steps_drop_late_rows_and_end_their_state(spark, tmp_path):
    """Rows behind the watermark are counted and change nothing; tracks lost for longer than the buffer leave the state."""
    at = F.expr("timestamp_seconds(1700000000 + frame_id)")
    rows = lambda seqs, frames: spark.createDataFrame([(s, f, 100 * f + k, 20.0 * k, 0.0, 20.0 * k + 10, 10.0, 0.9) for s in seqs for f in frames for k in range(5)], "seq_id long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double").withColumn("ts", at)
    path = str(tmp_path / "in")
    parts = [rows([0, 1], range(0, 20)), rows([1], range(20, 40)), rows([1], range(100, 120)), rows([1], range(120, 140)), rows([0], range(5, 6)), rows([1], range(140, 160))]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
    stream = streams.link(streams.source(spark, path, parts[0].schema), "5 seconds", buffer=10)
    q = streams.drain(stream, str(tmp_path / "out"))
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert streams.dropped_late(q) == 5
    assert got.where("seq_id = 0").count() == 100 and got.where("seq_id = 1 AND frame_id <= 154").count() == got.where("seq_id = 1").count() == 5 * (40 + 55)
    assert {r.linked_track for r in got.where("seq_id = 1 AND frame_id >= 100").collect()} == {6, 7, 8, 9, 10}  # new tracks, numbered on
    totals = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert totals[-1] < max(totals)  # of the sequence that ended nothing but its counters is left


def plain_filter(z, frames):
    """The eight-dimensional filter, written out."""
    def noise(h, a):
        return np.diag(np.square([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160])) if a else np.diag(np.square([h / 20, h / 20, 1e-1, h / 20]))

    s = z[0][3]
    x, p = np.r_[z[0], np.zeros(4)], np.diag(np.square([2 * s / 20, 2 * s / 20, 1e-2, 2 * s / 20, 10 * s / 160, 10 * s / 160, 1e-5, 10 * s / 160]))
    f, h = np.eye(8) + np.eye(8, k=4), np.eye(4, 8)
    for n in range(1, frames):
        q = noise(x[3], True)
        x, p = f @ x, f @ p @ f.T + q
        if n < len(z):
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + noise(x[3], False))
            x, p = x + k @ (z[n] - h @ x), p - k @ h @ p
    return x


def test_tracker_is_the_filter_written_out():
    boxes = np.array([[10.0 + 3 * t, 20 + t, 30 + 3 * t + t % 2, 60 + 2 * t] for t in range(8)])
    tr = tracks.Tracker()
    for t in range(12):
        b = boxes[t : t + 1] if t < 8 else np.empty((0, 4))
        tr.step(t, b, np.full(len(b), 0.9))
        if t == 5:  # through plain values and back
            counters, rows = tr.rows()
            tr = tr.copy()
            tr.restore(counters, rows)
    z = np.c_[(boxes[:, :2] + boxes[:, 2:]) / 2, (boxes[:, 2] - boxes[:, 0]) / (boxes[:, 3] - boxes[:, 1]), boxes[:, 3] - boxes[:, 1]]
    assert np.allclose(tr.mean[0].ravel(), plain_filter(z, 12)) and tr.ids.tolist() == [1]


def test_files_arrive_in_order(spark, tmp_path):
    """A stream takes files by the time of their writing, so each range is written after the one before it."""
    d = spark.range(40_000).selectExpr("id", "cast((id * 7919) % 40000 AS double) AS arrival", "map('k', id) AS m").repartition(8)
    streams.staged(d, "arrival", str(tmp_path / "in"), 4, 1000)
    files = spark.read.parquet(str(tmp_path / "in")).groupBy("_metadata.file_modification_time", "_metadata.file_path").agg(F.min("arrival").alias("lo"), F.max("arrival").alias("hi"), F.count("*").alias("n")).orderBy("file_modification_time").collect()
    assert sum(r.n for r in files) == 40_000 and len(files) >= 40 and max(r.n for r in files) < 1100
    assert len({r.file_modification_time for r in files}) == len(files)
    assert all(a.hi <= b.lo for a, b in zip(files, files[1:]))


def test_rows_wait_packed(spark):
    """Rows go through a pack as they are, whatever columns hold nulls."""
    from boxkit.streaming.ordered import _packed, _unpacked

    a, b = pd.DataFrame({"at_ms": [1, 2], "v": [None, 0.5], "t": [None, None], "x": [np.array([1.0, 2.0]), None]}), pd.DataFrame({"at_ms": [3], "v": [1.5], "t": ["a"], "x": [np.array([3.0])]})
    got = _unpacked([_packed(a), _packed(b)])
    assert got.at_ms.tolist() == [1, 2, 3] and got.at_ms.dtype == "int64" and np.isnan(got.v[0]) and got.v.tolist()[1:] == [0.5, 1.5]
    assert got.t[0] is None and got.t[2] == "a" and got.x[0].tolist() == [1.0, 2.0] and got.x[1] is None


@pytest.mark.parametrize("how", [{}, {"direction": 0.2, "appearance": 0.3}, {"gate": 0.0, "buffer": 2}, {"new": 0.3, "high": 0.5}])
def test_tracker_on_plain_numbers_is_the_one_on_arrays(how):
    r = np.random.default_rng(3)
    frames = np.sort(r.integers(0, 300, 1500))
    frames[frames > 200] += 7
    frames = np.append(frames, np.full(70, 310))  # a frame that arrays handle
    at = r.integers(0, 60, (len(frames), 2)).astype(float)
    boxes, conf = np.c_[at, at + r.integers(5, 40, at.shape)], r.integers(0, 10, len(frames)) / 10
    vecs = r.normal(size=(len(frames), 8)) if how.get("appearance") else None
    if vecs is not None:
        vecs /= np.linalg.norm(vecs, axis=1)[:, None]
    part = lambda lo, hi: (boxes[lo:hi], conf[lo:hi], None if vecs is None else vecs[lo:hi])
    ends = np.append(np.flatnonzero(np.diff(frames)) + 1, len(frames)).tolist()
    a, b = tracks.Tracker(**how), tracks.Tracker(**how)
    want = np.concatenate([a.step(int(frames[lo]), *part(lo, hi)) for lo, hi in zip([0, *ends[:-1]], ends)])
    got = np.concatenate([b.run(frames[lo:hi], *part(lo, hi)) for lo, hi in ((0, ends[90]), (ends[90], len(frames)))])
    assert got.tolist() == want.tolist() and np.allclose(a.mean, b.mean) and np.allclose(a.variance, b.variance)


def test_a_sequence_is_not_one_group_of_python(spark):
    """The tracker goes on from batch to batch, through a frame that two batches share."""
    rows = [box(f * 3 + k, 5 * f + 300 * k, 0.9, f=f) for f in range(40) for k in range(3)]
    d = spark.createDataFrame(rows, BOXES)
    want = sorted(map(tuple, tracks.link_two_stage(d).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        linked = tracks.link_two_stage(d)
        got = sorted(map(tuple, linked.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and {r[3] for r in got} == {1, 2, 3}


def test_links_are_followed_over_blocks_of_frames(spark, monkeypatch):
    """A chain of 23 frames in blocks of one to eight, one that ends on a block's last frame, and one that starts there; only open ends are searched."""
    rows = [(0, f, 100 - f, 0.0, 0.0, 10.0, 10.0) for f in range(23)] + [(0, f, 200 + f, 50.0, 0.0, 60.0, 10.0) for f in range(2, 8)] + [(0, f, 300 + f, 90.0, 0.0, 99.0, 10.0) for f in (7, 8, 9)] + [(1, 0, 400, 0.0, 0.0, 10.0, 10.0)]
    d = spark.createDataFrame(rows, "seq_id long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double")
    want = {r[2]: 78 if r[2] <= 100 else 202 if r[2] < 300 else 307 if r[2] < 400 else 400 for r in rows}
    sizes, real = [], tracks.components
    monkeypatch.setattr(tracks, "components", lambda e: sizes.append(e.count()) or real(e))
    for block in (1, 4, 8, 1024):
        got = tracks.link_greedy(d, block=block).select("det_id", "linked_track").collect()
        assert len(got) == len(rows) and {r.det_id: r.linked_track for r in got} == want
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == 0


def test_cameras_chain_within_a_frame_without_a_search(spark, monkeypatch):
    from boxkit.operators import matching

    monkeypatch.setattr(matching, "components", lambda e: 1 / 0)
    box = lambda frame, id_, x: (0, frame, id_, float(x), 0.0, x + 10.0, 10.0)
    made = lambda *rows: spark.createDataFrame(rows, "seq_id long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double")
    cams = [made(box(0, 9, 0), box(0, 8, 50), box(1, 7, 0)), made(box(0, 3, 1), box(0, 4, 100), box(1, 5, 0)), made(box(0, 6, 2), box(0, 2, 101), box(1, 1, 90)), made(box(0, 12, 2), box(0, 11, 101), box(1, 10, 90))]
    got = {(r.object_id, r.det_id, r.camera) for r in matching.chain_cameras(cams).collect()}
    a, b, c, d = 3 * 5 + 1, 2 * 5 + 2, 5 * 5 + 1, 1 * 5 + 2
    assert got == {(a, 9, 0), (a, 3, 1), (a, 6, 2), (a, 12, 3), (b, 4, 1), (b, 2, 2), (b, 11, 3), (c, 7, 0), (c, 5, 1), (d, 1, 2), (d, 10, 3)}
