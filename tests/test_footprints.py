"""What other images see, against numpy matrices and loops over all frames."""

import numpy as np
import pytest

from boxkit.operators import footprints as fp

FRAMES = "seq_id long, frame_id long, camera int, reference long, h array<double>, width double, height double, name string"
BOXES = "seq_id long, frame_id long, camera int, det_id long, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(6)
    frames, boxes = [], []
    for s in range(2):
        for f in range(14):
            for c in range(3):
                if (f, c) == (4, 1):
                    continue  # a camera that misses a frame
                a = rng.normal(0, 0.1)
                h = np.array([[np.cos(a), -np.sin(a), 60 * f + 50 * c], [np.sin(a), np.cos(a), 10 * f - 20 * c], [rng.normal(0, 1e-4), rng.normal(0, 1e-4), 1.0]]) * rng.choice([1.0, 2.0])
                frames.append((s, f, c, f // 7, h, 200.0, 150.0, None if c == 2 and f == 3 else f"i{s}_{f}_{c}"))
                for _ in range(5):
                    x, y, w, t = rng.uniform(0, 160), rng.uniform(0, 110), rng.uniform(5, 39), rng.uniform(5, 39)
                    boxes.append((s, f, c, len(boxes), x, y, x + w, y + t))
    return frames, boxes


def tables(spark, world):
    f = spark.createDataFrame([(*r[:4], r[4].ravel().tolist(), *r[5:]) for r in world[0]], FRAMES)
    return spark.createDataFrame(world[1], BOXES).repartition(3), f


def into(frame, other, x, y):
    v = np.linalg.inv(other[4]) @ frame[4] @ [x, y, 1.0]
    return v[:2] / v[2]


def sees(other, p):
    return 0 <= p[0] < other[5] and 0 <= p[1] < other[6]


def related(frame, o, past, times):
    if frame[0] != o[0] or frame[3] != o[3]:
        return False
    if frame[1] == o[1]:
        centre = times[frame[0], frame[1]] // 2
        return o[2] in (range(frame[2] + 1, centre + 1) if frame[2] < centre else range(centre, frame[2]))
    return o[1] < frame[1] if past == "all" else o[1] == frame[1] - 1 and abs(o[2] - frame[2]) <= 1


@pytest.mark.parametrize("past", ["all", "neighbours"])
@pytest.mark.parametrize("cell", [None, 7.0, 5000.0])
def test_suppress(spark, world, past, cell):
    frames, boxes = world
    at = {f[:3]: f for f in frames}
    times = {}
    for f in frames:
        times[f[:2]] = max(times.get(f[:2], 0), f[2] + 1)
    want = {b[3] for b in boxes if not any(related(at[b[:3]], o, past, times) and sees(o, into(at[b[:3]], o, (b[4] + b[6]) / 2, (b[5] + b[7]) / 2)) for o in frames)}
    b, f = tables(spark, world)
    assert {r.det_id for r in fp.suppress(b, f, past, cell=cell).collect()} == want
    marked = {r.det_id: r.seen for r in fp.suppress(b, f, past, mark=True, cell=cell).collect()}
    assert marked == {x[3]: x[3] not in want for x in boxes} and 10 < len(want) < len(boxes) - 10


@pytest.mark.parametrize("survey", [False, True])
def test_boundary_cutoff(spark, world, survey):
    frames, boxes = world
    at, want = {f[:3]: f for f in frames}, {}
    for b in boxes:
        me = at[b[:3]]
        corners = [(b[4], b[5]), (b[6], b[5]), (b[6], b[7]), (b[4], b[7])]
        near = [p for p in corners if p[0] <= 8 or p[1] <= 8 or p[0] >= 191 or p[1] >= 141]
        others = [o for o in frames if o[0] == me[0] and o[3] == me[3] and o[:3] != me[:3] and (survey or o[1] < me[1] or o[1] == me[1])]
        best = None
        if any(sees(o, into(me, o, *p)) for o in others for p in near):
            for o in others:
                q = np.array([into(me, o, *p) for p in corners])
                d = min(q.min(), 199 - q[:, 0].max(), 149 - q[:, 1].max())
                if d > 8 and o[7] and (best is None or d > best[0]):
                    best = (d, o[7])
            want[b[3]] = best and best[1]
    b, f = tables(spark, world)
    got = {r.det_id: r.best_view for r in fp.boundary_cutoff(b, f, 8.0, survey).collect() if r.cut_off}
    assert got == want and any(want.values()) and not all(want.values())


def test_outlines_and_frames_without_an_inverse(spark):
    eye = np.eye(3).ravel().tolist()
    f = spark.createDataFrame([(0, 0, 0, 0, eye, 100.0, 100.0, "a"), (0, 1, 0, 0, [1.0, 0.0, 90.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 100.0, 100.0, "b"), (0, 0, 1, 0, [0.0] * 9, 100.0, 100.0, "c"), (0, 0, 2, 0, None, 100.0, 100.0, "d")], FRAMES)
    b = spark.createDataFrame([(0, 1, 0, 1, 2.0, 40.0, 60.0, 60.0, [(0.5, 50.0), (50.0, 50.0)]), (0, 1, 0, 2, 2.0, 40.0, 60.0, 60.0, []), (0, 1, 0, 3, 40.0, 40.0, 60.0, 60.0, None), (0, 0, 2, 4, 0.0, 0.0, 9.0, 9.0, None)], BOXES + ", outline array<struct<x: double, y: double>>")
    assert {r.det_id: r.cut_off for r in fp.boundary_cutoff(b, f, 1.0).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert fp.suppress(b.limit(0), f).collect() == [] and fp.suppress(b, f.limit(0)).count() == 4


def test_cells_of_many_frames_are_judged_in_pieces(spark, monkeypatch):
    """A frame of 20 x 10 cells, one that is turned and one without an inverse, judged three cells at a time and all at once."""
    rows = [(0, 0, 0, 0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 200.0, 100.0, "a"), (0, 1, 0, 0, [0.6, -0.8, 30.0, 0.8, 0.6, 7.0, 0.0005, 0.0, 1.0], 90.0, 60.0, "b"), (0, 2, 0, 0, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], 9.0, 9.0, "c")]
    f = fp._prepared(spark.createDataFrame(rows, "seq_id long, frame_id long, camera long, reference long, h array<double>, width double, height double, name string"))
    whole = sorted(fp.covered_cells(f, 10.0).select("o_name", "gx", "gy", "full").collect())
    monkeypatch.setattr(fp, "CELLS", 3)
    assert whole == sorted(fp.covered_cells(f, 10.0).select("o_name", "gx", "gy", "full").collect())
    # a cell that begins where the frame ends touches nothing of it; the last cells reach a corner that lies outside by nothing
    a = {(r.gx, r.gy): r.full for r in whole if r.o_name == "a"}
    assert set(a) == {(x, y) for x in range(20) for y in range(10)} and all(v == (x < 19 and y < 9) for (x, y), v in a.items())
    assert 0 < sum(r.full for r in whole if r.o_name == "b") < sum(r.o_name == "b" for r in whole) and not any(r.o_name == "c" for r in whole)


def test_frames_of_one_time_need_no_cells(spark, world, monkeypatch):
    monkeypatch.setattr(fp, "covered_cells", lambda *a: 1 / 0)
    b, f = tables(spark, world)
    assert fp.suppress(b, f, "neighbours").count() >= 0
