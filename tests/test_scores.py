"""Matching and scores against a plain evaluator and hand-computed cases."""

import itertools

import numpy as np
import pytest

from boxkit.operators import matching as m
from boxkit.operators import scoring as s

SCHEMA = "seq_id long, frame_id long, det_id long, track_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls string"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(0, w) * max(0, h)
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    u = area(a) + area(b) - i
    return i / u if u > 0 else 0.0


def boxes(n_frames=12, seed=0, jitter=6, extra=2):
    rng = np.random.default_rng(seed)
    truth, comp, k = [], [], 0
    for f in range(n_frames):
        for t in range(5):
            x, y = 30 * t + float(rng.uniform(0, 5)), float(rng.uniform(0, 20))
            truth.append((f % 2, f, k, t, x, y, x + 40, y + 40, 1.0, "AB"[t % 2]))
            if rng.random() < 0.85:
                d = rng.uniform(-jitter, jitter, 2).tolist()
                comp.append((f % 2, f, 1000 + k, t if rng.random() < 0.9 else t + 10, x + d[0], y + d[1], x + 40 + d[0], y + 40 + d[1], round(float(rng.uniform(0.2, 1)), 2), "AB"[t % 2]))
            k += 1
        for _ in range(extra):
            x = float(rng.uniform(0, 200))
            comp.append((f % 2, f, 5000 + k + len(comp), 99, x, 0.0, x + 40, 40.0, round(float(rng.uniform(0.2, 1)), 2), "A"))
    return truth, comp


def by_frame(rows):
    out = {}
    for r in rows:
        out.setdefault((r[0], r[1]), []).append(r)
    return out


def greedy(truth, comp, least, order):
    t, c, out = by_frame(truth), by_frame(comp), set()
    for k in t.keys() & c.keys():
        cand = [(iou(a[4:8], b[4:8]), a, b) for a in c[k] for b in t[k]]
        used = set()
        for v, a, b in sorted((x for x in cand if x[0] >= least), key=order):
            if a[2] not in used and b[2] not in used:
                used |= {a[2], b[2]}
                out.add((a[2], b[2]))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    truth, comp = boxes()
    return truth, comp, spark.createDataFrame(truth, SCHEMA).cache(), spark.createDataFrame(comp, SCHEMA).cache()


def pairs(df):
    return {(r.c_id, r.t_id) for r in df.collect()}


def test_match_greedy(tables):
    truth, comp, t, c = tables
    assert pairs(m.match_greedy(c, t)) == greedy(truth, comp, 0.5, lambda x: (-x[0], x[1][2], x[2][2]))


def test_match_by_confidence(tables):
    truth, comp, t, c = tables
    assert pairs(m.match_by_confidence(c, t)) == greedy(truth, comp, 0.5, lambda x: (-x[1][8], x[1][2], -x[0], x[2][2]))


def test_grid_join_is_the_plain_join(tables):
    _, _, t, c = tables
    cols = ["c_det_id", "t_det_id"]
    assert set(m.iou_join(c, t, 0.3).select(*cols).collect()) == set(m.iou_join_grid(c, t, 0.3, 16.0).select(*cols).collect())


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, k in ((3, 3), (4, 2), (2, 5)):
        cost = rng.random((n, k))
        got = sum(cost[i, j] for i, j in m.assignment(cost))
        small = min(n, k)
        best = min(sum(cost[i, j] for i, j in zip(r, c)) for r in itertools.permutations(range(n), small) for c in [range(small)]) if k <= n else min(sum(cost[i, j] for i, j in zip(range(n), c)) for c in itertools.permutations(range(k), n))
        assert got == pytest.approx(best)


def test_counts_add_up(tables):
    truth, comp, t, c = tables
    for r in s.detection(c, t, keys=["seq_id"]).collect():
        assert r.tp + r.fn == sum(x[0] == r.seq_id for x in truth)
        assert r.tp + r.fp == sum(x[0] == r.seq_id for x in comp)


def test_truth_against_itself(spark, tables):
    _, _, t, _ = tables
    assert all(r.f1 == 1 and r.mcc == 1 for r in s.detection(t, t).collect())
    assert s.average_precision(t, t).first().ap == pytest.approx(1.0)
    assert all(r.hota == pytest.approx(1.0) for r in s.hota(t, t).collect())
    mm = s.matched_boxes(t, t)
    assert all(r.idf1 == 1 for r in s.idf1(t, t, mm).collect())
    assert all(r.mota == 1 and r.motp == pytest.approx(1) and r.id_switches == 0 for r in s.mot(t, t, matches=mm).collect())


def test_average_precision(tables):
    truth, comp, t, c = tables
    hits = {a for a, _ in greedy(truth, comp, 0.5, lambda x: (-x[1][8], x[1][2], -x[0], x[2][2]))}
    order = sorted(comp, key=lambda r: (-r[8], r[2]))
    tp = np.cumsum([r[2] in hits for r in order])
    p = np.maximum.accumulate((tp / np.arange(1, len(order) + 1))[::-1])[::-1]
    want = sum(v for v, r in zip(p, order) if r[2] in hits) / len(truth)
    assert s.average_precision(c, t).first().ap == pytest.approx(want)


def test_hand_computed_ap(spark):
    b = lambda k, f, x, conf: (0, f, k, k, float(x), 0.0, x + 10.0, 10.0, conf, "A")
    t = spark.createDataFrame([b(1, 0, 0, 1.0), b(2, 0, 100, 1.0)], SCHEMA)
    c = spark.createDataFrame([b(11, 0, 0, 0.9), b(12, 0, 50, 0.8), b(13, 0, 100, 0.7)], SCHEMA)
    assert s.average_precision(c, t).first().ap == pytest.approx((1 + 2 / 3) / 2)


def test_id_switch(spark):
    row = lambda k, f, tr: (0, f, k, tr, 0.0, 0.0, 10.0, 10.0, 1.0, "A")
    t = spark.createDataFrame([row(i, i, 1) for i in range(6)], SCHEMA)
    c = spark.createDataFrame([row(100 + i, i, tr) for i, tr in ((0, 7), (1, 7), (3, 8), (4, 7), (5, 7))], SCHEMA)
    r = s.mot(c, t).first()
    assert (r.id_switches, r.fragmentations, r.fn) == (2, 1, 1)
    k = s.kwant(t, s.matched_boxes(c, t), "t").first()
    assert k.continuity == pytest.approx(1 / 2) and k.purity == pytest.approx(4 / 5)
    q = s.track_quality(t, s.matched_boxes(c, t)).first()
    assert q.gap_length == 1 and q.completeness == pytest.approx(5 / 6)


def test_partitions_do_not_matter(spark, tables):
    _, _, t, c = tables
    assert pairs(m.match_greedy(c.repartition(1), t.repartition(8))) == pairs(m.match_greedy(c, t))


def test_empty_sides(spark, tables):
    _, _, t, _ = tables
    none = spark.createDataFrame([], SCHEMA)
    assert m.match_greedy(none, t).count() == 0
    assert all(r.recall == 0 for r in s.detection(none, t).collect())
