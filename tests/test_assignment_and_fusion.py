"""Sparse assignment against the dense one, and fused tracks against loops over clusters."""

import numpy as np
import pytest

from boxkit.operators import fusion, matching

BOXES = "seq_id long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls string"


def test_sparse_assignment_costs_what_the_dense_one_costs():
    rng = np.random.default_rng(0)
    for trial in range(400):
        n, k = rng.integers(1, 9, 2)
        w = rng.random((n, k)) * (rng.random((n, k)) < 0.6)
        w = np.round(w, 1) if trial % 3 == 0 else w
        got = matching.assign_sparse([(i, j, 1 - w[i, j]) for i in range(n) for j in range(k) if w[i, j] > 0])
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
        assert np.isclose(sum(w[p] for p in got), sum(w[p] for p in matching.assignment(1 - w)))


def test_a_frame_of_five_thousand_boxes(spark):
    """Boxes that all overlap their neighbours: one connected block, no matrix of 25 million."""
    n = 5000
    side = lambda shift: spark.range(n).selectExpr("0L AS seq_id", "0L AS frame_id", "id AS det_id", f"id * 4D + {shift} AS x1", "0D AS y1", f"id * 4D + {shift} + 10 AS x2", "10D AS y2", "0.9D AS conf", "'A' AS cls")
    got = matching.match_optimal(side(0), side(1.5), 0.3).collect()
    assert len(got) == n and all(r.c_id == r.t_id for r in got)


def tubes(rng):
    """Three trackers over five things: shifted boxes, gaps, fragments and things of their own."""
    rows, det = [], 0
    for s in range(3):
        for model in range(3):
            track = 0
            for thing in range(5):
                if model == 2 and thing == 4:
                    continue
                cut = rng.integers(4, 16) if (thing + model) % 2 else 99
                for f in range(20):
                    if f == cut:
                        track += 1
                    if rng.random() < 0.15:
                        continue
                    x, y = 40.0 * thing + 2 * f + rng.normal(0, 2), 5.0 * f + rng.normal(0, 2)
                    rows.append((s, f, det, float(x), float(y), float(x) + 20, float(y) + 20, float(rng.uniform(0.2, 1)), "ab"[(thing + model) % 2], f"m{model}", track))
                    det += 1
                track += 1
    return rows


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def plain_clusters(rows, least, least_frames):
    data = {}
    for s, f, _, *box, _, _, model, track in rows:
        data.setdefault(s, {}).setdefault(model, {}).setdefault(track, {})[f] = np.array(box)
    out = {}
    for s, models in data.items():
        clusters = []  # frames of mean boxes, members
        for model in sorted(models):
            tracks = sorted(models[model])
            if not clusters:
                clusters = [[dict(models[model][t]), [(model, t)]] for t in tracks]
                continue
            tube = np.zeros((len(clusters), len(tracks)))
            for c, (held, _) in enumerate(clusters):
                for i, t in enumerate(tracks):
                    common = held.keys() & models[model][t].keys()
                    if len(common) >= least_frames:
                        tube[c, i] = np.mean([overlap(held[f], models[model][t][f]) for f in common])
            joins = {}
            for c, i in matching.assignment(1 - tube):
                if tube[c, i] >= least:
                    joins[i] = c
            mine = {c: [tracks[i]] for i, c in joins.items()}
            for i, t in enumerate(tracks):
                if i not in joins:
                    free = [(tube[c, i], c) for c in range(len(tube)) if tube[c, i] >= least and not any(models[model][t].keys() & models[model][o].keys() for o in mine.get(c, []))]
                    if free:
                        joins[i] = max(free)[1]
                        mine.setdefault(joins[i], []).append(t)
            for i, t in enumerate(tracks):
                if i in joins:
                    held, members = clusters[joins[i]]
                    for f, b in models[model][t].items():
                        held[f] = (held[f] + b) / 2 if f in held else b
                    members.append((model, t))
                else:
                    clusters.append([dict(models[model][t]), [(model, t)]])
        out[s] = sorted(sorted(m) for _, m in clusters)
    return out


def test_clusters_of_fragmented_trackers(spark):
    rows = tubes(np.random.default_rng(4))
    df = spark.createDataFrame(rows, BOXES + ", model string, track_id int").withColumn("track_id", fusion.F.col("track_id").cast("long")).repartition(3)
    for least, frames in ((0.3, 1), (0.55, 4)):
        got = {}
        for r in fusion.cluster_tracks(df, least, least_frames=frames).collect():
            got.setdefault(r.seq_id, {}).setdefault(r.cluster, []).append((r.model, r.track_id))
        assert {s: sorted(map(sorted, c.values())) for s, c in got.items()} == plain_clusters(rows, least, frames)
    members = [m for c in plain_clusters(rows, 0.3, 1).values() for m in c]
    assert any(len({k for k, _ in m}) < len(m) for m in members)  # fragments of one tracker in a cluster


def test_fused_boxes_classes_and_weights(spark):
    row = lambda model, track, f, x, conf, cls: (0, f, 0, float(x), 0.0, x + 10.0, 10.0, conf, cls, model, track)
    rows = [row("m0", 1, 0, 0, 0.8, "a"), row("m1", 5, 0, 2, 0.4, "b"), row("m0", 1, 1, 0, 0.5, "a"), row("m1", 7, 9, 500, 0.9, "a")]
    df = spark.createDataFrame(rows, BOXES + ", model string, track_id long")
    got = {r.frame_id: r for r in fusion.fuse_tracks(df, 0.3, weights={"m0": 3.0}).collect()}
    assert sorted(got) == [0, 1]
    w = (3 * 0.8, 0.4)
    r = got[0]
    assert r.trackers == 2 and np.isclose(r.x1, 2 * w[1] / sum(w)) and np.isclose(r.conf, (3 * 0.8 + 0.4) / 4)
    assert np.isclose(r.scores["a"], r.conf) and np.isclose(r.scores["b"], r.conf * (0.4 * 0.4) / (w[0] * 0.8))
    assert got[1].scores == {"a": pytest.approx(0.5)} and got[1].x1 == 0
    single = fusion.fuse_tracks(df, 0.3, min_trackers=1).collect()
    assert {(r.frame_id, r.trackers) for r in single} == {(0, 2), (1, 2), (9, 1)}


def test_frames_are_solved_along_sorted_pairs(monkeypatch):
    import pandas as pd

    monkeypatch.delattr(pd.DataFrame, "groupby")  # a group for each frame cost more than its matching
    rows = [(0, 2, 5, 6, 0.9), (0, 1, 1, 3, 0.6), (0, 1, 1, 4, 0.8), (0, 1, 2, 4, 0.7), (0, 2, 5, 7, 0.4), (0, 3, 8, 9, 0.2)]
    pdf = pd.DataFrame(rows, columns=["seq_id", "frame_id", "c_det_id", "t_det_id", "iou"])
    got = matching.solve_frames(pdf, 0.5)
    assert [tuple(r) for r in got.itertuples(index=False)] == [(0, 1, 1, 3, 0.6), (0, 1, 2, 4, 0.7), (0, 2, 5, 6, 0.9)]


def test_fused_tracks_keep_no_clusters_and_dont_depend_on_order(spark):
    from pathlib import Path

    from boxkit.shared import shared_dir

    held = lambda: {p.name for p in Path(shared_dir(spark)).glob("*") if p.name.startswith(("clusters-", "joined-"))}
    rows = [(0, f"m{k}", t, f, 100.0 * t + k / 3, 0.1 * k, 100.0 * t + 10 + k / 7, 10.0 + k / 11, 0.3 + 0.1 * k + f / 77, "AB"[k % 2]) for k in range(4) for t in range(3) for f in range(5)]
    schema = "seq_id long, model string, track_id long, frame_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls string"
    before, got = held(), []
    for data, n in ((rows, 1), (rows[::-1], 7)):
        out = fusion.fuse_tracks(spark.createDataFrame(data, schema).repartition(n), 0.3, weights={"m1": 1.7})
        got.append(sorted((r.fused, r.frame_id, r.x1, r.y1, r.x2, r.y2, r.conf, tuple(sorted(r.scores.items())), r.trackers) for r in out.collect()))
    assert got[0] == got[1] and len(got[0]) == 15 and {r[-1] for r in got[0]} == {4}
    assert held() == before
