"""Fusion of many frames at once against the folds over one frame, and what a sweep gathers."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxkit.functions import batches
from boxkit.operators import fusion, matching, scoring
from boxkit.plans.fusion import MODELS, _m
from boxkit.plans.views import view

KEEP = ["seq_id", "frame_id", "det_id", "x1", "y1", "x2", "y2", "conf", "cls"]


@pytest.mark.parametrize("candidate", [("weighted", 0.4, 0.0, [1.0, 0.8, 0.5]), ("soft", 0.0, 0.3, [0.4, 1.0, 0.7])])
def test_a_candidate_scores_as_its_fusion_does(spark, sf, candidate):
    b, t = _m(spark, sf).where("frame_id < 40"), view(spark, sf, "truth").where("frame_id < 40").select(*KEEP)
    how, iou, sigma, w = candidate
    w = dict(zip(MODELS, w, strict=True))
    one = fusion.fuse_wbf(b, iou, 3, w) if how == "weighted" else fusion.fuse_soft_nms(b, sigma, 0.05, w)
    want = scoring.average_precision(one.select(*KEEP), t, 0.5).first().ap
    frames = fusion._frames(b, t, MODELS)
    assert fusion._tried(frames, t.count(), 3, [candidate])[0] == pytest.approx(want, abs=1e-9)


def test_steps_take_every_row_once_in_order(monkeypatch):
    r = np.random.default_rng(3)
    group, key = r.integers(0, 30, 400), r.permutation(400)
    monkeypatch.setattr(batches, "CELLS", 50)  # several matrices
    seen = [(group[i], key[i]) for part in batches.steps(group, key) for at in part for i in at]
    assert len(seen) == 400 and all(sorted(k for g, k in seen if g == x) == [k for g, k in seen if g == x] for x in range(30))
    assert not list(batches.steps(np.empty(0, int)))


def test_frames_without_boxes_or_truth(spark):
    b = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 2.0, 2.0, 0.9, None, "a"), (0, 1, 2, 0.0, 0.0, 2.0, 2.0, 0.8, "A", "other")], "seq_id long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls string, model string")
    t = b.where("frame_id = 0").drop("model").unionByName(b.where("frame_id = 0").drop("model").withColumn("frame_id", F.lit(7).cast("long")))
    assert fusion._tried(fusion._frames(b, t, ["a"]), 2, 1, [("weighted", 0.5, 0.0, [1.0]), ("soft", 0.0, 0.5, [1.0])]) == [0.5, 0.5]


def test_a_sweep_gathers_the_boxes_once(spark, sf, monkeypatch):
    calls = []
    real = matching.iou_join
    monkeypatch.setattr(matching, "iou_join", lambda *a, **k: calls.append(a) or real(*a, **k))
    b, t = _m(spark, sf).where("frame_id < 10"), view(spark, sf, "truth").where("frame_id < 10").select(*KEEP)
    fusion.sweep(b, t, MODELS, ious=(0.5,), sigmas=(), draws=1, rounds=0)
    assert not calls


def test_a_sweep_keeps_no_tables_and_no_shuffled_rows(spark, sf):
    from boxkit import shared

    held = lambda: {p.name for p in Path(shared.shared_dir(spark)).iterdir()}
    Path(shared.shared_dir(spark)).mkdir(exist_ok=True)
    before, was = held(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    b, t = _m(spark, sf).where("frame_id < 10"), view(spark, sf, "truth").where("frame_id < 10").select(*KEEP)
    fusion.sweep(b, t, MODELS, ious=(0.5, 0.6), sigmas=(), draws=1, rounds=0)
    assert held() == before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
