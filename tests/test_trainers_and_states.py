"""Rules of trainers by hand, and metric states against the whole columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxkit.operators import accumulate, trainers

STATS = {"annotations": 400.0, "min_class_count": 12.0, "mask_fraction": 0.5, "mean_objects_per_frame": 3.0, "high_overlap_fraction": 0.3, "mean_concurrent_tracks": 2.0, "occlusion_fraction": 0.05, "mean_object_area": 2000.0, "max_velocity": 9.0}


def ranked(spark, settings, stats=STATS):
    table = trainers.rules(spark, settings)
    s = spark.createDataFrame([("k", n, v) for n, v in stats.items()], "key string, stat string, value double")
    return {r.trainer: r for r in trainers.evaluate(s, table, ["key"]).collect()}


def test_gates_and_their_reasons(spark):
    got = ranked(spark, {
        "plain": {}, "ok": {"required_min_count_per_class": 12, "required_mask_fraction": 0.5, "required_max_velocity": 9.0, "required_masks": True},
        "out": {"required_min_count_per_class": 13, "required_max_velocity": 8.5}, "unknown": {"required_max_aspect_ratio_std": 0.1},
    })
    assert {k: r.eligible for k, r in got.items()} == {"plain": True, "ok": True, "out": False, "unknown": True}
    assert got["out"].reason == "required_max_velocity: max_velocity is 9.0; required_min_count_per_class: min_class_count is 12.0" and got["out"]["rank"] is None
    assert got["ok"].reason is None and {k: r["rank"] for k, r in got.items() if r.eligible} == {"ok": 1, "plain": 2, "unknown": 3}


@pytest.mark.parametrize(
    "option, value, stat, points",
    [("annotation_count_preference", "low", None, 1), ("annotation_count_preference", "medium", 500.0, 1), ("annotation_count_preference", "medium", 5000.0, 0), ("density_preference", "sparse", 3.0, 1), ("density_preference", "medium", 3.0, 0), ("density_preference", "dense", 20.0, 1),
     ("overlap_preference", "medium", 0.3, 1), ("overlap_preference", "high", 0.3, 0), ("overlap_preference", "low", 0.1, 0), ("track_density_preference", "sparse", 3.0, 0), ("occlusion_preference", "high", 0.3, 1), ("prefers_masks", True, None, 1)],
)
def test_bounds_of_preferences(spark, option, value, stat, points):
    names = {"annotation_count_preference": "annotations", "density_preference": "mean_objects_per_frame", "overlap_preference": "high_overlap_fraction", "track_density_preference": "mean_concurrent_tracks", "occlusion_preference": "occlusion_fraction", "prefers_masks": "mask_fraction"}
    stats = STATS if stat is None else STATS | {names[option]: stat}
    assert ranked(spark, {"t": {option: value}}, stats)["t"].score == points


def test_any_clause_is_enough(spark):
    assert ranked(spark, {"t": {"prefers_reid": True}})["t"].score == 1
    assert ranked(spark, {"t": {"prefers_reid": True}}, STATS | {"mean_object_area": 100.0})["t"].score == 0
    assert ranked(spark, {"t": {"prefers_reid": True}}, STATS | {"mean_object_area": 100.0, "occlusion_fraction": 0.2})["t"].score == 1


def test_detector_statistics(spark):
    rows = [(0, 0, "a", 0.0, 0.0, 10.0, 10.0), (0, 0, "a", 0.0, 0.0, 40.0, 10.0), (0, 1, "b", 0.0, 0.0, 200.0, 100.0)]
    df = spark.createDataFrame(rows, "seq_id long, frame_id long, cls string, x1 double, y1 double, x2 double, y2 double")
    s = {r.stat: r.value for r in trainers.detector_statistics(df, ["seq_id"], [400.0, 401.0]).collect()}
    assert s["annotations"] == 3 and s["area_share:400.0"] == pytest.approx(2 / 3) and s["area_share:401.0"] == pytest.approx(1 / 3)
    assert (s["mean_objects_per_frame"], s["max_objects_per_frame"], s["min_class_count"], s["class_imbalance"], s["multi_scale"]) == (1.5, 2, 1, 2, 1)
    assert (s["mostly_small"], s["mostly_medium"], s["mostly_large"], s["mostly_square"], s["mostly_wide"]) == (1, 0, 0, 1, 0)


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else "cold", float(1e6 + rng.normal()), ["tp", "fp", "fn"][i % 3]) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "key string, value double, kind string").repartition(40)


@pytest.mark.parametrize("fanin", [2, 16])
def test_states_merge_to_the_whole(values, fanin):
    rows, df = values
    of = lambda k: [r for r in rows if r[0] == k]
    got = {r.key: r for r in accumulate.accumulate(df, ["key"], "mean", fanin).collect()}
    for k in (None, "hot", "cold"):
        v = np.array([r[1] for r in of(k)])
        assert got[k].n == len(v) and np.isclose(got[k]["mean"], v.mean(), rtol=1e-12) and np.isclose(got[k].variance, v.var(), rtol=1e-6)
    got = {r.key: r for r in accumulate.accumulate(df, ["key"], "counts", fanin).collect()}
    for k in (None, "hot", "cold"):
        n = [sum(r[2] == x for r in of(k)) for x in ("tp", "fp", "fn")]
        assert [got[k].tp, got[k].fp, got[k].fn] == n and got[k].precision == pytest.approx(n[0] / (n[0] + n[1]) if n[0] + n[1] else 0)
    got = {r.key: r.counts for r in accumulate.accumulate(df, ["key"], "histogram", fanin, low=1e6 - 1, high=1e6 + 1, bins=4).collect()}
    for k in (None, "hot", "cold"):
        v = np.clip(np.floor((np.array([r[1] for r in of(k)]) - 1e6 + 1) * 2), 0, 3).astype(int)
        assert got[k] == np.bincount(v, minlength=4).tolist()
    assert accumulate.accumulate(df.limit(0), ["key"], "mean").collect() == []


def test_user_metric_by_name(spark):
    @accumulate.register("longest")
    class Longest(accumulate.Metric):
        result = "n long"

        def start(self):
            return np.zeros(1)

        def add(self, state, rows):
            return np.maximum(state, rows.text.str.len().max())

        def merge(self, a, b):
            return np.maximum(a, b)

        def finish(self, state):
            return (int(state[0]),)

    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text")).repartition(7)
    assert {r.k: r.n for r in accumulate.accumulate(df, ["k"], "longest").collect()} == {0: 498, 1: 499, 2: 497}
