"""Statistics, fits, fusion and names by numbers worked out by hand."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from boxkit.operators import filters, fusion, matching, quantiles, search, stats, survey, tracks

BOX = "seq_id long, frame_id long, det_id long, track_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls string, model string"


def box(det, x, conf=1.0, f=0, track=1, cls="A", model="m0", y=0.0, w=10.0, h=10.0):
    return (0, f, det, track, float(x), float(y), float(x) + w, float(y) + h, float(conf), cls, model)


def frame(spark, rows):
    return spark.createDataFrame(rows, BOX)


def test_density_and_concurrency_bounds_are_inclusive(spark):
    df = frame(spark, [box(i, 0, f=f, track=i) for f, n in ((0, 5), (1, 3), (2, 1)) for i in range(n)])
    frames = spark.createDataFrame([(0, f) for f in range(5)], "seq_id long, frame_id long")
    r = stats.density_stats(df, frames, crowded=5, sparse=3).first()
    assert (r["max"], r.crowded, r.sparse, r.empty, r["mean"]) == (5, 1, 2, 2, 9 / 5)
    r = stats.concurrency_stats(df, crowded=5, sparse=3).first()
    assert (r.crowded, r.sparse) == (1, 2)


def test_long_tracks_begin_at_the_threshold(spark):
    df = frame(spark, [box(f, 0, f=f, track=n) for n in (2, 4, 6) for f in range(n)])
    r = stats.track_stats(df, short=4, long=6).first()
    assert (r.short, r.medium, r.long, r.median) == (1, 1, 1, 4)


def test_class_balance_counts_boxes(spark):
    df = frame(spark, [box(i, 0, cls=c) for c, n in (("a", 8), ("b", 4), ("c", 1)) for i in range(n)])
    r = stats.class_balance(df, rare=4, dominant=4).first()
    assert (r.imbalance, r.rare, r.dominant) == (8.0, 1, 1)


@pytest.mark.parametrize(
    "matched, unmatched, want",
    [
        ([0.2, 0.4, 0.6, 0.8, 1.0], [0.1, 0.3], (0.4, 0.22, 0.52)),  # p60 of the misfires is 0.22, p2 of the hits 0.216
        ([1.0] * 5, [0.99, 0.98], (0.95, 0.9, 0.95)),
        ([0.0] * 5, [], (0.05, 0.0, 0.05)),  # where the bounds of low cross, the upper one holds
    ],
)
def test_thresholds(spark, matched, unmatched, want):
    df = spark.createDataFrame([("k", c, 1) for c in matched] + [("k", c, 0) for c in unmatched], "k string, conf double, matched int")
    r = stats.thresholds(df, ["k"]).first()
    assert (r.high, r.low, r.new) == pytest.approx(want)


def test_kalman_weights_see_turns(spark):
    """Steps of equal length that turn by a right angle: the speed doesn't change, the velocity does."""
    at = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0), (2, 0), (2, 2), (0, 2), (0, 0), (2, 0)]
    df = frame(spark, [box(i, x, f=i, y=y) for i, (x, y) in enumerate(at)])
    r = stats.kalman_fit(df).first()
    assert (r.position, r.velocity) == pytest.approx((2 * 0.2, 0.5))  # 2 x 2.83 / 10, clipped
    r = stats.kalman_fit(frame(spark, [box(i, 2 * i, f=i) for i in range(3)])).first()
    assert (r.position, r.velocity) == (1 / 20, 1 / 160)  # too few boxes


def test_match_gate_is_a_distance(spark):
    df = frame(spark, [box(i, 5 * (i % 2), f=i, track=1) for i in range(150)])
    r = stats.match_gate(df).first()
    assert r.links == 149 and r.distance == pytest.approx(1 - 5 / 15)
    assert stats.match_gate(df, highest=0.25).first().distance == 0.75
    assert stats.match_gate(df.where("frame_id < 50")).first()[1:] == (49, 0.8)


def test_a_share_of_clips_is_rounded_down(spark):
    held = lambda n, share: {r.seq_id for r in tracks.clip_split(spark.range(n).selectExpr("id AS seq_id", "true AS usable"), share).collect() if r.validation}
    assert held(7, 0.4) == {5, 6} and held(7, 0.01) == {6} and held(4, 0.9) == {2, 3} and held(1, 0.5) == set()


def test_feedback_from_the_middle(spark):
    for n, want in ((6, [4, 2, 5, 1, 6, 3]), (5, [4, 2, 5, 1, 3])):
        s = spark.createDataFrame([(f"u{k}", k / 10) for k in range(1, n + 1)], "uid string, score double")
        got = [int(r.uid[1:]) for r in search.feedback_order(s, 10, None).orderBy("rank").collect()]
        assert got == want  # by falling score: the place above the middle, the one below, and so on
        assert [int(r.uid[1:]) for r in search.feedback_order(s, 2, None).orderBy("rank").collect()] == want[:2]
    ties = spark.createDataFrame([(f"u{k:02d}", 0.5) for k in range(30)], "uid string, score double")
    assert [r.uid for r in search.feedback_order(ties, 4, None).orderBy("rank").collect()] == ["u14", "u16", "u13", "u17"]


def test_another_day_is_another_visit(spark):
    cells = spark.createDataFrame([(0, o, 1, 1) for o in range(4)], "site long, ord long, cell_x long, cell_y long")
    cells = cells.where("ord < 1").unionByName(cells.where("ord >= 1"))
    images = spark.createDataFrame([(0, 0, "A", 1, "d1", 0), (0, 1, "A", 1, "d1", 1), (0, 2, "B", 1, "d1", 2), (0, 3, "A", 1, "d2", 1)], "site long, ord long, camera string, pass_no long, day string, step long")
    got = {r.ord: r.kind for r in survey.prior_sources(cells, images, 1).collect()}
    assert got == {1: "sequential", 2: "revisit", 3: "revisit"}
    assert {r.ord: r.kind for r in survey.prior_sources(cells, images, 2).collect()}[2] == "cross_camera"


def test_loose_evidence_is_ranked_by_area(spark):
    boxes = frame(spark, [box(1, 0, 0.5)])
    evidence = frame(spark, [box(2, 5, 0.9), box(3, 100, 0.9), box(4, 200, 0.1, w=40.0), box(5, 1000, 0.9, w=400.0)])
    got = {r.det_id: r.conf for r in matching.coverage_reinforce(boxes, evidence, 0.5, 0.2, max_evidence_area=500.0).collect()}
    assert got == pytest.approx({1: 0.5 + 0.5 * 0.5 * 0.5, 3: 0.2 * 100 / 400, 4: 0.2})
    assert {r.det_id for r in matching.coverage_reinforce(boxes, evidence, recover=False).collect()} == {1}


def test_the_best_box_takes_all_that_overlap_it(spark):
    """The third box overlaps the second seed more, but the best box was there first."""
    df = frame(spark, [box(1, 0, 0.9, cls="A"), box(2, 6, 0.8, cls="B"), box(3, 3.5, 0.7, cls="B")])
    got = {r.det_id: r for r in fusion.cross_class(df, 0.4).collect()}
    assert sorted(got) == [1, 2] and got[1].scores == {"A": 0.9, "B": 0.7} and got[1].agree is False and got[1].x1 == pytest.approx(0.7 * 3.5 / 1.6)


def test_probabilistic_fusion(spark):
    """Weights as exponents, one cluster per class, mean boxes that move, background of what is left."""
    df = frame(spark, [box(1, 0, 0.8, model="m0"), box(2, 2, 0.6, model="m1"), box(3, 0, 0.5, cls="B", model="m1")])
    df = df.withColumn("scores", F.when(F.col("det_id") == 2, F.create_map(F.lit("A"), F.lit(0.6), F.lit("B"), F.lit(0.3))).otherwise(F.create_map("cls", "conf")))
    got = {r.det_id: r for r in fusion.fuse_proben(df, 0.5, ["A", "B"], {"m0": 2.0}).collect()}
    assert sorted(got) == [1, 3]
    r, eps = got[1], 1e-8
    p = {"A": 0.8**2 * 0.6, "B": eps**2 * 0.3, "background": 0.2**2 * 0.1}
    assert r.cls == "A" and r.n == 2 and r.conf == pytest.approx(p["A"] / sum(p.values())) and r.scores == pytest.approx({k: v / sum(p.values()) for k, v in p.items()})
    assert r.x1 == pytest.approx(2 * 0.6 / (1.6 + 0.6))
    chain = frame(spark, [box(1, 0, 0.9), box(2, 3, 0.8), box(3, 4, 0.7)])  # the third meets the mean of both, not the first
    assert [r.n for r in fusion.fuse_proben(chain, 0.5, ["A"]).collect()] == [3]
    assert [r.n for r in fusion.fuse_proben(chain, 0.5, ["A"], skip=0.75).collect()] == [2]


def test_mean_distribution_and_the_ignored_class(spark):
    rows = [(0, t, c, s) for t, c, s in [(1, 0.5, {"a": 1.0}), (1, 1.0, {"a": 0.4, "b": 0.6}), (2, 0.5, {"none": 0.8}), (2, 1.0, {"a": 0.9, "none": 0.1}), (3, 0.5, {"none": 0.8}), (3, 0.5, {"none": 0.4}), (4, 0.5, None)]]
    df = spark.createDataFrame(rows, "seq_id long, track_id long, conf double, scores map<string,double>")
    got = {(r.track_id, r.cls): r.score for r in fusion.mean_distribution(df, "none").collect()}
    assert got == pytest.approx({(1, "a"): (0.1 + 0.9 * 0.75) * (0.5 + 0.4) / 1.5, (1, "b"): (0.1 + 0.9 * 0.75) * 0.6 / 1.5, (2, "a"): (0.1 + 0.9 * 0.75) * 0.9 / 1.0, (3, "none"): (0.1 + 0.9 * 0.5) * 0.6})
    plain = {(r.track_id, r.cls): r.score for r in fusion.mean_distribution(df.where("track_id = 1"), weighted=False, scaled=False).collect()}
    assert plain == pytest.approx({(1, "a"): 0.7, (1, "b"): 0.3})


def test_times_in_names(spark):
    at = lambda *a: datetime.datetime(*a)
    names = {
        "x/CHESS_FL1_C_160407_234502.428_COLOR-8-BIT.JPG": at(2016, 4, 7, 23, 45, 2, 428000),
        "CHESS2016_N94S_FL23_P__20160518012412.111GMT_THERM-16BIT.PNG": at(2016, 5, 18, 1, 24, 12, 111000),
        "a_b_C_20190507_004346.455104.tif": at(2019, 5, 7, 0, 43, 46, 455104),
        "a_b_20190507_004346.455": at(2019, 5, 7, 0, 43, 46, 455000),
        "20151023.200145.662.017459.png": at(2015, 10, 23, 20, 1, 45, 662000),
        "00231.00232.20171025.182621.170.004021.tif": at(2017, 10, 25, 18, 26, 21, 170000),
        "201503.20150517.105551974.76450.png": at(2015, 5, 17, 10, 55, 51, 974000),
        "cam-20200102-030405-678.png": at(2020, 1, 2, 3, 4, 5, 678000),
        "cam-20200102-030405-6.png": at(2020, 1, 2, 3, 4, 5, 6),
        "image_number_1234567.png": at(1970, 1, 1, 0, 0, 1, 234567),
        "short.png": None, "no digits at all.png": None, "cam-20209902-030405.png": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.t for r in df.select("name", filters.ts_from_filename("name").cast("timestamp_ntz").alias("t")).collect()}
    assert got == names


def test_ranks_of_a_key_with_most_of_the_rows(spark):
    """The values that sorting gives, from counts in bins, with ties, far values and a key of one value."""
    rows = [("hot", float((i * 7919) % 5000) if i % 50 else 1e9) for i in range(20000)] + [("one", 3.0)] * 700 + [("few", v) for v in (2.0, 1.0)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    shares = {"p10": 0.1, "half": 0.5, "p99": 0.99, "all": 1.0}
    d = quantiles.by_index(df, F.col("v"), shares, ["k"], few=300, bins=16)
    assert "Window" not in "".join(p for p in d._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in p and "bin" not in p)
    got = {r.k: tuple(r[p] for p in shares) for r in d.collect()}
    for k in ("hot", "one", "few"):
        v = sorted(x for name, x in rows if name == k)
        assert got[k] == tuple(v[min(math.floor(len(v) * s), len(v) - 1)] for s in shares.values())
    assert set(got) == {"hot", "one", "few"}
    r = quantiles.by_index(df, F.col("v"), {"half": 0.5}, [], few=300).first()
    v = sorted(x for _, x in rows if x is not None)
    assert r.half == v[len(v) // 2]
