"""What keeps work in proportion to the input: how often a line is split, how large a file or a group can become."""

import random

from pyspark.sql import functions as F

from boxkit.operators import footprints, matching, scoring, survey
from boxkit.plans import QUERIES, sources
from boxkit.plans.views import view
from boxkit.sources import boxes as B
from boxkit.sources import documents as D


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_split_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,a,0,1,2,3,4,0.5,-1,A,0.5,"(note) x, y"\nbroken,line\n2,a,1,1,2,nan,4,0.5,-1\n3,a,1,1,2,3,4,0.5,-1\n')
    d = B.read_boxes(spark, str(tmp_path))
    assert plan(d).count("split(value") <= 2  # one for lines with an odd number of quotes, one for those without any
    assert sorted((r.track_id, r.cls, r.notes) for r in d.collect()) == [(1, "A", ["x, y"]), (3, None, [])]
    assert sorted(r.value for r in B.rejects(spark, str(tmp_path)).collect()) == ["2,a,1,1,2,nan,4,0.5,-1", "broken,line"]


def test_fields_are_those_of_the_plain_split(spark):
    r = random.Random(7)
    rows = [("".join(r.choice('ab ,,"') for _ in range(r.randint(0, 14))),) for _ in range(3000)]
    d = spark.createDataFrame(rows, "value string")
    assert d.where(~B.fields(F.col("value")).eqNullSafe(F.split("value", B.COMMA))).count() == 0


def boxes(spark, frames, seqs=2):
    d = spark.range(frames * seqs).selectExpr(f"concat('clip', id % {seqs}) AS seq", "id AS det_id", "id AS track_id", f"id DIV {seqs} AS frame_id", "1.0D AS x1", "2.0D AS y1", "11.0D AS x2", "12.0D AS y2", "0.5D AS conf", "-1.0D AS length", "'A' AS cls")
    return d.select("*", F.concat(F.lit("img"), "frame_id").alias("frame_name"), F.expr("array(named_struct('name', cls, 'score', conf))").alias("scores"), F.create_map(F.lit("k"), F.lit("v")).alias("attrs"))


def test_a_long_sequence_is_several_image_tables(spark, tmp_path):
    df = boxes(spark, 25)
    files = D.coco_files(df, 10).selectExpr("seq", "part", "from_json(value, 'images ARRAY<STRUCT<id: BIGINT>>').images.id AS ids")
    got = {(r.seq, r.part): r.ids for r in files.collect()}
    assert {k: len(v) for k, v in got.items()} == {(f"clip{s}", p): n for s in range(2) for p, n in ((0, 10), (1, 10), (2, 5))}
    assert got["clip1", 2] == list(range(21, 26))
    D.write_coco(df, str(tmp_path / "c"), 10)
    back = D.read_coco(spark, str(tmp_path / "c")).collect()
    assert sorted(r.det_id for r in back) == list(range(50)) and len({r.file for r in back}) == 6
    assert all(r.video == f"clip{r.det_id % 2}" and r.frame_id == r.det_id // 2 and r.track == f"track_{r.det_id}" for r in back)


def test_cut_sequences_count_once(spark, tmp_path):
    B.write_boxes(boxes(spark, 30).where("frame_id < 10"), str(tmp_path / "a"), fps=5.0)
    B.write_boxes(boxes(spark, 30).where("frame_id >= 10"), str(tmp_path / "b"), fps=5.0)
    d = B.header_fps(spark, str(tmp_path)).collect()
    assert len(d) == 4 and {(r.seq, r.fps) for r in d} == {("clip0", 5.0), ("clip1", 5.0)}
    assert {r.seq for r in B.read_boxes(spark, str(tmp_path)).select("seq").collect()} == {"clip0", "clip1"}


def test_several_files_of_xml_below_one_folder(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.xml").write_text(f'<annotations><image id="{k}" name="i{k}"><box label="A" xtl="1" ytl="2" xbr="3" ybr="4"/></image></annotations>')
    assert sorted((r.frame_id, r.format) for r in D.read_auto(spark, str(tmp_path)).collect()) == [(k, "cvat") for k in range(3)]


def test_sweep_chooses_as_each_threshold_would(spark, sf):
    """One gathering of pairs gives the matches that a matching of the boxes left at each threshold gives."""
    keep = ["seq_id", "frame_id", "det_id", "track_id", "x1", "y1", "x2", "y2", "conf", "cls"]
    c, t = view(spark, sf, "computed").where("frame_id < 60").select(*keep), view(spark, sf, "truth").where("frame_id < 60").select(*keep)
    got = scoring.sweep_matches(c, t, 4, 0.3).select("step", "seq_id", "frame_id", "c_id", "t_id").collect()
    for k in range(4):
        one = matching.match_greedy(c.where(F.col("conf") >= k / 4), t, 0.3).select("seq_id", "frame_id", "c_id", "t_id").collect()
        assert sorted(tuple(r) for r in one) == sorted(tuple(r)[1:] for r in got if r.step == k) and one


def test_user_code_gets_stretches_of_frames(spark, sf):
    assert "stretch" in plan(QUERIES["udf_frame"](spark, sf))


def test_samples_of_rescoring_are_written_once(spark, sf):
    assert "Join" not in plan(QUERIES["rescore_fit"](spark, sf))


def test_a_frame_is_a_row_for_few_cells(spark):
    """Cells are about half as wide as a footprint, so the index stays near the number of frames."""
    f = spark.range(40).selectExpr("0L AS seq_id", "id AS frame_id", "0L AS camera", "id DIV 10 AS reference", "array(1D, 0D, 180D * (id % 10), 0D, 1D, 0D, 0D, 0D, 1D) AS h", "300D AS width", "200D AS height", "'n' AS name")
    frames = footprints._prepared(f)
    index = footprints.covered_cells(frames, footprints.cell_size(frames))
    assert 40 <= index.count() <= 40 * 16 and index.where("full").count()


def test_a_detection_is_one_row_for_all_thresholds(spark, sf):
    keep = ["seq_id", "frame_id", "det_id", "x1", "y1", "x2", "y2", "conf"]
    c, t = view(spark, sf, "computed").where("frame_id < 60").select(*keep), view(spark, sf, "truth").where("frame_id < 60").select(*keep)
    least = [0.5 + 0.05 * i for i in range(10)]
    rows = scoring.threshold_hits(c, t, least).collect()
    assert sorted(r.det_id for r in rows) == sorted(r.det_id for r in c.select("det_id").collect())
    for i in (0, 5, 9):
        want = matching.match_by_confidence(c, t, least[i]).collect()
        assert sorted(r.det_id for r in rows if r["mask"] >> i & 1) == sorted(r.c_id for r in want)
    got = scoring.ap_over_thresholds(c, t).first()
    each = [scoring.average_precision(c, t, x).first().ap for x in (least[0], least[5])]
    assert abs(got.ap50 - each[0]) < 1e-12 and abs(got.ap75 - each[1]) < 1e-12


def test_equal_footprints_are_cut_into_cells_once(spark):
    """Images of one quad share its cells; kinds, shares and revisits are those that the cells of every image give."""
    r = random.Random(3)
    rows = [(o % 2, o, r.choice("AB"), 1 + o % 2, f"d{o // 40}", o // 3, 30.0 * r.randrange(4), 50.0 * r.randrange(3)) for o in range(120)]
    images = spark.createDataFrame(rows, "site long, ord long, camera string, pass_no int, day string, step long, e double, n double")
    corner = lambda dx, dy: F.struct((F.col("e") + dx).alias("x"), (F.col("n") + dy).alias("y"))
    images = images.withColumn("quad", F.array(corner(-100.0, 75.0), corner(100.0, 75.0), corner(100.0, -75.0), corner(-100.0, -75.0)))
    covered = survey.cells(images, 50.0).select("site", "ord", "cell_x", "cell_y")
    sources = survey.footprint_sources(images, 50.0).collect()
    assert len(sources) == images.select("site", "quad").distinct().count() < 30
    want = survey.prior_sources(covered, images, 5).collect()
    kinds = survey.footprint_kinds(images, 50.0, 5)
    assert sorted(tuple(x) for x in kinds.select("site", "ord", F.inline("sources")).collect()) == sorted(tuple(x) for x in want)
    assert {x.kind for x in want} == {"sequential", "cross_camera", "revisit"}
    plain = {(x.site, x.ord): (round(x.prior, 9), x.cells) for x in survey.prior_fraction(covered).collect()}
    assert {(x.site, x.ord): (round(x.prior, 9), x.cells) for x in survey.footprint_fraction(images, 50.0).collect()} == plain
    back = {}
    for x in want:
        if x.kind == "revisit":
            back.setdefault((x.site, x.ord), []).append((-x.shared, x.src))
    got = {(x.site, x.ord): (x.src, round(x.overlap, 9)) for x in survey.revisits(kinds).collect()}
    assert got == {k: (min(v)[1], round(-sum(s for s, _ in v) / plain[k][1], 9)) for k, v in back.items()}


def test_pairs_of_a_single_common_point_are_no_rows(spark):
    r = random.Random(5)
    points = {(r.randrange(25), r.randrange(60)) for _ in range(260)} | {(100, 1000), (101, 1000), (102, 1001)}
    df = survey.overlap_pairs(spark.createDataFrame(sorted(points), "image_id long, point_id long"), 3)
    assert "Join Inner" not in plan(df)
    of = {i: {p for j, p in points if j == i} for i, _ in points}
    want = []
    for i in of:
        best = sorted((-len(of[i] & of[j]), j) for j in of if j != i and of[i] & of[j])[:3]
        want += [(i, j, -s, k + 1) for k, (s, j) in enumerate(best)]
    assert sorted(tuple(x) for x in df.select("image_id", "partner", "shared", "rank").collect()) == sorted(want)
    assert any(s == 1 for _, _, s, _ in want) and any(s > 2 for _, _, s, _ in want)


def test_each_file_of_lines_has_its_header(spark, tmp_path):
    head, lines = 'a,"b c",d', [' "x, y", \\ z" ', "p,q", '"', "  r"] * 25
    df = spark.createDataFrame([(x,) for x in lines], "value string").repartition(5).withColumnRenamed("value", head)
    sources._headed(df, str(tmp_path / "h"))
    files = [f.read_text().splitlines() for f in (tmp_path / "h").glob("part-*")]
    assert len(files) == 5 and all(f[0] == head for f in files)
    assert sorted(x for f in files for x in f[1:]) == sorted(lines)


def test_files_of_a_version_are_several(spark, sf):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tables this small are put into one task
    try:
        files = QUERIES["io_oceaneyes_read"](spark, sf).inputFiles()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({f.rsplit("/", 2)[1] for f in files}) == 3 and len(files) > 3


def test_matches_bring_their_tracks(spark, sf):
    keep = ["seq_id", "frame_id", "det_id", "track_id", "x1", "y1", "x2", "y2", "conf", "cls"]
    c, t = view(spark, sf, "computed").where("frame_id < 60").select(*keep), view(spark, sf, "truth").where("frame_id < 60").select(*keep)
    cols = ["seq_id", "frame_id", "c_id", "t_id", "c_track_id", "t_track_id"]
    got = scoring.matched_tracks(c, t)
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(tuple(r) for r in scoring.matched_boxes(c, t).select(cols).collect())
    assert "Join" not in plan(got)  # written once


def test_thresholds_of_hota_meet_pairs_of_tracks(spark, sf):
    keep = ["seq_id", "frame_id", "det_id", "track_id", "x1", "y1", "x2", "y2"]
    p = plan(scoring.hota(view(spark, sf, "computed").select(*keep), view(spark, sf, "truth").select(*keep)))
    assert "collect_list(iou" in p
