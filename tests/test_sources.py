"""Readers on files in the layouts that are met, and tables that are replaced video by video."""

import json
import math

import pytest
from pyspark.sql import functions as F

from boxkit.operators import matching as m
from boxkit.operators import scoring
from boxkit.sources import databases as DB
from boxkit.sources import logs as L


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_habcam_both_layouts(spark, tmp_path):
    put(tmp_path / "a.csv", '201503.png 185 live_scallop boundingBox 458 970 521 1021\n201504.png 527 201501 line 0 0 6 8\nbad line\n\n201505.png 158 crab point 100 200\n201506.png 9 x circle 0 0 0 10\n')
    put(tmp_path / "b.csv", 'Image,Species,Name,Place\n201507.png,527,dead scallop (old),"""line"": [[458, 970], [458, 980]]"\n201508.png,533,fish,"""point"": [[5, 6]]"\n201509.png,1,x,"""boundingBox"": [[1, 2], [3, 4]]"\n')
    d = {r.frame_name: r for r in L.read_habcam(spark, str(tmp_path)).collect()}
    box = {k: (r.cls, r.x1, r.y1, r.x2, r.y2) for k, r in d.items()}
    assert box == {
        "201503.png": ("live_scallop", 458, 970, 521, 1021), "201504.png": ("201501", -2, -1, 8, 9), "201505.png": ("crab", 50, 150, 150, 250), "201506.png": ("x", -5, 0, 5, 10),
        "201507.png": ("dead_scallop_old", 453, 970, 463, 980), "201508.png": ("fish", -45, -44, 55, 56), "201509.png": ("x", 1, 2, 3, 4),
    }
    by = {r.frame_name: r.cls for r in L.read_habcam(spark, str(tmp_path), "table", 1.0).collect()}
    assert by["201503.png"] == "live_scallop(185)" and by["201504.png"] == "(527)" and by["201505.png"] == "crab(158)"
    assert {r.cls for r in L.read_habcam(spark, str(tmp_path), "number").collect()} == {"185", "527", "158", "9", "533", "1"}


def test_oceaneyes_versions_by_header(spark, tmp_path):
    put(tmp_path / "one.csv", 'filename,a,b,c,species,e,fish,sure,h,i,valid,head x,head y,tail x,tail y\n# note\nim.1.jpg,,,,cod,,0.3,0.7,,,yes,"(10"," 20)","(20"," 30)"\nim.2.jpg,,,,no fish,,0.3,0.7,,,no,,,,\nim.3.jpg,,,,,,0,0,,,no,0,0,100,1\nim.4.jpg,,,,cod,,1,1,,,yes,5,5,5,9\n')
    put(tmp_path / "two.csv", 'filename,"photo location",b,c,species,x,y,x,y\nim.5.jpg,,,,hake,0,0,10,10\n')
    put(tmp_path / "three.csv", "photo location,filename,b,c,d,species,f,g,sure,i,j,valid,x,y,x,y\nsea,im.6.png,,,,eel,,,0.4,,,no,0,0,1,100\n")
    d = {r.frame_name: r for r in L.read_oceaneyes(spark, str(tmp_path)).collect()}
    assert sorted(d) == ["im.1", "im.3", "im.5", "im.6"]
    a = d["im.1"]
    assert (a.cls, a.conf, a.x1, a.y1, a.x2, a.y2, a.keypoints["tail"].y) == ("cod", 0.7, 8.5, 18.5, 21.5, 31.5, 30)
    b = d["im.3"]  # wider than allowed: the height follows
    assert (b.cls, b.conf, b.keypoints) == ("other", 0.1, None) and math.isclose(b.y2 - b.y1, 130 / 2.25) and math.isclose(b.x2 - b.x1, 130)
    assert (d["im.5"].cls, d["im.5"].conf, d["im.5"].keypoints["head"].x) == ("hake", 1.0, 0)
    c = d["im.6"]
    assert (c.cls, c.conf) == ("eel", 0.4) and math.isclose(c.x2 - c.x1, 130 / 2.25) and math.isclose(c.y1, -15)


def test_flight_log_by_names(spark, tmp_path):
    put(tmp_path / "day1.csv", 'utc_time,frame_count,lat,lat_ns,lon,lon_ew,elevation_m,roll,pitch,yaw,site_name,pass\n2024-07-08 20:37:46 +0000,7,5530.5,N,16015.0,W,250,1,2,3, Hill ,2\n2024-07-08 20:37:40 +0000,7,3330.0,S,15115.0,E,,x,,,,\n,8,abc,N,1,W,,,,,,\n,0,5530.5,N,1,W,,,,,,\n,,5530.5,N,1,W,,,,,,\n2024-07-08 12:00:00 -0800,9,"5500.0",n,16000.0,w,1,,,,"A, B",z\n')
    put(tmp_path / "day2.csv", "lon,lat,frame_count\n16000.0,5500.0,7\n")
    d = {(r.seq, r.frame): r for r in L.read_flightlog(spark, str(tmp_path)).collect()}
    assert sorted(d) == [("day1", 7), ("day1", 9), ("day2", 7)]
    r = d["day1", 7]  # the last row in the file, though its time is earlier
    assert (r.lat, r.lon, r.alt_agl, r.roll, r.site, r.pass_no, str(r.time_utc)) == (-33.5, 151.25, None, None, None, 1, "2024-07-08 20:37:40")
    r = d["day1", 9]
    assert (r.lat, r.lon, r.site, r.pass_no, str(r.time_utc)) == (55.0, -160.0, "A, B", 1, "2024-07-08 20:00:00")
    assert (d["day2", 7].lat, d["day2", 7].lon, d["day2", 7].time_utc) == (55.0, 160.0, None)


def test_image_log(spark, tmp_path):
    pose = lambda k, **more: {"trigger_index": k, "lat": 55.5, "lon": -160.25, "alt": 30.0, "roll": 0.0, "pitch": math.pi / 2, "yaw": -math.pi / 2, "extra": [1]} | more
    put(tmp_path / "s1" / "imagelog.json", json.dumps({"ImageLog": [pose(2), pose(1, lat=None), pose(3, yaw=None, alt=None)]}, indent=1))
    put(tmp_path / "s1" / "imagelog (2).json", json.dumps([pose(9)]))
    put(tmp_path / "s1" / "other.json", json.dumps([pose(10)]))
    got = sorted((r.trigger, r.lat, r.lon, r.alt_agl, r.pitch, r.yaw) for r in L.read_imagelog(spark, str(tmp_path)).collect())
    assert got == [(2, 55.5, -160.25, 30.0, 90.0, 270.0), (3, 55.5, -160.25, None, 90.0, None), (9, 55.5, -160.25, 30.0, 90.0, 270.0)]


def test_homography_records(spark, tmp_path):
    """Records as they are written, with gaps, a missing name and blank lines too many; cut into small splits."""
    one = "a{0}.png\nb{0}.png\n1 0 {0}\n0 1 -2.5e-3\n0 0 1\n\n"
    put(tmp_path / "in" / "list.txt", "".join(one.format(k) for k in range(300)) + "x.png\ny.png\n[no-match]\n\n\nonly.png\n2 0 0\n0 2 0\n0 0 1\n\n\n\nz.png\nw.png\n1 2\n3\n4\n\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        d = L.read_homographies(spark, str(tmp_path / "in"))
        assert d.rdd.getNumPartitions() > 5
        got = {r.from_name: (r.to_name, r.h) for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(got) == 302 and got["a299.png"] == ("b299.png", [1, 0, 299, 0, 1, -0.0025, 0, 0, 1])
    assert got["x.png"] == ("y.png", None) and got["only.png"] == (None, [2, 0, 0, 0, 2, 0, 0, 0, 1])
    rows = [(k, f"p{k}", f"q{k}", None if k % 3 == 0 else [1.5, 0.0, float(k), 0.0, 1.0, 0.1, 0.0, 0.0, 1.0]) for k in range(20)]
    df = spark.createDataFrame(rows, "place long, from_name string, to_name string, h array<double>")
    L.write_homographies(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("p0\nq0\n[no-match]\n\np1\nq1\n1.5 0.0 1.0\n0.0 1.0 0.1\n0.0 0.0 1.0\n\n")
    assert sorted((r.from_name, r.to_name, r.h) for r in L.read_homographies(spark, str(tmp_path / "out")).collect()) == sorted(x[1:] for x in rows)


@pytest.fixture()
def url(spark, tmp_path):
    at = f"jdbc:derby:memory:{tmp_path.name};create=true"
    DB.create_tracks(spark, at)
    return at


def tracks(spark, rows):
    return spark.createDataFrame([(t, f, v, 10 * f, 0.0, 0.0, 1.0, 1.0, c) for v, t, f, c in rows], "track_id long, frame_id long, video_name string, time_us long, x1 double, y1 double, x2 double, y2 double, conf double").repartition(3)


def held(spark, url, videos=None):
    return sorted((r.video_name, r.track_id, r.frame_id, r.conf) for r in DB.read_tracks(spark, url, videos).collect())


def test_database_videos_are_replaced(spark, url):
    first = [("it's", t, f, 0.5) for t in range(3) for f in range(4)] + [("b", 1, 1, 0.5)]
    DB.replace_tracks(tracks(spark, first), url)
    assert held(spark, url) == sorted(first)
    second = [("it's", 7, 0, 0.75), ("c", 1, 0, 0.1), ("c", 1, 0, 0.9)]  # two rows of one track and frame
    DB.replace_tracks(tracks(spark, second), url)
    assert held(spark, url) == [("b", 1, 1, 0.5), ("c", 1, 0, 0.9), ("it's", 7, 0, 0.75)]
    d = DB.read_tracks(spark, url, ["it's", "b"])
    assert d.rdd.getNumPartitions() == 2 and held(spark, url, ["it's", "b"]) == [("b", 1, 1, 0.5), ("it's", 7, 0, 0.75)]
    DB.replace_tracks(tracks(spark, second).limit(0), url)
    assert len(held(spark, url)) == 3


def test_database_failed_write_leaves_the_old_rows(spark, url):
    old = [("a", 1, 1, 0.5), ("b", 1, 1, 0.5)]
    DB.replace_tracks(tracks(spark, old), url)
    broken = tracks(spark, [("a", 2, f, 0.5) for f in range(50)]).withColumn("x1", F.when(F.col("frame_id") < 49, F.col("x1")))
    with pytest.raises(Exception):  # noqa: B017  the database refuses a null: a task fails
        DB.replace_tracks(broken, url)
    assert held(spark, url) == old
    with pytest.raises(Exception):  # noqa: B017  the second statement of the transaction fails
        DB._execute(spark, url, ["DELETE FROM OBJECT_TRACK", "INSERT INTO OBJECT_TRACK (TRACK_ID) VALUES (1)"])
    assert held(spark, url) == old
    tables = spark.read.jdbc(url, "(SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLENAME LIKE 'STAGED%') t")
    assert tables.count() == 0


def test_curves_let_the_confident_choose(spark):
    """A weak box of more overlap loses the truth to a confident one; matching by overlap would count the other way round."""
    schema = "seq_id long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls string"
    box = lambda i, x, c: (0, 0, i, float(x), 0.0, x + 10.0, 10.0, c, "A")
    c, t = spark.createDataFrame([box(1, 2, 0.9), box(2, 0, 0.4)], schema), spark.createDataFrame([box(10, 0, 1.0)], schema)
    curve = lambda pairs: {r.conf: (r.tp, r.fp) for r in scoring.pr_curve(c, t, pairs, ["seq_id"]).collect()}
    assert curve(m.match_by_confidence(c, t)) == {0.9: (1, 0), 0.4: (1, 1)}
    assert curve(m.match_greedy(c, t)) == {0.9: (0, 1), 0.4: (1, 1)}


def test_auto_reads_compressed_files(spark, sf, tmp_path):
    """Files of the four formats, gzipped: as many boxes as in the plain ones."""
    from boxkit.plans import sources as P
    from boxkit.plans.views import view
    from boxkit.sources import boxes, documents

    c, t = view(spark, sf, "computed").count(), view(spark, sf, "truth").count()
    boxes.write_boxes(P._c(spark, sf), f"{tmp_path}/a", compression="gzip")
    documents.coco_files(P._c(spark, sf)).select(F.from_json("value", documents.COCO).alias("j")).select("j.*").write.option("maxRecordsPerFile", 1).option("compression", "gzip").json(f"{tmp_path}/b")
    P._dive(spark, sf, f"{tmp_path}/c", "gzip")
    P._cvat(spark, sf, f"{tmp_path}/d", "gzip")
    assert not [p for p in tmp_path.rglob("part-*") if p.suffix != ".gz"]
    got = {r.format: r["count"] for r in documents.read_auto(spark, str(tmp_path)).groupBy("format").count().collect()}
    assert got == {"csv": c, "coco": c, "dive": t, "cvat": t}
