"""Readers of survey files: annotations of two projects, position logs of flights and images, lists of homographies.

Files are told apart by their path, so whole trees are read at once; what a
header says about a file is joined to its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import nmea_degrees
from .boxes import COMMA, number, seq

# Fixed values of the formats.
NO_FISH, EXPANSION, MOST_ASPECT = "no fish", 0.30, 2.25
#: By version of the header: places of image name, species, confidences, validity (null: always) and the first of the four numbers of head and tail.
OCEANEYES = {1: (0, 4, (6, 7), 10, 11), 2: (0, 4, (), None, 5), 3: (1, 5, (8,), 11, 12)}
#: Classes of species numbers.
HABCAM_SPECIES = {
    185: "live_scallop", 197: "live_scallop", 207: "live_scallop", 211: "live_scallop", 515: "live_scallop", 912: "live_scallop", 919: "live_scallop", 920: "live_scallop",
    188: "dead_scallop", 403: "sand_eel", 524: "skate", 533: "fish", 1003: "fish", 1001: "fish", 158: "crab", 258: "crab",
}
NO_MATCH = "[no-match]"


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, at (the place of a line in its file) and value of all lines below a path."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), seq().alias("seq"), at.alias("at"), "value")


def read_oceaneyes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes around head and tail points, widened, with limited aspect; the version of a file is told by its header.

    seq, frame_name (without extension), cls, conf, box, and the points where they are valid; rows without fish, with
    points of no extent or without numbers are left out.
    """
    d = file_lines(spark, path).where("value <> '' AND NOT value LIKE '#%'").withColumn("f", F.split("value", ",", -1))
    first = F.col("f")[0]
    version = F.when(first == "photo location", 3).when((first == "filename") & F.col("value").contains('"photo location"'), 2).when(first == "filename", 1)
    heads = d.where(version.isNotNull()).groupBy("file").agg(F.max(version).alias("version"))
    d = d.where(version.isNull()).join(heads, "file", "left").withColumn("version", F.coalesce("version", F.lit(1)))
    by = lambda pick: F.coalesce(*(F.when(F.col("version") == v, pick(p)) for v, p in OCEANEYES.items()))
    at = lambda k: F.get("f", F.lit(k))
    point = lambda k: number(F.regexp_replace(by(lambda p: at(p[4] + k)), '[()" ]', ""))
    conf = by(lambda p: F.greatest(*(number(F.trim(at(k))) for k in p[2])) if len(p[2]) > 1 else number(F.trim(at(p[2][0]))) if p[2] else F.lit(1.0))
    valid = by(lambda p: F.lit(True) if p[3] is None else at(p[3]) == "yes")
    d = d.select("seq", F.regexp_replace(by(lambda p: at(p[0])), r"\.[^.]*$", "").alias("frame_name"), by(lambda p: at(p[1])).alias("species"), conf.alias("c"), valid.alias("valid"), *(point(k).alias(n) for k, n in enumerate(("hx", "hy", "tx", "ty"))))
    d = d.where(F.col("species").isNotNull() & (F.col("species") != NO_FISH) & F.col("c").isNotNull())
    w, h = (F.abs(F.col(f"h{k}") - F.col(f"t{k}")) * (1 + EXPANSION) for k in "xy")
    d = d.withColumn("w0", w).withColumn("h0", h).where("w0 > 0 AND h0 > 0")
    d = d.withColumn("w", F.when(F.col("h0") / F.col("w0") > MOST_ASPECT, F.col("h0") / MOST_ASPECT).otherwise(F.col("w0")))
    d = d.withColumn("h", F.when(F.col("w") / F.col("h0") > MOST_ASPECT, F.col("w") / MOST_ASPECT).otherwise(F.col("h0")))
    box = [((F.col(f"h{k}") + F.col(f"t{k}")) / 2 + s * F.col(e) / 2).alias(f"{k}{n}") for n, s in ((1, -1), (2, 1)) for k, e in (("x", "w"), ("y", "h"))]
    cls, conf = F.when(F.col("species") == "", "other").otherwise(F.col("species")), F.when(F.col("c") == 0, 0.1).otherwise(F.col("c"))
    ends = F.when(F.col("valid"), F.create_map(F.lit("head"), F.struct(F.col("hx").alias("x"), F.col("hy").alias("y")), F.lit("tail"), F.struct(F.col("tx").alias("x"), F.col("ty").alias("y"))))
    return d.select("seq", "frame_name", cls.alias("cls"), conf.alias("conf"), *box, ends.alias("keypoints"))


def read_habcam(spark: SparkSession, path: str, labels: str = "name", dilation: float = 50.0) -> DataFrame:
    """Lines of image, species number, label, kind and numbers, separated by blanks, or by commas with the numbers in brackets.

    labels: what becomes the class: the label ("name"), the number ("number") or the class of the number with it in
    brackets ("table"). Kinds: boundingBox (corners), line and circle (a square around the middle of two points, as
    wide as they lie apart), point (a square of half-width ``dilation``). The kind may take the place of the label.
    """
    d = file_lines(spark, path).where("value <> '' AND NOT value LIKE 'Image,%'")
    comma = F.col("value").contains(",")
    plain = F.when(comma, F.regexp_replace("value", r'[\[\]":]', "")).otherwise(F.regexp_replace("value", '"', ""))
    parts = F.filter(F.split(plain, F.when(comma, F.lit(",")).otherwise(F.lit(" "))), lambda x: x != "")
    d = d.select("seq", comma.alias("comma"), parts.alias("p")).where(F.size("p") >= 4)
    split = F.filter(F.split(F.get("p", F.lit(3)), " "), lambda x: x != "")
    d = d.withColumn("f", F.when(F.col("comma"), F.concat(F.slice("p", 1, 3), split, F.slice("p", 5, 1000))).otherwise(F.col("p")))
    d = d.where(~F.col("comma") | (F.size(split) == 2))
    kinds = ("boundingBox", "line", "circle", "point")
    at = F.when(F.get("f", F.lit(3)).isin(*kinds), 4).when(F.get("f", F.lit(2)).isin(*kinds), 3)
    d = d.withColumn("at", at).where("at IS NOT NULL").withColumn("kind", F.get("f", F.col("at") - 1))
    a, b, c, e = (number(F.trim(F.get("f", F.col("at") + k))) for k in range(4))
    species = F.trim(F.get("f", F.lit(1)))
    table = F.create_map(*(F.lit(x) for kv in HABCAM_SPECIES.items() for x in (str(kv[0]), kv[1])))
    cls = {"name": F.regexp_replace(F.regexp_replace(F.get("f", F.lit(2)), " ", "_"), "[()]", ""), "number": F.get("f", F.lit(1)), "table": F.concat(F.coalesce(F.get(F.array(table), F.lit(0))[species], F.lit("")), F.lit("("), species, F.lit(")"))}[labels]
    d = d.select("seq", F.col("f")[0].alias("frame_name"), species.try_cast("long").alias("species_id"), cls.alias("cls"), "kind", a.alias("a"), b.alias("b"), c.alias("c"), e.alias("e"))
    d = d.where("a IS NOT NULL AND b IS NOT NULL AND (kind = 'point' OR (c IS NOT NULL AND e IS NOT NULL))")
    box, point = F.col("kind") == "boundingBox", F.col("kind") == "point"
    half = F.when(point, F.lit(dilation)).otherwise(F.sqrt((F.col("a") - F.col("c")) ** 2 + (F.col("b") - F.col("e")) ** 2) / 2)
    cx, cy = F.when(point, F.col("a")).otherwise((F.col("a") + F.col("c")) / 2), F.when(point, F.col("b")).otherwise((F.col("b") + F.col("e")) / 2)
    corner = lambda own, centre, s: F.when(box, F.col(own)).otherwise(centre + s * half)
    return d.select("seq", "frame_name", "species_id", "cls", corner("a", cx, -1).alias("x1"), corner("b", cy, -1).alias("y1"), corner("c", cx, 1).alias("x2"), corner("e", cy, 1).alias("y2"))


def read_flightlog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of flight logs by the names in each file's header: seq, frame, time_utc, position in degrees, height, attitude, site and pass.

    Positions are ddmm.mm with N, S, E or W beside them; the last row of a frame in its file counts. Rows without a frame
    number over 0 or without a position are left out; a missing pass is 1.
    """
    d = file_lines(spark, path).withColumn("f", F.transform(F.split("value", COMMA, -1), lambda x: F.trim(F.regexp_replace(x, r'^\s*"|"\s*$', ""))))
    head = F.array_contains("f", "frame_count")
    names = d.where(head).groupBy("file").agg(F.min_by("f", "at").alias("names"))
    d = d.where(~head).join(names, "file")

    def of(name: str) -> Column:
        v = F.get("f", F.array_position("names", F.lit(name)).cast("int") - 1)
        return F.when(v != "", v)

    clock = "yyyy-MM-dd HH:mm:ss Z"
    t = F.regexp_replace(of("utc_time"), r"([+-]\d\d):(\d\d)$", "$1$2")
    time = F.coalesce(F.try_to_timestamp(t, F.lit(clock)), F.try_to_timestamp(F.concat(t, F.lit(" +0000")), F.lit(clock)))
    side = lambda c, other: F.when(F.upper(of(c)) == other, -1.0).otherwise(1.0)
    row = {
        "frame": of("frame_count").try_cast("long"), "time_utc": time, "lat": nmea_degrees(number(of("lat"))) * side("lat_ns", "S"), "lon": nmea_degrees(number(of("lon"))) * side("lon_ew", "W"),
        "alt_agl": number(of("elevation_m")), "roll": number(of("roll")), "pitch": number(of("pitch")), "yaw": number(of("yaw")), "site": of("site_name"), "pass_no": F.coalesce(of("pass").try_cast("int"), F.lit(1)),
    }
    d = d.select("seq", "at", *(c.alias(k) for k, c in row.items())).where("frame > 0 AND lat IS NOT NULL AND lon IS NOT NULL")
    last = F.max_by(F.struct(*list(row)[1:]), "at")
    return d.groupBy("seq", "frame").agg(last.alias("r")).select("seq", "frame", "r.*")


_POSE = "lat DOUBLE, lon DOUBLE, alt DOUBLE, roll DOUBLE, pitch DOUBLE, yaw DOUBLE, trigger_index LONG, time_utc STRING"


def read_imagelog(spark: SparkSession, path: str, names: str = "imagelog*.json") -> DataFrame:
    """Poses of image logs: files of one object with a list ``ImageLog``, or of a list; positions in degrees, angles in radians.

    seq, trigger, lat, lon, alt_agl, and roll, pitch and yaw in degrees; records without a position are left out. names:
    which files of a folder are logs.
    """
    pose = _POSE.replace("DOUBLE", ": DOUBLE").replace("LONG", ": LONG").replace("STRING", ": STRING")
    d = spark.read.schema(f"ImageLog ARRAY<STRUCT<{pose}>>, {_POSE}").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", names).json(path)
    own = F.array(F.struct(*(p.split()[0] for p in _POSE.split(", "))))
    d = d.select(seq().alias("seq"), F.explode(F.coalesce("ImageLog", own)).alias("r")).select("seq", "r.*").where("lat IS NOT NULL AND lon IS NOT NULL")
    turned = [F.degrees("roll").alias("roll"), F.degrees("pitch").alias("pitch"), F.pmod(F.degrees("yaw"), F.lit(360.0)).alias("yaw")]
    return d.select("seq", F.col("trigger_index").alias("trigger"), "lat", "lon", F.col("alt").alias("alt_agl"), *turned, "time_utc")


def write_homographies(df: DataFrame, path: str, no_match: str = NO_MATCH) -> None:
    """Records of (from_name, to_name, h) in the order of ``place``: two names, three rows of the matrix or the word for none, a blank line.

    seq, if there, names the folder of a file. Files are cut between records only.
    """
    rows = F.concat_ws("\n", *(F.concat_ws(" ", *(F.get("h", F.lit(3 * r + c)).cast("string") for c in range(3))) for r in range(3)))
    value = F.concat_ws("\n", "from_name", "to_name", F.when(F.col("h").isNull(), no_match).otherwise(rows))
    d = df.repartitionByRange("seq", "place").sortWithinPartitions("seq", "place") if "seq" in df.columns else df.repartitionByRange("place").sortWithinPartitions("place")
    out = d.select(*(["seq"] if "seq" in df.columns else []), value.alias("value")).write.mode("overwrite").option("lineSep", "\n\n")
    (out.partitionBy("seq") if "seq" in df.columns else out).text(path)


def read_homographies(spark: SparkSession, path: str, no_match: str = NO_MATCH) -> DataFrame:
    """seq, from_name, to_name and h (nine values, null where there was no match) of records between blank lines.

    A record is read as one row by the blank line that ends it, so large files are split between tasks safely. A name may
    be missing: then the one there is that of the source.
    """
    d = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n\n").text(path).select(seq().alias("seq"), F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("f"))
    none = F.try_element_at("f", F.lit(-1)) == no_match
    d = d.where(F.size("f") > 0).withColumn("tail", F.when(none, 1).otherwise(3)).where(F.size("f") >= F.col("tail"))
    h = F.transform(F.split(F.concat_ws(" ", F.slice(F.col("f"), -3, 3)), r"\s+"), lambda x: number(x))
    head = F.size("f") - F.col("tail")
    name = lambda k: F.when(head > k, F.get("f", F.lit(k)))
    d = d.select("seq", name(0).alias("from_name"), name(1).alias("to_name"), none.alias("none"), F.when(~none, h).alias("h"))
    return d.where("none OR (size(h) = 9 AND forall(h, x -> x IS NOT NULL))").drop("none")
