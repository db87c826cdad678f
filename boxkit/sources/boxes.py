"""Readers and writers of annotation files: a whole tree of files becomes one table.

The sequence is that of the folder seq_name=... as writers name it, else the name
of the file without extension. Lines are split inside Spark; no file is opened
outside its readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A comma outside double quotes.
COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
#: A comma and the field after it, in which double quotes hide commas; linear in the length of a line.
FIELD = r',((?:[^,"]++|"[^"]*+")*+)'


def seq() -> Column:
    path = F.col("_metadata.file_path")
    return F.coalesce(F.nullif(F.regexp_extract(path, "/seq_name=([^/]+)/", 1), F.lit("")), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def fields(c: Column) -> Column:
    """The fields between commas outside double quotes, as split(c, COMMA) gives them.

    That looks from each comma to the end of the line, which is left to lines with an odd number of quotes.
    """
    quotes = F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))
    quoted = F.when(quotes % 2 == 0, F.regexp_extract_all(F.concat(F.lit(","), c), F.lit(FIELD), F.lit(1))).otherwise(F.split(c, COMMA))
    return F.when(c.contains('"'), quoted).otherwise(F.split(c, ","))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """seq and value of all lines of the files below a path."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(seq().alias("seq"), "value")


def number(c: Column) -> Column:
    return c.try_cast("double")


def read_boxes(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of: id, frame name, frame, x1, y1, x2, y2, confidence, length, class and score pairs, tagged attributes.

    strict: confidence -1 becomes 1. Otherwise values stay raw, a row without class is 'unknown',
    and rows that are malformed or not finite are left out (see rejects()).
    """
    d = lines(spark, path).where("NOT value LIKE '#%' AND trim(value) <> ''")
    # a filter below explode() splits a line once; where() on the fields would split it again for each use of them
    return _fields(d.select("seq", F.explode(F.filter(F.array(fields(F.col("value"))), _well_formed)).alias("f")), strict)


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines that read_boxes() leaves out."""
    d = lines(spark, path).where("NOT value LIKE '#%' AND trim(value) <> ''")
    bad = F.filter(F.array(fields(F.col("value"))), lambda f: ~_well_formed(f))
    return d.select("seq", "value", F.explode(bad)).select("seq", "value")


def _well_formed(f: Column) -> Column:
    finite = F.forall(F.slice(f, 4, 5), lambda x: F.coalesce(F.abs(number(x)) < float("inf"), F.lit(False)))  # NaN is above all numbers
    whole = lambda i: F.get(f, F.lit(i)).try_cast("long").isNotNull()
    return (F.size(f) >= 9) & whole(0) & whole(2) & finite


def _fields(d: DataFrame, strict: bool) -> DataFrame:
    tail = F.expr("slice(f, 10, size(f))")
    d = d.withColumn("tail", tail).withColumn("stop", F.expr("coalesce(array_min(filter(transform(tail, (x, i) -> IF(trim(x) = '' OR trim(BOTH ' \"' FROM x) LIKE '(%', i, NULL)), x -> x IS NOT NULL)), size(tail))"))
    pairs = F.expr("transform(sequence(0, greatest(stop DIV 2 - 1, 0)), i -> named_struct('name', trim(get(tail, i * 2)), 'score', try_cast(get(tail, i * 2 + 1) AS DOUBLE)))")
    d = d.withColumn("scores", F.when(F.col("stop") >= 2, F.filter(pairs, lambda p: p["score"].isNotNull())).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<name: STRING, score: DOUBLE>>)")))
    tags = F.expr("filter(transform(tail, x -> trim(BOTH ' \"' FROM x)), x -> x LIKE '(%')")
    attrs = F.expr("map_from_entries(array_distinct(transform(filter(tags, x -> x LIKE '(atr) %'), x -> named_struct('k', split(x, ' ')[1], 'v', substring(x, length(split(x, ' ')[1]) + 8)))))")
    d = d.withColumn("tags", tags)
    conf = number(F.get("f", F.lit(7)))
    best = F.expr("array_max(transform(scores, (p, i) -> named_struct('s', p.score, 'i', -i, 'name', p.name)))")
    c = lambda i, n: number(F.get("f", F.lit(i))).alias(n)
    return d.select(
        "seq",
        F.get("f", F.lit(0)).cast("long").alias("track_id"),
        F.trim(F.get("f", F.lit(1))).alias("frame_name"),
        F.get("f", F.lit(2)).cast("long").alias("frame_id"),
        c(3, "x1"), c(4, "y1"), c(5, "x2"), c(6, "y2"),
        (F.when(conf == -1, 1.0).otherwise(conf) if strict else conf).alias("conf"),
        c(8, "length"),
        "scores",
        (best["name"] if strict else F.coalesce(best["name"], F.lit("unknown"))).alias("cls"),
        best["s"].alias("cls_score"),
        attrs.alias("attrs"),
        F.expr("transform(filter(tags, x -> x LIKE '(note) %'), x -> substring(x, 8))").alias("notes"),
        F.expr("transform(filter(tags, x -> x LIKE '(poly) %'), x -> transform(slice(split(x, ' '), 2, 9999), v -> CAST(v AS DOUBLE)))").alias("polygons"),
        F.expr("map_from_entries(transform(filter(tags, x -> x LIKE '(kp) %'), x -> named_struct('k', split(x, ' ')[1], 'v', named_struct('x', CAST(split(x, ' ')[2] AS DOUBLE), 'y', CAST(split(x, ' ')[3] AS DOUBLE)))))").alias("keypoints"),
    )


def box_lines(df: DataFrame, top: int = 0, stream: str | None = None) -> DataFrame:
    """seq and the line of each row; df: seq, track_id, frame_name, frame_id, x1..y2, conf, length, scores, attrs,
    and, where it has them, notes, polygons and keypoints as read_boxes() gives them. stream: written in place of the frame name.
    """
    tagged = lambda c, f: F.array_join(F.transform(c, f), ",")
    numbers = lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), " ")
    more = {
        "notes": lambda c: tagged(c, lambda x: F.concat(F.lit('"(note) '), F.regexp_replace(x, '"', ""), F.lit('"'))),
        "polygons": lambda c: tagged(c, lambda v: F.concat(F.lit("(poly) "), numbers(v))),
        "keypoints": lambda c: tagged(F.map_entries(c), lambda e: F.concat(F.lit("(kp) "), e["key"], F.lit(" "), e["value"]["x"].cast("string"), F.lit(" "), e["value"]["y"].cast("string"))),
    }
    more = [f(F.col(k)) for k, f in more.items() if k in df.columns]
    df = df if stream is None else df.withColumn("frame_name", F.lit(stream))
    scores = F.array_sort("scores", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    scores = F.slice(scores, 1, top) if top else scores
    pairs = F.array_join(F.transform(scores, lambda p: F.concat(p["name"], F.lit(","), p["score"].cast("string"))), ",")
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit("(atr) "), e["key"], F.lit(" "), e["value"])), ",")
    base = F.concat_ws(",", *(F.col(k).cast("string") for k in ("track_id", "frame_name", "frame_id", "x1", "y1", "x2", "y2", "conf", "length")))
    some = lambda c: F.when(F.length(c) > 0, c)
    return df.select("seq", "frame_id", F.concat_ws(",", base, some(pairs), some(attrs), *(some(x) for x in more)).alias("value"))


def write_boxes(df: DataFrame, path: str, fps: float | None = None, top: int = 0, stream: str | None = None, model: str | None = None, version: str | None = None, frames_per_file: int = 100_000, compression: str = "none") -> None:
    """Files of lines below path/seq_name=..., in order of frames, each with a header of comments.

    A sequence is one file as long as it has no more than frames_per_file frames; a longer one is a file for each so many.
    compression: none, or gzip or another codec of Spark's text files.
    """
    part = lambda c: F.floor(c / frames_per_file)
    out = box_lines(df, top, stream).withColumn("part", part(F.col("frame_id")))
    meta = "".join(f", {k}: {v}" for k, v in (("fps", fps), ("model", model), ("version", version)) if v)
    head = df.select("seq", part(F.col("frame_id")).alias("part")).distinct().select("seq", F.lit(-1).cast("long").alias("frame_id"), F.lit("# 1: Detection or Track-id, 2: Video or Image Identifier, 3: Unique Frame Identifier" + meta).alias("value"), "part")
    out = out.unionByName(head).repartition("seq", "part").sortWithinPartitions("seq", "part", "frame_id", "value")
    out.select(F.col("seq").alias("seq_name"), "value").write.mode("overwrite").option("compression", compression).partitionBy("seq_name").text(path)


def header_fps(spark: SparkSession, path: str) -> DataFrame:
    """file, seq and the frame rate in each file's comments, null (unlisted) where there is none."""
    d = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), seq().alias("seq"), "value")
    v = F.when(F.col("value").startswith("#"), F.regexp_extract("value", r"(?i)fps[:=]\s*([0-9.]+)", 1).try_cast("double"))
    return d.groupBy("file", "seq").agg(F.max(v).alias("fps"))


def read_columns(spark: SparkSession, path: str, names: list[str], sep: str = " +") -> DataFrame:
    """Lines of separated columns, by name; comments are skipped. For fixed layouts such as the 19 columns of track files."""
    d = lines(spark, path).where("NOT value LIKE '#%' AND trim(value) <> ''")
    # for blanks a plain split, since a pattern is compiled for each line; split once, as in read_boxes()
    f = F.filter(F.split(F.trim("value"), " "), lambda x: x != "") if sep == " +" else F.split(F.trim("value"), sep)
    d = d.select("seq", F.explode(F.filter(F.array(f), lambda f: F.size(f) >= len(names))).alias("f"))
    return d.select("seq", *(F.col("f")[i].alias(n) for i, n in enumerate(names)))


#: The columns of the 19-column track layout.
KW18 = "track_id length frame_id track_x track_y vel_x vel_y image_x image_y x1 y1 x2 y2 area world_x world_y world_z timestamp conf".split()


def read_kw18(spark: SparkSession, path: str) -> DataFrame:
    d = read_columns(spark, path, KW18)
    return d.select("seq", F.col("track_id").cast("long").alias("track_id"), F.col("frame_id").cast("long").alias("frame_id"), *(F.col(k).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2", "conf")))


def read_yolo(spark: SparkSession, path: str, sizes: DataFrame, classes: list[str]) -> DataFrame:
    """Label lines (class, centre and size as shares of the image) with a table of image sizes (seq, img_w, img_h)."""
    d = read_columns(spark, path, ["c", "cx", "cy", "w", "h"]).join(sizes, "seq")
    n = {k: F.col(k).cast("double") for k in ("cx", "cy", "w", "h")}
    names = F.array(*(F.lit(c) for c in classes))
    return d.select("seq", F.get(names, F.col("c").cast("int")).alias("cls"), ((n["cx"] - n["w"] / 2) * F.col("img_w")).alias("x1"), ((n["cy"] - n["h"] / 2) * F.col("img_h")).alias("y1"), ((n["cx"] + n["w"] / 2) * F.col("img_w")).alias("x2"), ((n["cy"] + n["h"] / 2) * F.col("img_h")).alias("y2"))


def read_fishnet(spark: SparkSession, path: str) -> DataFrame:
    """Seven columns with the box as xmin, xmax, ymin, ymax."""
    d = spark.read.csv(path, header=True, schema="img_id string, label_l1 string, label_l2 string, x_min double, x_max double, y_min double, y_max double")
    return d.select("img_id", F.col("label_l1").alias("cls"), F.col("x_min").alias("x1"), F.col("y_min").alias("y1"), F.col("x_max").alias("x2"), F.col("y_max").alias("y2"))


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """uid,v1,v2,... per line."""
    return lines(spark, path).select(F.split("value", ",").alias("f")).select(F.col("f")[0].alias("uid"), F.transform(F.expr("slice(f, 2, size(f))"), lambda x: x.cast("float")).alias("vec"))


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """Images below a folder in order of name; of several kinds the most common extension (then the first) counts."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    d = d.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    best = d.groupBy("folder", "ext").agg(F.count("*").alias("n")).groupBy("folder").agg(F.min(F.struct((-F.col("n")).alias("k"), "ext")).alias("b")).select("folder", F.col("b.ext").alias("ext"))
    from pyspark.sql.window import Window

    return d.join(best, ["folder", "ext"]).withColumn("frame_id", F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1)
