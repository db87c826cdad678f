"""Tables of boxes, tracks, descriptors, frames and images, derived from the base tables.

The texts run unchanged on Spark and on DuckDB, so queries and their SQL start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "truth": """
SELECT l_orderkey % 8 AS seq_id, CAST(floor(l_orderkey / 8.0) AS BIGINT) AS frame_id,
       l_orderkey * 10 + l_linenumber AS det_id,
       l_linenumber + 10 * CAST(floor(floor(l_orderkey / 8.0) / 25.0) AS BIGINT) AS track_id,
       CAST(20 * l_linenumber + 2 * (CAST(floor(l_orderkey / 8.0) AS BIGINT) % 25) AS DOUBLE) AS x1,
       50.0 + l_quantity AS y1,
       CAST(60 + 25 * l_linenumber + 2 * (CAST(floor(l_orderkey / 8.0) AS BIGINT) % 25) AS DOUBLE) AS x2,
       110.0 + l_quantity AS y2, CAST(1.0 AS DOUBLE) AS conf, l_returnflag AS cls,
       l_partkey, l_suppkey, l_linenumber, l_discount, l_tax
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn
      FROM lineitem) q
WHERE rn = 1""",
    "computed": """
SELECT seq_id, frame_id, det_id + 1000000000 * v AS det_id,
       CASE WHEN v = 1 THEN track_id + 200000 WHEN l_partkey % 97 = 0 THEN track_id + 100000 ELSE track_id END AS track_id,
       x1 + CASE WHEN v = 1 THEN CAST(2000 AS DOUBLE) ELSE 100.0 * l_discount END AS x1,
       CASE WHEN v = 1 THEN y1 ELSE y1 + 100.0 * l_tax END AS y1,
       x2 + CASE WHEN v = 1 THEN CAST(2000 AS DOUBLE) ELSE 100.0 * l_discount END AS x2,
       CASE WHEN v = 1 THEN y2 ELSE y2 + 100.0 * l_tax END AS y2,
       CAST(CASE WHEN v = 1 THEN 300 + (l_partkey * 13 + l_linenumber) % 400
            ELSE 500 + (l_suppkey * 37 + l_partkey * 11 + l_linenumber * 7) % 500 END AS DOUBLE) / CAST(1000 AS DOUBLE) AS conf,
       CASE WHEN v = 0 AND l_suppkey % 17 = 0 THEN 'X' ELSE cls END AS cls
FROM truth CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 AS v) k
WHERE (v = 0 AND l_partkey % 10 <> 0) OR (v = 1 AND l_partkey % 13 = 0)""",
    "regions": """
SELECT DISTINCT seq_id, frame_id, CAST(30 AS DOUBLE) AS x1, CAST(40 AS DOUBLE) AS y1,
       CAST(90 AS DOUBLE) AS x2, CAST(160 AS DOUBLE) AS y2,
       CASE WHEN frame_id % 2 = 0 THEN 'suppress' ELSE 'borderline' END AS cls
FROM truth WHERE frame_id % 3 = 0""",
    "descriptors": """
SELECT CAST(vec_id AS VARCHAR(32)) AS uid, concat('video_', CAST(label AS VARCHAR(32))) AS video,
       label, embedding AS vec
FROM embeddings""",
    "frames": """
SELECT user_id % 4 AS stream_id, event_id AS frame_id, ts, value AS change_score, event_type AS modality
FROM events""",
    "images": """
SELECT user_id % 5 AS site, event_id AS frame,
       CASE WHEN user_id % 3 = 0 THEN 'CENTER' WHEN user_id % 3 = 1 THEN 'PORT' ELSE 'STAR' END AS camera,
       1 + event_id % 2 AS pass_no,
       CAST(55.0 + 0.0005 * (event_id % 40) AS DOUBLE) AS lat,
       CAST(-160.0 + 0.0005 * (user_id % 40) AS DOUBLE) AS lon,
       CAST(250 AS DOUBLE) AS alt_agl, ts AS time_utc
FROM events""",
    "synonyms": """
SELECT 'A' AS alias, 'fish' AS canonical UNION ALL SELECT 'N', 'fish' UNION ALL SELECT 'R', 'scallop'""",
}
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _needs(sql: str) -> list[str]:
    """The views that a text names, each after those that it needs itself."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            out += [x for x in [*_needs(VIEWS[name]), name] if x not in out]
    return out


def with_views(sql: str) -> str:
    """The text with the views that it names, for DuckDB."""
    needed = _needs(sql)
    if not needed:
        return sql
    head = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(word):
            return f"{word}{head}, {body[len(word):]}"
    return f"WITH {head} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, or a base table."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    needed = {t: view(spark, sf_dir, t) for t in [*VIEWS, *BASE] if re.search(rf"(?:FROM|JOIN) {t}\b", sql)}
    for t in needed:
        sql = re.sub(rf"((?:FROM|JOIN) ){t}\b", rf"\1{{{t}}}", sql)
    return spark.sql(sql, **needed)
