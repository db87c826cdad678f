"""Connected components of links, by labels that spread in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """node and root (its smallest reachable node) of edges (a, b); lineage is cut each round."""
    e = edges.where("a <> b").select("a", "b")
    e = stored(e.unionByName(e.selectExpr("b AS a", "a AS b")).distinct())
    labels = stored(e.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS node", "least(a, m) AS root"))
    while True:
        heard = e.join(labels.select("node", "root"), F.col("a") == F.col("node")).groupBy("b").agg(F.min("root").alias("heard"))
        low = stored(labels.select("node", "root").join(heard, F.col("node") == F.col("b")).selectExpr("node", "least(root, heard) AS root", "root AS was"))
        jump = low.selectExpr("node AS at", "root AS there")
        new = stored(low.join(jump, F.col("root") == F.col("at")).selectExpr("node", "least(root, there) AS root", "was"))
        drop(labels, low)
        if new.where("root < was").isEmpty():
            drop(e)
            return new.select("node", "root")
        labels = new
