"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of edges (a, b).

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so long chains shorten quickly. Links and labels stay in
    tables in the shared folder; the driver only sees how many labels changed.
    A node with very many links is one row of each side: its links are partly
    aggregated where they lie, and the joins are such as can be split.
    """
    e = edges.where("a <> b").select("a", "b")
    e = C.saved(e.unionByName(e.selectExpr("b AS a", "a AS b")).distinct(), "links")
    labels = C.saved(e.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS node", "least(a, m) AS root"), "labels")
    while True:
        heard = e.join(labels, e["a"] == labels["node"]).groupBy("b").agg(F.min("root").alias("heard"))
        low = labels.join(heard, labels["node"] == heard["b"]).selectExpr("node", "least(root, heard) AS root", "root AS was")
        low = C.saved(low, "labels")
        jump = low.selectExpr("node AS at", "root AS there")
        new = C.saved(low.join(jump, low["root"] == jump["at"]).selectExpr("node", "least(root, there) AS root", "was"), "labels")
        C.drop(labels, low)
        if not new.where("root < was").limit(1).count():
            C.drop(e)
            return _with_place(new.select("node", "root"), new)
        labels = _with_place(new.select("node", "root"), new)


def _with_place(df: DataFrame, of: DataFrame) -> DataFrame:
    df.saved_at = of.saved_at
    return df
