"""User code in queries: functions by row, by frame, as aggregate, and one row to many."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from ..operators import accumulate
from ..registry import query
from .views import view, with_views


@query("udf_row", with_views("SELECT det_id, sqrt((x2 - x1) * (y2 - y1)) AS side FROM truth"))
def udf_row(spark, sf):
    @pandas_udf("double")
    def side(w: pd.Series, h: pd.Series) -> pd.Series:
        return np.sqrt(w * h)

    return view(spark, sf, "truth").select("det_id", side(F.expr("x2 - x1"), F.expr("y2 - y1")).alias("side"))


@query("udf_frame", with_views("SELECT seq_id, frame_id, det_id, conf - min(conf) OVER (PARTITION BY seq_id, frame_id) AS lead FROM computed"))
def udf_frame(spark, sf):
    """User code gets the whole frames of a stretch at once: a call for each frame costs more than its work."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(lead=pdf.conf - pdf.groupby("frame_id").conf.transform("min"))[["seq_id", "frame_id", "det_id", "lead"]]

    return view(spark, sf, "computed").select("seq_id", "frame_id", "det_id", "conf").groupBy("seq_id", F.floor(F.col("frame_id") / 500).alias("stretch")).applyInPandas(score, "seq_id long, frame_id long, det_id long, lead double")


@query("udaf_metric", with_views("SELECT seq_id, round(max(conf) - min(conf), 6) AS spread FROM computed GROUP BY seq_id"))
def udaf_metric(spark, sf):
    @pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return view(spark, sf, "computed").groupBy("seq_id").agg(F.round(spread("conf"), 6).alias("spread"))


@query("udaf_states", with_views("SELECT seq_id, count(*) AS n, round(avg(conf), 9) AS mean, round(var_pop(conf), 9) AS variance, round(max(x2 - x1) - min(x2 - x1), 6) AS spread FROM computed GROUP BY seq_id"))
def udaf_states(spark, sf):
    """A metric of the library and one of user code, as states that tasks keep and merge."""
    import numpy as np

    class Spread(accumulate.Metric):
        result = "spread double"

        def start(self):
            return np.array([np.inf, -np.inf])

        def add(self, state, rows):
            w = rows.x2 - rows.x1
            return self.merge(state, np.array([w.min(), w.max()]))

        def merge(self, a, b):
            return np.array([min(a[0], b[0]), max(a[1], b[1])])

        def finish(self, state):
            return (float(state[1] - state[0]),)

    c = view(spark, sf, "computed").select("seq_id", "conf", "x1", "x2")
    mean = accumulate.accumulate(c, ["seq_id"], "mean", column="conf")
    wide = accumulate.accumulate(c, ["seq_id"], Spread())
    return mean.join(wide, "seq_id").select("seq_id", "n", F.round("mean", 9).alias("mean"), F.round("variance", 9).alias("variance"), F.round("spread", 6).alias("spread"))


@query("udtf_tiles", "SELECT p_partkey AS id, (gx * 100)::INT AS tx, (gy * 100)::INT AS ty FROM part, range(0, 10) a(gx), range(0, 10) b(gy) WHERE gx * 100 < 150 + p_size * 5 AND gy * 100 < 120 + p_size * 3")
def udtf_tiles(spark, sf):
    @udtf(returnType="tx int, ty int")
    class Tiles:
        def eval(self, w: int, h: int, step: int):
            for x in range(0, w, step):
                for y in range(0, h, step):
                    yield x, y

    spark.udtf.register("box_tiles", Tiles)
    return spark.sql("SELECT p_partkey AS id, t.tx, t.ty FROM {p}, LATERAL box_tiles(CAST(150 + p_size * 5 AS INT), CAST(120 + p_size * 3 AS INT), 100) t", p=view(spark, sf, "part"))
