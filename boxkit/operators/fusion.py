"""Suppression and fusion of boxes of several models (columns model, cls, conf).

The greedy algorithms are folds over the boxes of one frame (and class) in
descending confidence, inside the JVM; frames are the groups, so groups stay small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import batches as together
from ..functions import box
from ..shared import drop, released, stored
from . import matching as m

FRAME = ["seq_id", "frame_id"]
_INTER = "(greatest(0D, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0D, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"


def _sql(expr: str, a: str, b: str) -> str:
    import re

    return re.sub(r"\b([ab])\.", lambda k: f"{a if k[1] == 'a' else b}.", expr)


INTER, IOU = _INTER, f"({_INTER} / ({_AREA.format('a')} + {_AREA.format('b')} - {_INTER}))"
SMALLER = f"({_INTER} / least({_AREA.format('a')}, {_AREA.format('b')}))"
RATIO = f"(greatest({_AREA.format('a')}, {_AREA.format('b')}) / least({_AREA.format('a')}, {_AREA.format('b')}))"


def _ranked(df: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    s = F.struct((-F.col("conf")).alias("k"), F.col("det_id").alias("id"), *(F.col(c) for c in (*box.names(), "conf", "cls", *extra)))
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(s)).alias("b"))


def nms(df: DataFrame, most: float, ratio: float = 1e9, keys: list[str] | None = None) -> DataFrame:
    """Boxes by falling confidence; one is dropped if a kept one covers more than ``most`` of the smaller of both and their areas are within a ratio."""
    keys = keys or FRAME
    hit = f"exists(acc, k -> {_sql(SMALLER, 'k', 'x')} > {most}D AND {_sql(RATIO, 'k', 'x')} <= {ratio}D)"
    return _ranked(df, keys).selectExpr(*keys, f"inline(aggregate(slice(b, 2, size(b)), slice(b, 1, 1), (acc, x) -> IF({hit}, acc, concat(acc, array(x)))))").drop("k").withColumnRenamed("id", "det_id")


def fuse_nms(df: DataFrame, iou: float, skip: float = 0.0, weights: dict[str, float] | None = None) -> DataFrame:
    """Per class suppression over all models; scores by model weight; boxes below ``skip`` are left out first."""
    keys = [*FRAME, "cls"]
    df = _weighted(df, weights).where(F.col("conf") >= skip)
    hit = f"exists(acc, k -> {_sql(IOU, 'k', 'x')} > {iou}D)"
    return _ranked(df, keys).selectExpr("seq_id", "frame_id", f"inline(aggregate(slice(b, 2, size(b)), slice(b, 1, 1), (acc, x) -> IF({hit}, acc, concat(acc, array(x)))))").drop("k").withColumnRenamed("id", "det_id")


def _weighted(df: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    if not weights:
        return df
    top = max(weights.values())
    w = F.coalesce(*(F.when(F.col("model") == k, v / top) for k, v in weights.items()), F.lit(1.0))
    return df.withColumn("conf", F.col("conf") * w)


def fuse_soft_nms(df: DataFrame, sigma: float = 0.5, least: float = 0.05, weights: dict[str, float] | None = None) -> DataFrame:
    """Per class: the best box left is taken, the scores of the rest fall by exp(-iou^2 / sigma), as often as there are boxes."""
    keys = [*FRAME, "cls"]
    r = _ranked(_weighted(df, weights), keys)
    return _decayed(r, f"{sigma}D").where(F.col("conf") >= least)


def _decayed(r: DataFrame, sigma: str) -> DataFrame:
    """The boxes of ranked groups with their scores when they are taken; sigma: a SQL number or the name of a key."""
    # acc.left: boxes left, as (score now, id, box); acc.out: those taken
    item = "named_struct('s', x.conf, 'id', x.id, 'x1', x.x1, 'y1', x.y1, 'x2', x.x2, 'y2', x.y2)"
    best = "array_sort(acc.left, (l, r) -> CASE WHEN l.s > r.s THEN -1 WHEN l.s < r.s THEN 1 WHEN l.id < r.id THEN -1 WHEN l.id > r.id THEN 1 ELSE 0 END)"
    decay = f"transform(slice(o, 2, size(o)), x -> named_struct('s', x.s * exp(-power({_sql(IOU, 'x', 'o[0]')}, 2) / {sigma}), 'id', x.id, 'x1', x.x1, 'y1', x.y1, 'x2', x.x2, 'y2', x.y2))"
    step = f"element_at(transform(array({best}), o -> named_struct('left', {decay}, 'out', concat(acc.out, slice(o, 1, 1)))), 1)"
    fold = f"aggregate(b, named_struct('left', transform(b, x -> {item}), 'out', slice(transform(b, x -> {item}), 1, 0)), (acc, i) -> {step}, acc -> acc.out)"
    return r.selectExpr(*(k for k in r.columns if k != "b"), f"inline({fold})").withColumnsRenamed({"s": "conf", "id": "det_id"})


def sweep(df: DataFrame, truth: DataFrame, models: list[str], ious=(0.3, 0.4, 0.5, 0.6, 0.7), sigmas=(0.1, 0.3, 0.5, 0.9), draws: int = 6, rounds: int = 2, seed: int = 0) -> DataFrame:
    """stage, method, iou, sigma, weights, ap and best: average precision of weighted and of soft fusion over parameters.

    First a grid over the overlap and sigma with equal weights, then seeded random weights of the models at the best point,
    then rounds of single steps of each weight and of the overlap or sigma from the best so far. The boxes of a frame are
    gathered once for all stages. The candidates of a stage are a key of one job, of which the driver sees one number per candidate.
    """
    import random

    rng, one = random.Random(seed), [1.0] * len(models)
    tried: list[tuple] = []
    frames, n_truth = stored(_frames(df, truth, models), "frames"), truth.count()

    def run(stage: int, candidates: list[tuple[str, float, float, list[float]]]) -> None:
        new = [c for c in candidates if not any(c == t[1:5] for t in tried)]
        if new:
            tried.extend((stage, *c, ap) for c, ap in zip(new, _tried(frames, n_truth, len(models), new), strict=True))

    def best() -> tuple:
        return max(tried, key=lambda t: (t[5], t[1] == "weighted", -tried.index(t)))

    run(1, [("weighted", x, 0.0, one) for x in ious] + [("soft", 0.0, x, one) for x in sigmas])
    _, how, iou, sigma, *_ = best()
    run(2, [(how, iou, sigma, [round(rng.uniform(0.2, 1.0), 2) for _ in models]) for _ in range(draws)])
    for k in range(rounds):
        _, how, iou, sigma, weights, _ = best()
        step = 0.5**k
        steps = [(how, iou, sigma, [round(min(1.0, max(0.05, w + d * step)), 3) if i == j else w for j, w in enumerate(weights)]) for i in range(len(models)) for d in (-0.2, 0.2)]
        steps += [(how, round(iou + d * step, 3), 0.0, weights) if how == "weighted" else (how, 0.0, round(max(0.02, sigma + d * step), 3), weights) for d in (-0.05, 0.05)]
        run(3 + k, steps)
    drop(frames)
    top = best()
    rows = [(s, how, iou, sigma, w, ap, (s, how, iou, sigma, w, ap) == top) for s, how, iou, sigma, w, ap in tried]
    return df.sparkSession.createDataFrame(rows, "stage int, method string, iou double, sigma double, weights array<double>, ap double, best boolean")


def _frames(df: DataFrame, truth: DataFrame, models: list[str]) -> DataFrame:
    """FRAME, its boxes (model: its place in models) and its true boxes, by id."""
    model = F.array_position(F.array(*(F.lit(x) for x in models)), F.col("model")).cast("int") - 1
    b = df.groupBy(*FRAME).agg(F.collect_list(F.struct("det_id", *box.names(), "conf", "cls", F.coalesce(model, F.lit(-1)).alias("model"))).alias("boxes"))
    t = truth.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("det_id", *box.names()))).alias("truth"))
    return b.join(t, FRAME, "left").select(*FRAME, "boxes", F.coalesce("truth", F.array()).alias("truth"))


def _tried(frames: DataFrame, n_truth: int, models: int, candidates: list[tuple[str, float, float, list[float]]]) -> list[float]:
    from . import scoring

    def run(batches):
        for batch in batches:
            size = batch.column("boxes").value_lengths().to_numpy()
            frame, b = np.repeat(np.arange(len(size)), size), batch.column("boxes").flatten()
            xy, conf, ids, model = _corners(b), *(b.field(k).to_numpy(zero_copy_only=False) for k in ("conf", "det_id", "model"))
            cls = b.field("cls").dictionary_encode().indices.fill_null(-1).to_numpy()
            group = frame * (cls.max(initial=0) + 2) + cls + 1
            n = batch.column("truth").value_lengths().to_numpy()
            truth = np.zeros((len(n), max(1, n.max(initial=0)), 4))
            truth[np.arange(truth.shape[1])[None] < n[:, None]] = _corners(batch.column("truth").flatten())
            for p, (how, iou, sigma, weights) in enumerate(candidates):
                w = conf * np.append(np.array(weights) / max(weights), 1.0)[model]  # models that have no weight count fully
                box_, score, det, of = together.weighted(xy, w, ids, group, iou, models) if how == "weighted" else together.decayed(xy, w, ids, group, sigma, 0.05)
                hit = together.hits(box_, score, det, frame[of], truth, n, 0.5)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(det), p, np.int32)), pa.array(score), pa.array(det), pa.array(hit.astype(np.int32))], names=["p", "conf", "det_id", "tp"])

    spark = frames.sparkSession
    d = frames.select("boxes", "truth").mapInArrow(run, "p int, conf double, det_id long, tp int")
    n = spark.createDataFrame([(p, n_truth) for p in range(len(candidates))], "p int, n_truth long")
    with released(spark):
        got = {r.p: r.ap for r in scoring.area_under(d, n, ["p"]).collect()}
    return [got[i] for i in range(len(candidates))]


def _corners(boxes: pa.StructArray) -> np.ndarray:
    return np.stack([boxes.field(k).to_numpy(zero_copy_only=False) for k in box.names()], axis=1).reshape(len(boxes), 4)


def _clusters(df: DataFrame, iou: float | str, keys: list[str], *extra: str, first: bool = False) -> DataFrame:
    """keys, cluster number and member: boxes by falling confidence join the cluster whose first box they overlap most, above iou.

    iou: a number, or the name of a key that holds it. first: they join the first such cluster, so the best box takes all
    that overlap it, then the best of the rest.
    """
    over = _sql(IOU, "c.m[0]", "x")
    best = f"aggregate(sequence(0, size(acc) - 1), named_struct('i', -1, 'v', {iou if isinstance(iou, str) else f'{iou}D'}), (r, i) -> element_at(transform(slice(acc, i + 1, 1), c -> IF({over} > r.v{' AND r.i < 0' if first else ''}, named_struct('i', i, 'v', {over}), r)), 1))"
    put = "transform(acc, (c, i) -> IF(i = hit.i, named_struct('m', concat(c.m, array(x))), c))"
    step = f"element_at(transform(array({best}), hit -> IF(hit.i < 0, concat(acc, array(named_struct('m', array(x)))), {put})), 1)"
    fold = f"aggregate(slice(b, 2, size(b)), array(named_struct('m', slice(b, 1, 1))), (acc, x) -> {step})"
    return _ranked(df, keys, *extra).selectExpr(*(k for k in keys if k != "cls"), f"posexplode({fold}) AS (cluster, c)").selectExpr(*(k for k in keys if k != "cls"), "cluster", "inline(c.m)").drop("k")


def fuse_wbf(df: DataFrame, iou: float, models: int, weights: dict[str, float] | None = None, skip: float = 0.0) -> DataFrame:
    """Weighted boxes: clusters by first box, geometry averaged by score, the mean score scaled by how many models agree."""
    return _averaged(_clusters(_weighted(df, weights).where(F.col("conf") >= skip), iou, [*FRAME, "cls"], "model"), models, [*FRAME, "cls"])


def _averaged(c: DataFrame, models: int, keys: list[str]) -> DataFrame:
    w = F.sum("conf")
    mean = [(F.sum(F.col(k) * F.col("conf")) / w).alias(k) for k in box.names()]
    g = c.groupBy(*keys, "cluster").agg(F.min("id").alias("det_id"), *mean, F.avg("conf").alias("avg"), F.count("*").alias("n"), F.countDistinct("model").alias("agree"))
    return g.withColumn("conf", F.col("avg") * F.least(F.col("n"), F.lit(models)) / models).drop("avg", "cluster", "n")


def fuse_nmw(df: DataFrame, iou: float) -> DataFrame:
    """Non-maximum weighted: a cluster's boxes are averaged by score times overlap with its first box, whose score stays."""
    c = _clusters(df, iou, [*FRAME, "cls"])
    first = Window.partitionBy(*FRAME, "cls", "cluster").orderBy(F.desc("conf"), "id")
    c = c.withColumns({f"f_{k}": F.first(k).over(first) for k in box.names()})
    c = c.withColumn("w", F.col("conf") * box.iou("", "f_"))
    mean = [(F.sum(F.col(k) * F.col("w")) / F.sum("w")).alias(k) for k in box.names()]
    return c.groupBy(*FRAME, "cls", "cluster").agg(F.min_by("id", F.struct(-F.col("conf"), "id")).alias("det_id"), *mean, F.max("conf").alias("conf")).drop("cluster")


def _running_clusters(df: DataFrame, iou: float, keys: list[str], *extra: str) -> DataFrame:
    """keys, cluster number, its box (m_x1 to m_y2) and member: boxes by falling confidence join the cluster whose mean box they overlap most, above iou.

    The mean is that of the members so far, weighted by their column w.
    """
    over, names = _sql(IOU, "c", "x"), box.names()
    best = f"aggregate(sequence(0, size(acc) - 1), named_struct('i', -1, 'v', {iou}D), (r, i) -> element_at(transform(slice(acc, i + 1, 1), c -> IF({over} > r.v, named_struct('i', i, 'v', {over}), r)), 1))"
    own = lambda x: ", ".join(f"'{k}', {x}.{k}" for k in names)
    fresh = lambda x: f"named_struct({own(x)}, 'w', {x}.w, 'm', array({x}))"
    means = ", ".join(f"'{k}', (c.{k} * c.w + x.{k} * x.w) / (c.w + x.w)" for k in names)
    grown = f"named_struct({means}, 'w', c.w + x.w, 'm', concat(c.m, array(x)))"
    step = f"element_at(transform(array({best}), hit -> IF(hit.i < 0, concat(acc, array({fresh('x')})), transform(acc, (c, i) -> IF(i = hit.i, {grown}, c)))), 1)"
    fold = f"aggregate(slice(b, 2, size(b)), array({fresh('b[0]')}), (acc, x) -> {step})"
    rest = [k for k in keys if k != "cls"]  # members have their class
    c = _ranked(df, keys, *extra).selectExpr(*keys, f"posexplode({fold}) AS (cluster, c)")
    return c.selectExpr(*rest, "cluster", *(f"c.{k} AS m_{k}" for k in names), "inline(c.m)").drop("k")


def fuse_proben(df: DataFrame, iou: float, classes: list[str], weights: dict[str, float] | None = None, skip: float = 0.0) -> DataFrame:
    """Clusters of one class around running mean boxes, whose distributions are multiplied, with the models' weights as exponents.

    Distributions come from scores, a map, or from cls and conf; what they leave of 1 is background. A fused box has the
    mean box by score and weight, the best class but background and its probability, the distribution and how many boxes
    it comes from. Boxes below skip don't count.
    """
    own = F.col("scores") if "scores" in df.columns else F.create_map(F.col("cls"), F.col("conf"))
    power = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("model")], F.lit(1.0)) if weights else F.lit(1.0)
    d = df.withColumn("own", own).withColumn("power", power.cast("double")).where(F.col("conf") >= skip).withColumn("w", F.col("conf") * F.col("power"))
    every = [*classes, "background"]
    p = lambda name: F.coalesce(F.col("own")[name], F.lit(0.0))
    left = F.greatest(F.lit(0.0), 1 - F.aggregate(F.map_values("own"), F.lit(0.0), lambda s, x: s + x))
    logs = [F.col("power") * F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-8), p(x) + left if x == "background" else p(x)))) for x in every]
    names = [f"l_{i}" for i in range(len(every))]
    d = d.withColumns(dict(zip(names, logs, strict=True)))
    c = _running_clusters(d, iou, [*FRAME, "cls"], "model", "w", *names)
    g = c.groupBy(*FRAME, "cls", "cluster", *(f"m_{k}" for k in box.names())).agg(F.min("id").alias("det_id"), *(F.sum(x).alias(x) for x in names), F.count("*").alias("n"))
    g = g.withColumn("_t", F.greatest(*names)).withColumn("_e", F.array(*(F.exp(F.col(x) - F.col("_t")) for x in names)))
    g = g.withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)).withColumn("_q", F.transform("_e", lambda x: x / F.col("_s")))
    top = F.array_max(F.slice("_q", 1, len(classes)))
    labels = F.array(*(F.lit(x) for x in every))
    g = g.withColumn("conf", top).withColumn("best", F.get(labels, F.array_position("_q", F.col("conf")).cast("int") - 1))
    return g.select(*FRAME, "det_id", *(F.col(f"m_{k}").alias(k) for k in box.names()), F.col("best").alias("cls"), "conf", F.map_from_arrays(labels, F.col("_q")).alias("scores"), "n")


def contributors(fused: DataFrame, inputs: DataFrame, same_class: bool = True) -> DataFrame:
    """Per fused box and model the input box that overlaps most (of equal ones the one with the smaller id)."""
    p = box.prefixed(fused, "c_", FRAME).join(box.prefixed(inputs, "t_", FRAME), FRAME).withColumn("iou", box.iou("c_", "t_")).where("iou > 0")
    p = p.where("c_cls = t_cls") if same_class else p
    w = Window.partitionBy(*FRAME, "c_det_id", "t_model").orderBy(F.desc("iou"), "t_det_id")
    return p.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def pseudonyms(df: DataFrame, allowed: DataFrame, iou: float) -> DataFrame:
    """Boxes of a generic class take the specific class (generic, specific) of the best overlapping box of another model."""
    a = box.prefixed(df, "c_", FRAME).join(allowed, F.col("c_cls") == F.col("generic"))  # a table of classes
    p = a.join(box.prefixed(df, "t_", FRAME), FRAME).where("t_cls = specific AND c_model <> t_model").withColumn("iou", box.iou("c_", "t_")).where(F.col("iou") > iou)
    new = p.groupBy(*FRAME, F.col("c_det_id").alias("det_id")).agg(F.max_by("t_cls", F.struct("iou", -F.col("t_det_id"))).alias("new"))
    return df.join(new, [*FRAME, "det_id"], "left").withColumn("cls", F.coalesce("new", "cls")).drop("new")


def box_anchor(fused: DataFrame, inputs: DataFrame, model: str, iou: float) -> DataFrame:
    """Geometry of fused boxes from the best overlapping box of one model and class."""
    best = contributors(fused, inputs.where(F.col("model") == model)).where(F.col("iou") > iou)
    best = best.select(*FRAME, F.col("c_det_id").alias("det_id"), *(F.col(f"t_{k}").alias(f"n_{k}") for k in box.names()))
    return fused.join(best, [*FRAME, "det_id"], "left").withColumns({k: F.coalesce(f"n_{k}", k) for k in box.names()}).drop(*(f"n_{k}" for k in box.names()))


def cross_class(df: DataFrame, iou: float) -> DataFrame:
    """Clusters whatever the class, each the best box left and all that overlap it: weighted box, the best score of each class, whether all agree."""
    c = _clusters(df, iou, FRAME, first=True)
    mean = [(F.sum(F.col(k) * F.col("conf")) / F.sum("conf")).alias(k) for k in box.names()]
    per = c.groupBy(*FRAME, "cluster", "cls").agg(F.max("conf").alias("s"))
    dist = per.groupBy(*FRAME, "cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "s")))).alias("scores"), F.max_by("cls", F.struct("s", "cls")).alias("cls"), (F.count("*") == 1).alias("agree"))
    g = c.groupBy(*FRAME, "cluster").agg(F.min("id").alias("det_id"), *mean, F.max("conf").alias("conf"))
    return g.join(dist, [*FRAME, "cluster"]).drop("cluster")


def stack_features(fused: DataFrame, inputs: DataFrame, models: list[str]) -> DataFrame:
    """Per fused box: share of models that agree, mean overlap, best score, and each model's score."""
    c = contributors(fused, inputs)
    g = c.groupBy(*FRAME, F.col("c_det_id").alias("det_id")).pivot("t_model", models).agg(F.max("t_conf"))
    s = c.groupBy(*FRAME, F.col("c_det_id").alias("det_id")).agg((F.countDistinct("t_model") / len(models)).alias("agreement"), F.avg("iou").alias("mean_iou"), F.max("t_conf").alias("best"), F.first("c_conf").alias("conf"))
    return s.join(g, [*FRAME, "det_id"]).fillna(0.0)


def calibrate_fit(samples: DataFrame, least: int = 20, knots: int = 32) -> DataFrame:
    """Isotonic maps from conf to hit rate (hit 0 or 1) per model and class, and '*' per model for classes with few samples.

    Samples are summed by score first (in steps of a thousandth), so a group has at most as many rows as distinct scores.
    """
    s = samples.select("model", "cls", (F.floor(F.col("conf") * 1000 + 0.5) / 1000).alias("x"), F.col("hit").cast("long").alias("hit"))
    sums = [F.sum("hit").alias("h"), F.count("*").alias("w")]
    every = s.groupBy("model", "cls", "x").agg(*sums).unionByName(s.groupBy("model", F.lit("*").alias("cls"), "x").agg(*sums))

    def pav(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.w.sum() < least:
            return pd.DataFrame({"model": [], "cls": [], "x": [], "y": []})
        blocks: list[list] = []  # hits, samples, first and last score; whole numbers, so that equal rates are equal
        for x, h, w in pdf.sort_values("x")[["x", "h", "w"]].itertuples(index=False):
            blocks.append([int(h), int(w), x, x])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                b, a = blocks.pop(), blocks.pop()
                blocks.append([a[0] + b[0], a[1] + b[1], a[2], b[3]])
        pts = [(p, b[0] / b[1]) for b in blocks for p in sorted({b[2], b[3]})]
        step = max(1, -(-len(pts) // knots))
        pts = pts[::step] + ([pts[-1]] if (len(pts) - 1) % step else [])
        return pd.DataFrame({"model": pdf.model.iloc[0], "cls": pdf.cls.iloc[0], "x": [p[0] for p in pts], "y": [p[1] for p in pts]})

    return every.groupBy("model", "cls").applyInPandas(pav, "model string, cls string, x double, y double")


def calibrate_apply(df: DataFrame, maps: DataFrame) -> DataFrame:
    """conf through the piecewise linear map (model, cls, x, y) of its model and class, else the model's '*', else as it is."""
    t = maps.groupBy("model", "cls").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("k"))
    own, any_ = t.withColumnRenamed("k", "k1"), t.where("cls = '*'").select("model", F.col("k").alias("k2"))
    j = df.join(own, ["model", "cls"], "left").join(any_, "model", "left").withColumn("k", F.coalesce("k1", "k2"))  # at most 32 knots per model and class
    lo = F.element_at(F.filter("k", lambda p: p["x"] <= F.col("conf")), -1)
    hi = F.get(F.filter("k", lambda p: p["x"] > F.col("conf")), 0)
    lin = F.when(lo.isNull(), hi["y"]).when(hi.isNull(), lo["y"]).otherwise(lo["y"] + (F.col("conf") - lo["x"]) / (hi["x"] - lo["x"]) * (hi["y"] - lo["y"]))
    return j.withColumn("conf", F.when(F.col("k").isNull(), F.col("conf")).otherwise(F.when(F.exists("k", lambda p: p["x"] <= F.col("conf")), lin).otherwise(F.element_at("k", 1)["y"]))).drop("k", "k1", "k2")


def rescore_fit(features: DataFrame, columns: list[str], label: str = "hit", penalty: float = 1.0) -> list[float]:
    """Intercept and weights of a logistic model of standardised features, with an L2 penalty."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=columns, outputCol="features").transform(features.select(*columns, F.col(label).cast("double").alias("label")))
    fit = LogisticRegression(regParam=penalty / max(1, features.count()), elasticNetParam=0.0, standardization=True).fit(x)
    return [float(fit.intercept), *map(float, fit.coefficients)]


def rescore_apply(features: DataFrame, columns: list[str], weights: list[float]) -> DataFrame:
    z = F.lit(weights[0])
    for c, w in zip(columns, weights[1:], strict=True):
        z = z + F.col(c) * w
    return features.withColumn("score", 1 / (1 + F.exp(-z)))


def mean_distribution(df: DataFrame, ignored: str | None = None, weighted: bool = True, scaled: bool = True) -> DataFrame:
    """Per track the mean class distribution of its boxes (scores: map): weighted by confidence, times 0.1 + 0.9 mean confidence.

    A box of the ignored class alone counts for that class only, and the class has no part in mixed ones. Where a track has
    others, the means are over these and the class is left out; a track of such boxes only has the class itself. Boxes
    without scores don't count.
    """
    d = df.where("scores IS NOT NULL AND size(scores) > 0").withColumn("w", F.col("conf") if weighted else F.lit(1.0))
    lone = (F.size("scores") == 1) & F.array_contains(F.map_keys("scores"), ignored) if ignored else F.lit(False)
    d = d.withColumn("lone", lone)
    key, none = ["seq_id", "track_id"], F.lit(0.0)
    t = d.groupBy(*key).agg(F.avg("conf").alias("mean"), F.sum("w").alias("mass"), F.coalesce(F.sum(F.when(F.col("lone"), F.col("w"))), none).alias("lone_mass"), F.coalesce(F.sum(F.when(~F.col("lone"), F.col("w"))), none).alias("rest"))
    only = (F.col("lone_mass") > 0) & (F.col("rest") <= 0)
    by = F.when((F.col("lone_mass") == 0) & (F.col("mass") > 0), F.col("mass")).when((F.col("lone_mass") > 0) & (F.col("rest") > 0), F.col("rest")).when(only, F.col("lone_mass")).otherwise(1.0)
    factor = (0.1 + 0.9 * F.col("mean") if scaled else F.lit(1.0)) / by
    e = d.select(*key, "w", "lone", F.explode("scores").alias("cls", "s"))
    e = e.where(F.col("lone") | (F.col("cls") != ignored)) if ignored else e
    g = e.groupBy(*key, "cls", "lone").agg(F.sum(F.col("s") * F.col("w")).alias("s")).join(t.select(*key, factor.alias("factor"), only.alias("only")), key)
    return g.where(~F.col("lone") | F.col("only")).select(*key, "cls", (F.col("s") * F.col("factor")).alias("score"))


def cluster_tracks(df: DataFrame, least: float = 0.3, volume: bool = False, least_frames: int = 1) -> DataFrame:
    """seq_id, model, track_id and cluster: tracks of several trackers that follow the same thing.

    Trackers come one after the other, by name. The tracks of the first are clusters. Those of the next are compared with
    the clusters' mean boxes by tube overlap; an assignment of least total cost gives each cluster at most one of them.
    What is left, in order of its id, may join the cluster that it overlaps most if that has no track of its tracker in
    the same frames, told by the frames themselves; else it is a cluster of its own. A cluster's boxes are means of its
    boxes before and the boxes that join, frame by frame.

    Each tracker is a round of joins over all sequences. Only the overlaps of one sequence's tracks meet in a task, as a
    list of pairs without boxes, and the frames of those that have to be told apart.
    """
    rows = stored(df.select("seq_id", "model", "track_id", "frame_id", *box.names()), "tracks")
    members = _cluster_rows(rows, least, volume, least_frames)
    drop(rows)
    return members


def _cluster_rows(rows: DataFrame, least: float, volume: bool, least_frames: int) -> DataFrame:
    """cluster_tracks() of a written table."""
    models = [r["model"] for r in rows.select("model").distinct().orderBy("model").collect()]  # one row per tracker
    held, members = None, None
    for model in models:
        new = rows.where(F.col("model") == model).drop("model")
        own = F.concat_ws(":", F.lit(str(model)), F.col("track_id").cast("string"))
        if held is None:
            held = stored(new.select("seq_id", "frame_id", *box.names(), own.alias("cluster")), "clusters")
            members = stored(new.select("seq_id", F.lit(model).alias("model"), "track_id", own.alias("cluster")).distinct(), "members")
            continue
        pairs = _tube_pairs(held, new, volume, least_frames).where("overlap > 0").withColumn("least", F.lit(least))
        frames = new.groupBy("seq_id", "track_id").agg(F.sort_array(F.collect_set("frame_id")).alias("frames"))
        pairs = pairs.join(frames, ["seq_id", "track_id"])
        joined = stored(pairs.groupBy("seq_id").applyInPandas(_join_clusters, "seq_id long, track_id long, cluster string"), "joined")
        now = stored(new.select("seq_id", "track_id").distinct().join(joined, ["seq_id", "track_id"], "left").withColumn("cluster", F.coalesce("cluster", own)), "members")
        drop(joined)
        members = members.unionByName(now.withColumn("model", F.lit(model)))
        if model == models[-1]:
            break
        # a cluster gets one box a frame at most, so the mean is that of what is there and what comes
        come = new.join(now, ["seq_id", "track_id"]).select("seq_id", "frame_id", *box.names(), "cluster")
        merged = held.unionByName(come).groupBy("seq_id", "cluster", "frame_id").agg(*(F.avg(k).alias(k) for k in box.names()))
        was, held = held, stored(merged, "clusters")
        drop(was)
    if held is not None:
        drop(held)
    return members


def _tube_pairs(held: DataFrame, new: DataFrame, volume: bool, least_frames: int) -> DataFrame:
    """seq_id, cluster, track_id and overlap of clusters and tracks with common frames."""
    named = lambda d, p: d.select("seq_id", "frame_id", *([c for c in ("cluster", "track_id") if c in d.columns]), *(F.col(k).alias(p + k) for k in box.names()))
    j = named(held, "c_").join(named(new, "t_"), ["seq_id", "frame_id"]).withColumn("common", box.intersection("c_", "t_"))
    g = j.groupBy("seq_id", "cluster", "track_id").agg(F.count("*").alias("n"), F.avg(box.iou("c_", "t_")).alias("overlap"), F.sum("common").alias("common")).where(F.col("n") >= least_frames)
    if not volume:
        return g.select("seq_id", "cluster", "track_id", "overlap")
    size = lambda d, k: d.groupBy("seq_id", k).agg(F.sum(box.area()).alias(f"{k}_size"))
    g = g.join(size(held, "cluster"), ["seq_id", "cluster"]).join(size(new, "track_id"), ["seq_id", "track_id"])
    return g.select("seq_id", "cluster", "track_id", (F.col("common") / (F.col("cluster_size") + F.col("track_id_size") - F.col("common"))).alias("overlap"))


def _join_clusters(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which tracks of one tracker join which clusters of a sequence."""
    least = pdf.least.iloc[0]
    pdf = pdf.sort_values(["track_id", "cluster"])
    clusters, tracks = sorted(pdf.cluster.unique()), sorted(pdf.track_id.unique())
    row, col = {c: i for i, c in enumerate(clusters)}, {t: i for i, t in enumerate(tracks)}
    edges: dict[int, list] = {}
    for c, t, o in zip(pdf.cluster.map(row), pdf.track_id.map(col), pdf.overlap, strict=True):
        edges.setdefault(t, []).append((o, c))
    over = {(c, t): o for t, es in edges.items() for o, c in es}
    of = [(c, t) for c, t in m.assign_sparse([(c, t, 1 - o) for (c, t), o in over.items()]) if over[c, t] >= least]
    mine: dict[int, list] = {}
    frames = {col[t]: set(f) for t, f in zip(pdf.track_id, pdf.frames, strict=True)}
    to = {}
    for c, t in of:
        to[t] = c
        mine.setdefault(c, []).append(frames[t])
    for t in range(len(tracks)):
        if t in to:
            continue
        best = None
        for o, c in edges[t]:
            if o >= (best[0] if best else least) and not any(frames[t] & f for f in mine.get(c, [])):
                best = (o, c)
        if best is not None:
            to[t] = best[1]
            mine.setdefault(best[1], []).append(frames[t])
    return pd.DataFrame([(pdf.seq_id.iloc[0], tracks[t], clusters[c]) for t, c in to.items()], columns=["seq_id", "track_id", "cluster"])


def fuse_tracks(df: DataFrame, least: float = 0.3, min_trackers: int = 2, weights: dict[str, float] | None = None, volume: bool = False, least_frames: int = 1) -> DataFrame:
    """Tracks of several trackers (model) that follow the same thing become one: seq_id, fused, frame_id, box, conf, scores and trackers.

    Boxes are means weighted by the tracker's weight (1 if not given) and confidence, the confidence is the mean by
    tracker's weight, and classes are mixed in the same way as boxes and scaled so that the best has the confidence. Classes
    come from scores, a map, or from cls and conf.
    """
    classes = F.map_entries("scores").alias("own") if "scores" in df.columns else F.col("cls").alias("own")
    rows = stored(df.select("seq_id", "model", "track_id", "frame_id", *box.names(), "conf", classes), "tracks")
    names = _cluster_rows(rows, least, volume, least_frames)
    n = names.groupBy("seq_id", "cluster").agg(F.countDistinct("model").alias("trackers")).where(F.col("trackers") >= min_trackers)
    j = rows.join(names.join(n, ["seq_id", "cluster"]), ["seq_id", "model", "track_id"])
    # the boxes of a cluster in a frame, one of each tracker, meet once, in order
    of = F.sort_array(F.collect_list(F.struct("model", *box.names(), "conf", "own"))).alias("of")
    d = j.groupBy("seq_id", "cluster", "frame_id", "trackers").agg(of)
    w = lambda r: (F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[r["model"]], F.lit(1.0)) if weights else F.lit(1.0)).cast("double")
    wc = lambda r: w(r) * F.greatest(r["conf"], F.lit(1e-6))
    own = lambda r: F.coalesce(r["own"], F.array().cast(j.schema["own"].dataType)) if "scores" in df.columns else F.array(F.struct(r["own"].alias("key"), r["conf"].alias("value")))
    total = lambda f: F.aggregate("of", F.lit(0.0), lambda s, r: s + F.coalesce(f(r), F.lit(0.0)))
    d = d.withColumns({k: total(lambda r, k=k: r[k] * wc(r)) / total(wc) for k in box.names()} | {"mean": total(lambda r: w(r) * r["conf"]) / total(w)})
    parts = F.flatten(F.transform("of", lambda r: F.transform(own(r), lambda e: F.struct(e["key"].alias("name"), (wc(r) * e["value"]).alias("p")))))
    d = d.withColumn("parts", parts).withColumn("names", F.array_sort(F.array_distinct(F.transform("parts", lambda e: e["name"]))))
    sums = F.transform("names", lambda x: F.aggregate(F.filter("parts", lambda e: (e["name"] == x) & e["p"].isNotNull()), F.lit(None).cast("double"), lambda s, e: F.coalesce(s, F.lit(0.0)) + e["p"]))
    d = d.withColumn("mix", F.map_from_arrays("names", sums)).withColumn("top", F.array_max(F.map_values("mix")))
    scores = F.when(F.col("top") > 0, F.transform_values("mix", lambda _, p: p * F.col("mean") / F.col("top")))
    return d.select("seq_id", F.col("cluster").alias("fused"), "frame_id", *box.names(), F.col("mean").alias("conf"), scores.alias("scores"), "trackers")


def agreement(expr: Column) -> Column:
    """A share as a score between 0.1 and 1."""
    return 0.1 + 0.9 * expr
