"""Choice of trainers by statistics of a data set, from a table of rules.

A rule is a row: trainer, rule, kind (gate or preference), clause, stat, the bounds low
and high (null: none) and whether each is itself outside (low_open, high_open), and
points. A rule holds if all rows of any of its clauses hold. A trainer is out if a gate
doesn't hold, and the reason says which and why; its score is the points of the
preferences that hold. Statistics are a long table of key columns, stat and value, so a
rule can be about any of them and all rules are evaluated by one join. A statistic that
isn't there lets a gate pass and a preference not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RULES = "trainer string, rule string, kind string, clause int, stat string, low double, low_open boolean, high double, high_open boolean, points double"

#: Gates of trainer settings: the statistic that an option bounds, and from which side. Fixed names of the settings.
GATES = {
    "required_min_count_per_class": ("min_class_count", "low"), "required_max_aspect_ratio_std": ("aspect_std", "high"), "required_max_objects_per_frame": ("max_objects_per_frame", "high"),
    "required_max_class_imbalance": ("class_imbalance", "high"), "required_mask_fraction": ("mask_fraction", "low"),
    "required_min_tracks": ("tracks", "low"), "required_min_track_length": ("min_track_length", "low"), "required_min_mean_track_length": ("mean_track_length", "low"), "required_max_fragmentation_rate": ("fragmentation_rate", "high"),
    "required_max_velocity": ("max_velocity", "high"), "required_max_concurrent_tracks": ("max_concurrent_tracks", "high"), "required_min_mean_object_area": ("mean_object_area", "low"),
}


def preferences(low_count: float = 500, high_count: float = 5000, sparse: float = 3, crowded: float = 20, small_area: float = 1024) -> dict[str, dict[str, list]]:
    """What each value of a preference asks for: clauses (any of them) of conditions (all of them) on a statistic: (stat, low, open, high, open)."""
    at_least, below = lambda s, v: (s, v, False, None, False), lambda s, v: (s, None, False, v, True)
    at_most, above = lambda s, v: (s, None, False, v, False), lambda s, v: (s, v, True, None, False)
    is_ = lambda s: at_least(s, 1)
    return {
        "annotation_count_preference": {"low": [[below("annotations", low_count)]], "medium": [[at_least("annotations", low_count), below("annotations", high_count)]], "high": [[at_least("annotations", high_count)]]},
        "object_size_preference": {k: [[is_(f"mostly_{k}")]] for k in ("small", "medium", "large")},
        "aspect_ratio_preference": {k: [[is_(f"mostly_{k}")]] for k in ("tall", "square", "wide")},
        "density_preference": {"sparse": [[at_most("mean_objects_per_frame", sparse)]], "dense": [[at_least("mean_objects_per_frame", crowded)]], "medium": [[above("mean_objects_per_frame", sparse), below("mean_objects_per_frame", crowded)]]},
        "scale_preference": {"multi-scale": [[is_("multi_scale")]], "uniform": [[below("multi_scale", 1)]]},
        "overlap_preference": {"low": [[below("high_overlap_fraction", 0.1)]], "high": [[above("high_overlap_fraction", 0.3)]], "medium": [[at_least("high_overlap_fraction", 0.1), at_most("high_overlap_fraction", 0.3)]]},
        "prefers_masks": {"yes": [[above("mask_fraction", 0)]]},
        "track_length_preference": {"short": [[above("short_track_fraction", 0.5)]], "long": [[above("long_track_fraction", 0.3)]], "medium": [[at_most("short_track_fraction", 0.5), at_most("long_track_fraction", 0.3)]]},
        "motion_preference": {"stationary": [[above("stationary_fraction", 0.5)]], "fast": [[above("fast_fraction", 0.3)]], "slow": [[at_most("stationary_fraction", 0.5), at_most("fast_fraction", 0.3)]]},
        "track_density_preference": {"sparse": [[below("mean_concurrent_tracks", sparse)]], "dense": [[at_least("mean_concurrent_tracks", crowded)]], "medium": [[at_least("mean_concurrent_tracks", sparse), below("mean_concurrent_tracks", crowded)]]},
        "fragmentation_preference": {"continuous": [[below("fragmentation_rate", 0.1)]], "fragmented": [[at_least("fragmentation_rate", 0.3)]]},
        "occlusion_preference": {"low": [[below("occlusion_fraction", 0.1)]], "high": [[at_least("occlusion_fraction", 0.3)]], "medium": [[at_least("occlusion_fraction", 0.1), below("occlusion_fraction", 0.3)]]},
        "appearance_preference": {"consistent": [[below("varying_size_fraction", 0.2)]], "varying": [[at_least("varying_size_fraction", 0.4)]]},
        "prefers_reid": {"yes": [[at_least("mean_concurrent_tracks", 5)], [at_least("occlusion_fraction", 0.2)], [at_least("mean_object_area", small_area)]]},
    }


def rules(spark: SparkSession, trainers: dict[str, dict], **thresholds) -> DataFrame:
    """The rule table of trainers by name with their settings; required_min_object_area goes with required_percentile (0.8)."""
    known, rows = preferences(**thresholds), []
    for name, settings in trainers.items():
        rows.append((name, "any", "preference", 0, "annotations", None, False, None, False, 0.0))  # a trainer without settings takes part too
        for option, value in settings.items():
            if option == "required_percentile" or not value:
                continue
            if option == "required_min_object_area":
                rows.append((name, option, "gate", 0, f"area_share:{float(value)}", settings.get("required_percentile", 0.8), False, None, False, 0.0))
            elif option == "required_masks":
                rows.append((name, option, "gate", 0, "mask_fraction", 0.0, True, None, False, 0.0))
            elif option in GATES:
                stat, side = GATES[option]
                rows.append((name, option, "gate", 0, stat, float(value) if side == "low" else None, False, float(value) if side == "high" else None, False, 0.0))
            else:
                for clause, conditions in enumerate(known[option]["yes" if value is True else value]):
                    bound = lambda v: None if v is None else float(v)
                    rows += [(name, option, "preference", clause, s, bound(low), lo, bound(high), ho, 1.0) for s, low, lo, high, ho in conditions]
    return spark.createDataFrame(rows, RULES)


def areas_asked(table: DataFrame) -> list[float]:
    """The object areas that rules ask the share above of. A table of rules is small."""
    return sorted({float(r.stat.split(":")[1]) for r in table.where("stat LIKE 'area_share:%'").select("stat").distinct().collect()})


def long_form(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics by columns as keys, stat and value; true is 1."""
    names = [c for c in stats.columns if c not in keys]
    return stats.select(*keys, F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"`{c}`").cast("double") for c in names)))).alias("stat", "value"))


def mostly(parts: dict[str, str], usual: str) -> dict:
    """Columns mostly_<part>: which of some counts is the largest; the usual one, then the first, of equal ones."""
    order = [usual, *(p for p in parts if p != usual)]
    best, at = F.col(parts[usual]), F.lit(usual)
    for p in order[1:]:
        at = F.when(F.col(parts[p]) > best, p).otherwise(at)
        best = F.greatest(best, F.col(parts[p]))
    return {f"mostly_{p}": (at == p) for p in parts}


def detector_statistics(df: DataFrame, keys: list[str], areas: list[float] = (), small: float = 1024, large: float = 9216, mask: str | None = None) -> DataFrame:
    """What the rules of detector trainers ask, by key: one aggregate of boxes, one of frames and one of classes."""
    area, aspect = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    d = df.withColumn("area", area).withColumn("aspect", F.when(F.col("y2") > F.col("y1"), aspect))
    shares = [F.avg((F.col("area") >= a).cast("double")).alias(f"area_share:{float(a)}") for a in areas]
    n = F.count_if
    base = d.groupBy(*keys).agg(
        F.count("*").alias("annotations"), F.avg("area").alias("mean_object_area"), F.stddev_pop("aspect").alias("aspect_std"), (F.max("area") / F.min("area") > 100).alias("multi_scale"),
        n(F.col("area") < small).alias("n_small"), n((F.col("area") >= small) & (F.col("area") < large)).alias("n_medium"), n(F.col("area") >= large).alias("n_large"),
        n(F.col("aspect") < 0.5).alias("n_tall"), n((F.col("aspect") >= 0.5) & (F.col("aspect") <= 2)).alias("n_square"), n(F.col("aspect") > 2).alias("n_wide"),
        (F.avg(F.col(mask).isNotNull().cast("double")) if mask else F.lit(0.0)).alias("mask_fraction"), *shares,
    )
    own = list(dict.fromkeys([*keys, "seq_id", "frame_id"]))
    frames = df.groupBy(*own).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.avg("n").alias("mean_objects_per_frame"), F.max("n").alias("max_objects_per_frame"))
    classes = df.groupBy(*keys, "cls").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min("n").alias("min_class_count"), (F.max("n") / F.min("n")).alias("class_imbalance"))
    out = base.join(frames, keys).join(classes, keys)
    out = out.withColumns(mostly({"small": "n_small", "medium": "n_medium", "large": "n_large"}, "medium") | mostly({"tall": "n_tall", "square": "n_square", "wide": "n_wide"}, "square"))
    return long_form(out, keys)


def evaluate(stats: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, trainer, eligible, score, rank (of those that are in, by score and name) and reason (what puts a trainer out)."""
    every = stats.select(*keys).distinct().join(F.broadcast(table))  # a table of trainers' rules
    j = every.join(stats, [*keys, "stat"], "left")
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    holds = (low.isNull() | F.when(F.col("low_open"), v > low).otherwise(v >= low)) & (high.isNull() | F.when(F.col("high_open"), v < high).otherwise(v <= high))
    j = j.withColumn("holds", F.when(v.isNull(), (F.col("kind") == "gate") | (F.col("rule") == "any")).otherwise(holds))
    says = F.format_string("%s: %s is %s", F.col("rule"), F.col("stat"), F.round("value", 6).cast("string"))
    clauses = j.groupBy(*keys, "trainer", "rule", "kind", "clause").agg(F.bool_and("holds").alias("holds"), F.max("points").alias("points"), F.min(F.when(~F.col("holds"), says)).alias("why"))
    ruled = clauses.groupBy(*keys, "trainer", "rule", "kind").agg(F.bool_or("holds").alias("holds"), F.max("points").alias("points"), F.min("why").alias("why"))
    out = (F.col("kind") == "gate") & ~F.col("holds")
    g = ruled.groupBy(*keys, "trainer").agg((~F.bool_or(out)).alias("eligible"), F.coalesce(F.sum(F.when((F.col("kind") == "preference") & F.col("holds"), F.col("points"))), F.lit(0.0)).alias("score"), F.array_join(F.sort_array(F.collect_list(F.when(out, F.col("why")))), "; ").alias("reason"))
    w = Window.partitionBy(*keys, "eligible").orderBy(F.desc("score"), "trainer")  # one row per trainer
    return g.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(w))).withColumn("reason", F.when(F.col("reason") != "", F.col("reason")))
