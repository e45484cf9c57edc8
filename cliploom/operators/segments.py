"""Classes of text and time ranges of videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import asof, geometry

# ---- fixed values: defaults of the penalties and limits ----------------------------
PENALTIES = {
    "center_text": 0.45, "multi_region": 0.35, "text_area": 0.30, "band": 0.25, "dense_text": 0.20, "bottom_simple": 0.08,
    "top_simple": 0.06, "watermark": 0.02, "promotion": 0.25,
}
LIMITS = {
    "simple_bottom_area": 0.12, "simple_bottom_boxes": 3, "center_area": 0.10, "dense_area": 0.25, "multi": 0.40, "center": 0.50, "band": 0.40,
}
# ---- end of fixed values -----------------------------------------------------------


def classify(metrics: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """The first of twelve classes whose rule holds; no sampled frame at all means ``unknown``."""
    only = lambda z: F.col("shown") == F.array(F.lit(z))
    zones = F.filter(F.array(*[F.when(F.col(f"avg_{z}") > 0, z) for z in ("bottom", "center", "top")]), lambda z: z.isNotNull())
    rows = metrics.withColumn("shown", F.when(F.size("zones") > 0, F.col("zones")).otherwise(zones))
    many = F.col("multi") >= limits["multi"]
    simple = (F.col("avg_area") <= limits["simple_bottom_area"]) & (F.col("most_significant") <= limits["simple_bottom_boxes"])
    kind = (
        F.when(F.col("presence").isNull(), "unknown").when(F.col("most_boxes") == 0, "none").when(F.col("watermark_only"), "watermark_only").when(F.col("promotion"), "promotional_overlay")
        .when(F.col("avg_area") >= limits["dense_area"], "dense_text").when((F.col("avg_center") >= limits["center_area"]) & (F.col("center") >= limits["center"]), "large_center_text")
        .when((F.col("band") >= limits["band"]) & many, "colored_block").when(many, "multi_region").when(F.col("band") >= limits["band"], "colored_block")
        .when(only("bottom") & simple, "bottom_simple").when(only("bottom"), "single_region").when(only("top"), "top_simple").when(F.col("most_boxes") <= 1, "single_region").otherwise("complex")
    )
    return rows.withColumn("subtitle_class", kind).drop("shown")


def cleanliness(classified: DataFrame, weights: dict[str, float] = PENALTIES, limits: dict[str, float] = LIMITS) -> DataFrame:
    """1 less the weighted penalties, between 0 and 1; 1 without text, 0 where nothing was measured."""
    part = lambda c, whole: F.least(F.lit(1.0), c / whole)
    on = lambda cond, name: F.when(cond, weights[name]).otherwise(0.0)
    kind = F.col("subtitle_class")
    loss = (
        weights["center_text"] * F.col("center") * part(F.col("avg_center"), limits["center_area"]) + weights["multi_region"] * F.col("multi")
        + weights["text_area"] * part(F.greatest(F.lit(0.0), F.col("avg_area") - F.col("avg_bottom")), limits["dense_area"]) + weights["band"] * F.col("band")
        + weights["bottom_simple"] * F.col("bottom") + on(~F.col("watermark_only") & (F.col("avg_top") > 0), "top_simple") + on(kind == "dense_text", "dense_text")
        + on(F.col("watermark_only"), "watermark") + on(F.col("promotion"), "promotion")
    )
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - loss)), 3)
    return classified.withColumn("cleanliness", F.when(kind == "none", 1.0).when(kind == "unknown", 0.0).otherwise(score))


def snap(segments: DataFrame, boundaries: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Start to the nearest boundary before it, end to the nearest after it, within ``tolerance``.

    Two as-of joins; columns besides ``video_id``, ``start`` and ``end`` are not kept.
    """
    rows = segments.select("video_id", "start", "end")
    rows = asof.nearest(rows, boundaries, "video_id", F.col("start"), "t", "before", tolerance)
    rows = asof.nearest(rows, boundaries, "video_id", F.col("end"), "t", "after", tolerance, forward=True)
    start, end = F.coalesce("before", "start"), F.coalesce("after", "end")
    return rows.select("video_id", start.alias("start"), end.alias("end"), ((start != F.col("start")) | (end != F.col("end"))).alias("refined"))


def split_long(segments: DataFrame, most: float = 15.0, least: float = 3.0, tolerance: float = 1.5) -> DataFrame:
    """Ranges longer than ``most`` cut at the boundary nearest to each full length, else there; a short tail joins the last piece.

    ``ts`` holds a video's boundaries. Each cut depends on the one before, so a fold over as
    many turns as pieces can be makes them.
    """
    begin, end = F.col("start"), F.col("end")
    turns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil((end - begin) / least).cast("int")))

    def step(acc: Column, _: Column) -> Column:
        ideal = acc["at"] + most
        near = F.array_min(F.transform(F.filter("ts", lambda t: F.abs(t - ideal) <= tolerance), lambda t: F.struct(F.abs(t - ideal).alias("d"), t.alias("t"))))
        cut = F.coalesce(F.nullif(near["t"], F.lit(0.0)), ideal)
        cut = F.when((cut - acc["at"] < least) | (cut >= end), F.least(ideal, end)).otherwise(cut)
        more = F.struct(cut.alias("at"), F.concat(acc["cuts"], F.array(cut)).alias("cuts"), F.lit(False).alias("done"))
        stop = acc["done"] | (end - acc["at"] <= most + 0.01) | (end - cut < least)
        return F.when(stop, F.struct(acc["at"].alias("at"), acc["cuts"].alias("cuts"), F.lit(True).alias("done"))).otherwise(more)

    first = F.struct(begin.alias("at"), F.expr("cast(array() as array<double>)").alias("cuts"), F.lit(False).alias("done"))
    cuts = F.aggregate(turns, first, step, lambda acc: acc["cuts"])
    last = F.try_element_at(F.col("cuts"), F.lit(-1))
    inner = F.when(F.col("end") - last < least, F.slice("cuts", F.lit(1), F.size("cuts") - 1)).otherwise(F.col("cuts"))
    marks = F.concat(F.array("start"), inner, F.array("end"))
    pairs = F.zip_with(F.slice(marks, F.lit(1), F.size(marks) - 1), F.slice(marks, F.lit(2), F.size(marks)), lambda a, b: F.struct(F.bround(a, 3).alias("start"), F.bround(b, 3).alias("end")))
    whole = F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end")))
    rows = segments.select("video_id", "start", "end", cuts.alias("cuts"))
    rows = rows.select("video_id", F.explode(F.when(F.size("cuts") > 0, pairs).otherwise(whole)).alias("s"))
    return rows.select("video_id", "s.start", "s.end").filter(F.col("end") - F.col("start") >= least)


def normalized(segments: DataFrame, durations: DataFrame, boundaries: DataFrame, least: float = 3.0, most: float = 15.0, tolerance: float = 1.5, slack: float = 0.5, count: int = 12) -> DataFrame:
    """Raw ranges made fit: clamped to the video, unusable and short ones dropped, long ones split, later overlapping ones dropped, the first ``count`` kept."""
    held = boundaries.groupBy("video_id").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    good = segments.filter(F.coalesce("usable", F.lit(True)) & ~F.isnan("start") & ~F.isnan("end")).join(durations.filter("duration > 0"), "video_id")
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.col(c), F.col("duration"))).alias(c)
    cut = good.select("video_id", inside("start"), inside("end")).filter(F.col("end") - F.col("start") >= least).join(held, "video_id", "left")
    cut = cut.withColumn("ts", F.coalesce("ts", F.expr("cast(array() as array<double>)")))
    return geometry.without_overlaps(split_long(cut, most, least, tolerance), "video_id", slack, count)


def clamp(segments: DataFrame, least: float = 3.0, most: float = 15.0) -> DataFrame:
    kept = segments.filter(F.col("end") - F.col("start") >= least)
    return kept.withColumn("end", F.least("end", F.col("start") + most))
