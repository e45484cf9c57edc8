"""Text boxes: geometry, per-frame metrics, per-clip persistence; intervals and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values: defaults of the limits and the promotional words ----------------
CENTER_START, BOTTOM_START = 0.25, 0.72
BAND_WIDTH, BAND_HEIGHT = 0.70, 0.08
WATERMARK_AREA, WATERMARK_MARGIN, SMALL_AREA, CENTER_AREA = 0.02, 0.18, 0.02, 0.10
PROMOTION = ("价格", "优惠", "特价", "私信", "咨询", "联系电话", "电话", "微信", "下单", "购买", "厂家", "扫码", "批发", "包邮", "限时")
# ---- end of fixed values -----------------------------------------------------------


def geometry(regions: DataFrame, center_start: float = CENTER_START, bottom_start: float = BOTTOM_START) -> DataFrame:
    """Boxes with their ratios, centre, zone, and whether they are a small mark in a corner."""
    width = F.bround(F.greatest(F.col("x2") - F.col("x1"), F.lit(0.0)), 4)
    height = F.bround(F.greatest(F.col("y2") - F.col("y1"), F.lit(0.0)), 4)
    area = F.bround(width * height, 5)
    middle = lambda a, b: F.bround((F.col(a) + F.col(b)) / 2, 4)
    zone = F.when(middle("y1", "y2") < center_start, "top").when(middle("y1", "y2") < bottom_start, "center").otherwise("bottom")
    side = lambda low, high: (F.col(high) <= WATERMARK_MARGIN) | (F.col(low) >= 1 - WATERMARK_MARGIN)
    mark = (area <= WATERMARK_AREA) & side("x1", "x2") & side("y1", "y2")
    return regions.select("*", width.alias("width"), height.alias("height"), area.alias("area"), middle("x1", "x2").alias("center_x"), middle("y1", "y2").alias("center_y"), zone.alias("zone"), mark.alias("watermark"))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, F.bround(w * h / union, 6)).otherwise(0.0)


def frames(regions: DataFrame, sampled: DataFrame, words: tuple[str, ...] = PROMOTION) -> DataFrame:
    """Per sampled frame: boxes, area by zone, bands, watermarks, significant zones, promotion; frames without a box are rows too."""
    boxes = geometry(regions)
    has = F.col("area").isNotNull()
    total = lambda cond: F.bround(F.sum(F.when(cond, F.col("area")).otherwise(0.0)), 5)
    large = F.col("area") > SMALL_AREA
    return sampled.join(boxes, ["clip_id", "frame"], "left").groupBy("clip_id", "frame").agg(
        F.count_if(has).alias("boxes"), F.count_if(large).alias("significant"), total(has).alias("area"), F.coalesce(F.max("area"), F.lit(0.0)).alias("largest"),
        *[total(F.col("zone") == z).alias(f"{z}_area") for z in ("top", "center", "bottom")],
        F.count_if((F.col("width") >= BAND_WIDTH) & (F.col("height") >= BAND_HEIGHT)).alias("bands"), total(F.col("watermark")).alias("watermark_area"),
        F.sort_array(F.collect_set(F.when(large, F.col("zone")))).alias("zones"), F.sort_array(F.collect_set("zone")).alias("all_zones"),
        F.coalesce(F.bool_or(F.col("words").rlike("|".join(words))), F.lit(False)).alias("promotion"),
    )


def temporal(frames: DataFrame, digits: int = 5) -> DataFrame:
    """Per clip: the six persistence ratios over its sampled frames, averages, and what the classes need."""
    n = F.count("*")
    share = lambda cond: F.bround(F.count_if(cond) / n, 4)
    mean = lambda c: F.bround(F.sum(c) / n, digits)
    shown = F.when(F.size("zones") > 0, F.col("zones")).otherwise(F.col("all_zones"))
    any_text = F.max("boxes") > 0
    return frames.groupBy("clip_id").agg(
        share(F.col("boxes") > 0).alias("presence"), share(F.col("bottom_area") > 0).alias("bottom"), share(F.col("center_area") >= CENTER_AREA).alias("center"),
        share(F.col("largest") >= CENTER_AREA).alias("large"), share(F.size(shown) >= 2).alias("multi"), share(F.col("bands") > 0).alias("band"),
        mean("area").alias("avg_area"), *[mean(f"{z}_area").alias(f"avg_{z}") for z in ("top", "center", "bottom")],
        F.max("boxes").alias("most_boxes"), F.max("significant").alias("most_significant"),
        (any_text & F.bool_and((F.col("boxes") == 0) | (F.col("watermark_area") >= F.col("area") - 1e-9))).alias("watermark_only"),
        (F.count_if(F.col("promotion")) >= F.greatest(F.lit(1), F.floor(n / 2))).alias("promotion"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("zones")))).alias("zones"),
    )


def matched_regions(regions: DataFrame, least_iou: float = 0.3, most_distance: float = 0.08) -> DataFrame:
    """Each box (``clip_id, frame, box``) with ``match``, a box of the frame before.

    The box that overlaps most is taken, from ``least_iou`` on; where none does, the first
    one whose centre lies within ``most_distance``; else there is no match (null). Ties go
    to the smaller number. Frames hold a few boxes, so the pairs of a frame are few.
    """
    sized = geometry(regions).select("clip_id", "frame", "box", "x1", "y1", "x2", "y2", "area", "center_x", "center_y")
    mine = ("x1", "y1", "x2", "y2", "area", "center_x", "center_y")
    before = sized.select("clip_id", (F.col("frame") + 1).alias("frame"), F.col("box").alias("other"), *[F.col(c).alias(f"p_{c}") for c in mine])
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(high, f"p_{high}") - F.greatest(low, f"p_{low}"))
    shared = side("x1", "x2") * side("y1", "y2")
    union = F.col("area") + F.col("p_area") - shared
    overlap = F.when(union > 0, F.bround(shared / union, 4)).otherwise(0.0)
    dx, dy = F.col("center_x") - F.col("p_center_x"), F.col("center_y") - F.col("p_center_y")
    rank = F.when(overlap >= least_iou, overlap).when(F.bround(F.sqrt(dx * dx + dy * dy), 4) <= most_distance, 0.0)
    best = F.min(F.when(rank.isNotNull(), F.struct((-rank).alias("rank"), "other")))
    return sized.join(before, ["clip_id", "frame"], "left").groupBy("clip_id", "frame", "box").agg(best.alias("m")).select("clip_id", "frame", "box", F.col("m.other").alias("match"))


def intervals(points: DataFrame, keys: list[str], at: str, gap: float, pad: float) -> DataFrame:
    """Timestamps joined into intervals where the gap is small, padded, and merged where they meet."""
    w = Window.partitionBy(*keys).orderBy(at)
    opens = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True)).cast("int")
    runs = points.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w))
    padded = runs.groupBy(*keys, "run").agg((F.min(at) - pad).alias("start"), (F.max(at) + pad).alias("end"))
    v = Window.partitionBy(*keys).orderBy("start")
    apart = padded.withColumn("opens", F.coalesce(F.col("start") > F.max("end").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    return apart.withColumn("island", F.sum("opens").over(v)).groupBy(*keys, "island").agg(F.greatest(F.min("start"), F.lit(0.0)).alias("start"), F.max("end").alias("end")).drop("island")


def without_overlaps(segments: DataFrame, key: str, slack: float = 0.5, most: int = 12) -> DataFrame:
    """Segments in order of start; one that begins before the last kept one ends (less ``slack``) is dropped, and ``most`` stay."""
    ordered = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    empty = F.expr("cast(array() as array<struct<start:double,end:double>>)")

    def fold(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(last.isNull() | (s["start"] >= last["end"] - slack), F.concat(kept, F.array(s))).otherwise(kept)

    kept = F.slice(F.aggregate("s", empty, fold), 1, most)
    return ordered.select(key, F.explode(kept).alias("s")).select(key, "s.start", "s.end")
