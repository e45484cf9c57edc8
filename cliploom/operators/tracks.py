"""Text boxes followed over time: tracks of a clip, their figures, the stable ones, and masks over these.

Everything of a clip lies in arrays of its sampled boxes, whose number the sampling bounds (``SAMPLES``
timestamps); the fold over them runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_even

# ---- fixed values ----
SAMPLES, SAMPLE_FPS = 240, 2.0
LEAST_CONFIDENCE, LEAST_IOU, MOST_DISTANCE = 0.30, 0.20, 0.10
#: Gap in seconds that still belongs to an interval, and what is added at its ends.
GAP, PADDING = max(0.4, 2.5 / SAMPLE_FPS), 0.20
TEXTS = 8
STABLE = {"samples": 2, "persistence": 0.55, "seconds": 0.30, "jitter": 0.05, "growth": 0.75, "area": 0.10, "union_area": 0.15}
MASK = {"margin": 0.02, "pixels": 4, "width": 0.90, "height": 0.30, "area": 0.10, "total": 0.20, "count": 3}
# ---- end of fixed values ----
_BOX = ("t", "x1", "y1", "x2", "y2", "area", "cx", "cy", "text")
_STATE = "array<struct<t:double,x1:double,y1:double,x2:double,y2:double,area:double,cx:double,cy:double,text:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _score(box: Column, last: Column) -> Column:
    """How well a box goes on with a track whose last box is ``last``; null if it does not."""
    wide = F.least(box["x2"], last["x2"]) - F.greatest(box["x1"], last["x1"])
    tall = F.least(box["y2"], last["y2"]) - F.greatest(box["y1"], last["y1"])
    union = box["area"] + last["area"] - wide * tall
    overlap = F.when((wide > 0) & (tall > 0) & (union > 0), round_even(wide * tall / union, 4)).otherwise(0.0)
    across, down = box["cx"] - last["cx"], box["cy"] - last["cy"]
    far = round_even(F.sqrt(across * across + down * down), 4)
    near = (F.abs(down) <= MOST_DISTANCE) & (far <= MOST_DISTANCE * 1.6)
    fits = F.when(overlap >= LEAST_IOU, 1.0 + overlap).when(near, 0.5 + F.greatest(F.lit(0.0), 1.0 - far))
    return F.when(last["t"] != box["t"], fits)


def tracks(boxes: DataFrame) -> DataFrame:
    """Boxes of a clip joined greedily over time: ``clip_id, t, x1, y1, x2, y2, text, track``.

    In order of time and left edge every box goes to the track whose last box it overlaps most, or else
    is nearest to, the oldest track first; a track takes one box per timestamp (milliseconds). Boxes below
    the least confidence are left out. Columns ``confidence`` and ``text`` may be missing.
    """
    have = set(boxes.columns)
    text = F.col("text") if "text" in have else F.lit(None).cast("string")
    rows = boxes.filter(F.col("confidence") >= LEAST_CONFIDENCE) if "confidence" in have else boxes
    side = lambda a, b: round_even(F.greatest(F.lit(0.0), F.col(b) - F.col(a)), 4)
    middle = lambda a, b: round_even((F.col(a) + F.col(b)) / 2, 4)
    sized = rows.select("clip_id", round_even("t", 3).alias("t"), "x1", "y1", "x2", "y2", round_even(side("x1", "x2") * side("y1", "y2"), 5).alias("area"), middle("x1", "x2").alias("cx"), middle("y1", "y2").alias("cy"), text.alias("text"))
    clips = sized.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct(*_BOX))).alias("boxes"))

    def step(state: Column, box: Column) -> Column:
        scored = F.transform(state["last"], lambda last, k: _let(_score(box, last), lambda s: F.when(s.isNotNull(), F.struct(s.alias("s"), (-k).alias("k")))))
        place = F.coalesce(-F.array_max(scored)["k"], F.size(state["last"]))
        moved = lambda at: F.when(at == F.size(state["last"]), F.concat(state["last"], F.array(box))).otherwise(F.transform(state["last"], lambda last, k: F.when(k == at, box).otherwise(last)))
        return _let(place, lambda at: F.struct(moved(at).alias("last"), F.concat(state["track"], F.array(at)).alias("track")))

    start = F.struct(F.array().cast(_STATE).alias("last"), F.array().cast("array<int>").alias("track"))
    found = clips.withColumn("track", F.aggregate("boxes", start, step, lambda state: state["track"]))
    each = found.select("clip_id", F.explode(F.arrays_zip("boxes", "track")).alias("b"))
    return each.select("clip_id", "b.boxes.t", "b.boxes.x1", "b.boxes.y1", "b.boxes.x2", "b.boxes.y2", "b.boxes.text", F.col("b.track").cast("long").alias("track"))


def intervals(times: Column, gap: float = GAP, padding: float = PADDING) -> Column:
    """Ascending times as padded intervals; times that are no more than ``gap`` apart, or whose padding meets, are in one."""

    def step(found: Column, t: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        own = F.struct(F.greatest(F.lit(0.0), t - padding).alias("start"), (t + padding).alias("end"), t.alias("last"))
        joins = F.coalesce((t - last["last"] <= gap) | (t - padding <= last["last"] + padding), F.lit(False))
        longer = F.struct(last["start"].alias("start"), (t + padding).alias("end"), t.alias("last"))
        return F.when(joins, F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(longer))).otherwise(F.concat(found, F.array(own)))

    folded = F.aggregate(times, F.array().cast("array<struct<start:double,end:double,last:double>>"), step)
    return F.transform(folded, lambda x: F.struct(F.bround(x["start"], 3).alias("start"), F.bround(x["end"], 3).alias("end")))


def stats(tracked: DataFrame, samples: int | None = None) -> DataFrame:
    """Per track: timestamps, persistence over the clip's ``samples`` (those with a box, if not given), times, median and union box,
    jitter around the median centre, growth of the union, active intervals, first texts, and ``place`` by persistence and union."""
    names = ("x1", "y1", "x2", "y2")
    of = lambda name: F.sort_array(F.collect_set(name))
    middle = lambda a, b: round_even((F.col(a) + F.col(b)) / 2, 4)
    rows = tracked.select("clip_id", "track", "t", *names, "text", middle("x1", "x2").alias("cx"), middle("y1", "y2").alias("cy"))
    spoken = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("t", "x1", "y1", F.trim("text").alias("text")))), lambda b: b["text"]), lambda x: x.isNotNull() & (x != ""))
    by = rows.groupBy("clip_id", "track").agg(
        of("t").alias("times"), *[F.median(c).alias(f"m_{c}") for c in names], F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.collect_list(F.struct("cx", "cy")).alias("centres"), F.slice(F.array_distinct(spoken), 1, TEXTS).alias("texts"),
    )
    if samples is None:
        by = by.join(tracked.groupBy("clip_id").agg(F.countDistinct("t").alias("total")), "clip_id")
    else:
        by = by.withColumn("total", F.lit(max(1, samples)))
    mx, my = (F.col("m_x1") + F.col("m_x2")) / 2, (F.col("m_y1") + F.col("m_y2")) / 2
    most = lambda f: round_even(F.array_max(F.transform("centres", f)), 5)
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    median, union = F.greatest(F.lit(1e-9), area("m_")), F.greatest(F.lit(0.0), area(""))
    shown = by.select(
        "clip_id", "track", F.size("times").alias("sample_count"), "total", round_even(F.least(F.lit(1.0), F.size("times") / F.col("total")), 4).alias("persistence"),
        F.array_min("times").alias("first_seen"), F.array_max("times").alias("last_seen"), *[round_even(f"m_{c}", 5).alias(f"median_{c}") for c in names], *[round_even(c, 5).alias(c) for c in names],
        most(lambda p: F.abs(p["cy"] - my)).alias("vertical_jitter"), most(lambda p: F.sqrt((p["cx"] - mx) * (p["cx"] - mx) + (p["cy"] - my) * (p["cy"] - my))).alias("center_jitter"),
        round_even(F.greatest(F.lit(0.0), union / median - 1), 4).alias("growth"), round_even(median, 5).alias("median_area"), round_even(union, 5).alias("union_area"), intervals(F.col("times")).alias("intervals"), "texts",
    )
    order = Window.partitionBy("clip_id").orderBy(F.desc("persistence"), F.desc("union_area"), "track")
    return shown.withColumn("place", F.row_number().over(order))


def stable(found: DataFrame, limits: dict[str, float] = STABLE) -> DataFrame:
    """Tracks that pass all seven thresholds; the time rule spares those that are nearly always there."""
    brief = (F.col("persistence") < 0.9) & (F.col("last_seen") - F.col("first_seen") < limits["seconds"])
    return found.filter(
        (F.col("sample_count") >= max(2, limits["samples"])) & (F.col("persistence") >= limits["persistence"]) & ~brief & (F.col("vertical_jitter") <= limits["jitter"])
        & (F.col("growth") <= limits["growth"]) & (F.col("median_area") <= limits["area"]) & (F.col("union_area") <= limits["union_area"])
    )


def masks(steady: DataFrame, clips: DataFrame, guards: dict[str, float] = MASK) -> DataFrame:
    """Per clip the widened boxes of its largest safe stable tracks, or one row with the reason why there is none.

    A margin is a share of the picture, or a number of pixels where that is more; ``clips`` has each clip's ``width``
    and ``height``. Guards on width, height and area come before the choice of the largest, the
    guard on the total after it.
    """
    rows = steady.join(clips.select("clip_id", "width", "height").distinct(), "clip_id")
    margin = lambda c: F.greatest(F.lit(guards["margin"]), guards["pixels"] / F.greatest(F.lit(1), c))
    inside = lambda v: round_even(F.greatest(F.lit(0.0), F.least(v, F.lit(1.0))), 5)
    across, down = margin("width"), margin("height")
    boxes = rows.select("clip_id", "track", "place", inside(F.col("x1") - across).alias("x1"), inside(F.col("y1") - down).alias("y1"), inside(F.col("x2") + across).alias("x2"), inside(F.col("y2") + down).alias("y2"), "persistence", "intervals")
    wide, tall = round_even(F.col("x2") - F.col("x1"), 5), round_even(F.col("y2") - F.col("y1"), 5)
    sized = boxes.withColumn("area", round_even(wide * tall, 5))
    safe = (wide > 0) & (tall > 0) & (wide <= guards["width"]) & (tall <= guards["height"]) & (F.col("area") <= guards["area"])
    item = F.struct((-F.col("area")).alias("o"), "place", "track", "x1", "y1", "x2", "y2", "area", "persistence", "intervals")
    best = sized.groupBy("clip_id").agg(F.slice(F.array_sort(F.array_compact(F.collect_list(F.when(safe, item)))), 1, int(guards["count"])).alias("m"))
    joined = clips.select("clip_id").distinct().join(best, "clip_id", "left")
    total = round_even(F.aggregate("m", F.lit(0.0), lambda a, x: a + x["area"]), 5)
    reason = F.when(F.col("m").isNull(), "no_stable_subtitle_track").when(F.size("m") == 0, "mask_geometry_guard").when(total > guards["total"], "mask_total_area_guard")
    shown = joined.withColumn("reason", reason).select("clip_id", "reason", F.explode_outer(F.when(reason.isNull(), F.col("m"))).alias("m"))
    return shown.select("clip_id", "m.track", "m.x1", "m.y1", "m.x2", "m.y2", "m.area", "m.persistence", "m.intervals", "reason")
