"""Ordered rule cascades of intake: candidates, previews, durations, clip acceptance; the first rule that holds names the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest duration in seconds and frames of each band, fixed values.
FRAME_BANDS = ((15.0, 6), (45.0, 8), (90.0, 10))


def unrelated_title(title: Column, material: Column, off_topic: list[str]) -> Column:
    """A title with an off-topic word is unrelated unless it shares the material or a character of it."""
    shares = F.contains(title, material) | F.exists(F.split(material, ""), lambda c: (c != "") & (c != " ") & F.contains(title, c))
    hit = F.lit(False)
    for word in off_topic:
        hit = hit | F.contains(title, F.lit(word))
    return hit & ~shares


def frame_count(seconds: Column, bands=FRAME_BANDS, beyond: int = 12, floor: int = 3, ceiling: int = 12) -> Column:
    """Frames by the first band of duration that fits; an unknown duration takes the first band."""
    number = F.when(seconds.isNull() | (seconds <= 0), bands[0][1])
    for most, frames in bands:
        number = number.when(seconds <= most, frames)
    return F.greatest(F.lit(floor), F.least(F.lit(ceiling), number.otherwise(beyond)))


def _spread(start: Column, width: Column, n: Column) -> Column:
    """``n`` (at least one) middles of equal parts."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + width * (i + 0.5) / n)


def frame_times(seconds: Column, n: Column, strategy: str = "uniform", digits: int = 3) -> Column:
    """Distinct ascending timestamps in a video; none without a duration, 0 alone in one of 0.05 s or less.

    ``uniform``: middles of equal parts. ``uniform_edges`` (from 4 frames on): a third of them
    in the first 15 percent, a third in the last, the rest around the middle.
    ``dense_start`` (from 3 on): half of them in the first 40 percent.
    """
    none, zero, third, half = F.array().cast("array<double>"), F.lit(0.0), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    made = _spread(zero, seconds, n)
    if strategy == "uniform_edges":
        middle = F.greatest(F.lit(1), n - 2 * third)
        edges = F.concat(_spread(zero, seconds * 0.15, third), _spread(seconds * 0.35, seconds * 0.3, middle), _spread(seconds - seconds * 0.15, seconds * 0.15, third))
        made = F.when(n >= 4, edges).otherwise(made)
    elif strategy == "dense_start":
        made = F.when(n >= 3, F.concat(_spread(zero, seconds * 0.4, half), _spread(seconds * 0.4, seconds * 0.6, n - half))).otherwise(made)
    inside = F.transform(made, lambda x: F.bround(F.greatest(zero, F.least(x, seconds)), digits))
    none_left = F.coalesce(seconds <= 0, F.lit(True)) | (n <= 0)
    return F.when(none_left, none).when(seconds <= 0.05, F.array(zero)).otherwise(F.array_sort(F.array_distinct(inside)))


def clip_times(start: Column, end: Column, n: Column, low: float = 0.2, high: float = 0.8, margin: float = 0.05, digits: int = 3) -> Column:
    """Timestamps at ``n`` even positions between two shares of a clip (one: the third fifth), off its very ends."""
    span = F.greatest(F.lit(0.0), end - start)
    edge = F.least(F.lit(margin), span / 4)
    step = F.when(n > 1, F.lit(high - low) / (n - 1)).otherwise(0.0)
    share = lambda i: F.when(n > 1, F.bround(low + step * i, 4)).otherwise(0.6)
    at = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.bround(F.least(F.greatest(start + span * share(i), start + edge), end - edge), digits))
    return F.when(span <= 0, F.array().cast("array<double>")).otherwise(F.array_distinct(at))


def frame_plan(videos: DataFrame, digits: int = 3) -> DataFrame:
    """``source_id, strategy, at``: the timestamps of the three ways to sample a video, and of tagging it as one clip of four frames."""
    seconds, n = F.col("seconds"), frame_count(F.col("seconds"))
    plans = [(s, frame_times(seconds, n, s, digits)) for s in ("uniform", "uniform_edges", "dense_start")]
    plans.append(("clip", clip_times(F.lit(0.0), seconds, F.lit(4), digits=digits)))
    every = F.array(*[F.struct(F.lit(s).alias("strategy"), times.alias("times")) for s, times in plans])
    return videos.select("source_id", F.explode(every).alias("p")).select("source_id", "p.strategy", F.explode("p.times").alias("at"))


def removed(tags: DataFrame, clips: DataFrame) -> DataFrame:
    """Bridge rows of clips that still exist."""
    return tags.join(clips.select("clip_id"), "clip_id", "left_semi")


def retagged(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Bridge rows with those of the retagged clips replaced."""
    return tags.join(new.select("clip_id").distinct(), "clip_id", "left_anti").unionByName(new)


def linked(runs: DataFrame, clips: DataFrame) -> DataFrame:
    """Runs without a clip get the first clip of their source."""
    first = clips.groupBy("source_id").agg(F.min("clip_id").alias("first_clip"))
    return runs.join(first, "source_id", "left").select("run_id", "source_id", F.coalesce("clip_id", "first_clip").alias("clip_id"))


def cache_misses(work: DataFrame, cache: DataFrame) -> DataFrame:
    return work.join(cache.select("cache_key"), "cache_key", "left_anti")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by one aggregation instead of a window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("m"))
    return best.select(*keys, "m.*")


def task_history(sources: DataFrame, clips: DataFrame) -> DataFrame:
    """Per task: sources, clips, the categories they fell in."""
    made = clips.groupBy("source_id").agg(F.count("*").alias("clips"), F.collect_set("category").alias("categories"))
    joined = sources.select("task_id", "source_id").join(made, "source_id", "left")
    categories = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))), "|")
    return joined.groupBy("task_id").agg(F.count("*").alias("sources"), F.coalesce(F.sum("clips"), F.lit(0)).alias("clips"), categories.alias("categories"))


def effectiveness(progress: DataFrame) -> DataFrame:
    """Hit rate and cost per qualifying clip of each plan."""
    sums = progress.groupBy("plan_id").agg(*[F.sum(c).alias(c) for c in ("clips", "qualifying", "downloads", "tokens")])
    per = lambda c: F.when(F.col("qualifying") > 0, F.bround(F.col(c) / F.col("qualifying"), 3))
    rate = F.when(F.col("clips") > 0, F.bround(F.col("qualifying") / F.col("clips"), 3))
    return sums.select("plan_id", "clips", "qualifying", rate.alias("hit_rate"), (F.col("clips") - F.col("qualifying")).alias("off_target"), per("tokens").alias("tokens_per_clip"), per("downloads").alias("downloads_per_clip"))
