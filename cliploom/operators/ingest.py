"""Candidate intake: probe reports, in-run duplicates, collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROBE = """struct<format:struct<duration:string>, streams:array<struct<codec_type:string, duration:string, width:int, height:int, nb_frames:string, r_frame_rate:string>>>"""


def probe(reports: DataFrame, column: str = "report") -> DataFrame:
    """Duration by format, video, audio, then frames / rate; size and frame rate of the video stream."""
    rows = reports.withColumn("p", F.from_json(column, PROBE))
    of = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), 0)
    video, audio = of("video"), of("audio")
    part = F.split(video["r_frame_rate"], "/")
    rate = F.try_divide(F.get(part, 0).try_cast("double"), F.coalesce(F.get(part, 1).try_cast("double"), F.lit(1.0)))
    fps = F.when(rate.between(1, 240), rate)
    seconds = F.coalesce(F.col("p.format.duration").try_cast("double"), video["duration"].try_cast("double"), audio["duration"].try_cast("double"), F.try_divide(video["nb_frames"].try_cast("double"), fps))
    return rows.select(*[c for c in reports.columns if c != column], seconds.alias("seconds"), video["width"].alias("width"), video["height"].alias("height"), F.bround(fps, 3).alias("fps"), audio.isNotNull().alias("has_audio"))


def in_run_duplicates(hits: DataFrame) -> DataFrame:
    """Marks every candidate of a task after its first appearance."""
    place = F.row_number().over(Window.partitionBy("task_id", "video_id").orderBy("seq"))
    return hits.withColumn("duplicate", place > 1)


def collapse(hits: DataFrame) -> DataFrame:
    """One row per candidate of all queries: first by id, then by url where there is one, its query string, fragment and last slashes aside; queries in order of appearance."""
    in_order = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("q")))), lambda s: s["q"]))
    by_id = hits.groupBy("video_id").agg(F.min("seq").alias("seq"), F.min_by("url", "seq").alias("url"), in_order("query").alias("queries"))
    merged = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "queries"))), lambda s: s["queries"])))
    plain = F.rtrim(F.substring_index(F.substring_index(F.trim("url"), "?", 1), "#", 1), F.lit("/"))
    own = F.coalesce(F.nullif(plain, F.lit("")), F.concat(F.lit("id "), "video_id"))
    return by_id.groupBy(own.alias("key")).agg(F.min_by("url", "seq").alias("url"), F.min_by("video_id", "seq").alias("video_id"), F.min("seq").alias("seq"), merged.alias("queries")).drop("key")
