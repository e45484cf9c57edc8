"""Model usage, per-source, per-author and per-task reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPERATIONS = ("preview", "tagging", "expansion")


def _sums() -> list:
    ok = F.col("status") == "ok"
    return [
        F.count("*").alias("calls"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.bround(F.avg("latency_ms"), 3).alias("avg_latency_ms"),
    ]


def by_model(runs: DataFrame) -> DataFrame:
    return runs.groupBy("provider", "model").agg(*_sums())


def by_operation(runs: DataFrame) -> DataFrame:
    """The three operations, zero-filled."""
    known = runs.sparkSession.createDataFrame([(o,) for o in OPERATIONS], "operation string")
    sums = runs.groupBy("operation").agg(*_sums(), F.bround(F.avg("frames"), 3).alias("avg_frames"))
    joined = F.broadcast(known).join(sums, "operation", "full")  # three rows
    counts = ("calls", "ok", "failed", "prompt_tokens", "completion_tokens")
    return joined.select("operation", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "avg_latency_ms", "avg_frames")


def cost_per_clip(runs: DataFrame, clips: DataFrame) -> DataFrame:
    """Totals of pipeline runs against the number of clips; null without clips."""
    spent = runs.filter("origin = 'pipeline'").agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).alias("tokens"))
    both = spent.crossJoin(clips.agg(F.count("*").alias("clips")))  # one row each
    per = lambda c: F.when(F.col("clips") > 0, F.bround(F.col(c) / F.col("clips"), 3))
    return both.select("calls", "tokens", "clips", per("tokens").alias("tokens_per_clip"), per("calls").alias("calls_per_clip"))


def clip_totals(clips: DataFrame) -> DataFrame:
    return clips.groupBy("source_id").agg(F.count("*").alias("clips"), F.count_if(F.col("review_status") == "approved").alias("approved"), F.sum("overall").alias("overall_sum"))


def source_yield(sources: DataFrame, clips: DataFrame) -> DataFrame:
    joined = sources.join(clip_totals(clips), "source_id")
    return joined.select("source_id", "author", "clips", "approved", F.bround(F.col("overall_sum") / F.col("clips"), 3).alias("avg_overall"))


def author_yield(sources: DataFrame, clips: DataFrame) -> DataFrame:
    by = sources.join(clip_totals(clips), "source_id").groupBy("author")
    return by.agg(F.count("*").alias("videos"), F.sum("clips").alias("clips"), F.sum("approved").alias("approved"), F.bround(F.sum("overall_sum") / F.sum("clips"), 3).alias("avg_overall"))


def task_performance(sources: DataFrame, clips: DataFrame, runs: DataFrame) -> DataFrame:
    """Each child is brought to one row per source first, so that joins multiply nothing."""
    spent = runs.groupBy("source_id").agg(F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))
    made = clip_totals(clips).select("source_id", "clips")
    by = sources.select("source_id", "task_id").join(made, "source_id", "left").join(spent, "source_id", "left").groupBy("task_id")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = by.agg(F.count("*").alias("candidates"), total("clips"), total("calls"), total("tokens"))
    return sums.withColumn("tokens_per_clip", F.when(F.col("clips") > 0, F.bround(F.col("tokens") / F.col("clips"), 3)))


def latest_per_source(runs: DataFrame) -> DataFrame:
    """The newest run of each source and operation."""
    newest = Window.partitionBy("source_id", "operation").orderBy(F.desc("run_id"), F.desc("prompt_tokens"), F.desc("latency_ms"), "model")
    return runs.withColumn("place", F.row_number().over(newest)).filter("place = 1").select("source_id", "operation", "run_id", "prompt_tokens")
