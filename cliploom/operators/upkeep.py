"""Library upkeep: provenance, reviews, files, audits, discovery merges, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVIEW_WORDS = ("unreviewed", "approved", "rejected", "needs_work")
TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes", "y"), ("0", "false", "no", "n", "")


def import_reviews(reviews: DataFrame, clips: DataFrame) -> DataFrame:
    """One row per review line: the change it makes, or why it is skipped."""
    known = clips.select(F.col("clip_id").alias("known_id"), F.col("review_status").alias("old_status"), F.col("favorite").alias("old_favorite"))
    number = F.col("clip_id_text").try_cast("long")
    word = F.lower(F.trim("favorite_text"))
    joined = reviews.withColumn("number", number).join(known, F.col("number") == F.col("known_id"), "left")
    favorite = F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    same = (F.col("status") == F.col("old_status")) & (favorite == F.col("old_favorite"))
    outcome = (
        F.when(F.col("number").isNull(), "skipped:bad_id").when(F.col("known_id").isNull(), "skipped:unknown_id").when(~F.col("status").isin(*REVIEW_WORDS), "skipped:bad_status")
        .when(favorite.isNull(), "skipped:bad_boolean").when(same, "skipped:unchanged").otherwise("changed")
    )
    return joined.select("line", outcome.alias("outcome"), "old_status", F.col("status").alias("new_status"))


def apply_reviews(clips: DataFrame, changes: DataFrame) -> DataFrame:
    held = changes.select("clip_id", F.col("status").alias("new_status"))
    joined = clips.join(held, "clip_id", "left")
    return joined.select("clip_id", F.coalesce("new_status", "review_status").alias("review_status"))


def audit(tagged: DataFrame) -> DataFrame:
    """Per prompt version: how many descriptions and score vectors differ, and the commonest stage's share.

    Texts are grouped by hash, so that one boilerplate text costs a counter, not its copies.
    """
    vector = F.xxhash64("overall", "material_score", "visual")
    base = tagged.groupBy("version").agg(F.count("*").alias("n"), F.countDistinct(F.md5("description")).alias("descriptions"), F.countDistinct(vector).alias("vectors"), F.countDistinct("stage").alias("stages"))
    top = tagged.groupBy("version", "stage").agg(F.count("*").alias("k")).groupBy("version").agg(F.max("k").alias("top"))
    joined = base.join(top, "version")
    return joined.select("version", "n", "descriptions", "vectors", "stages", F.bround(F.col("top") / F.col("n"), 4).alias("top_stage_share"), (F.col("stages") == 1).alias("single_stage"))


def identical_groups(tagged: DataFrame) -> DataFrame:
    by = tagged.groupBy("version", F.md5("description").alias("text_md5")).agg(F.count("*").alias("n"), F.min("clip_id").alias("first_id"))
    return by.filter("n > 1")


def merge_discovery(stored: DataFrame, found: DataFrame) -> DataFrame:
    """A rediscovered source keeps what it has: queries are appended, blank fields filled."""
    new = found.groupBy("source_id").agg(F.array_sort(F.collect_set("query")).alias("new_queries"), F.min("author").alias("new_author"))
    both = stored.join(new, "source_id", "left")
    queries = F.array_union(F.split("matched", r"\|"), F.coalesce("new_queries", F.expr("cast(array() as array<string>)")))
    author = F.when(F.coalesce(F.trim("author"), F.lit("")) == "", F.col("new_author")).otherwise(F.col("author"))
    return both.select("source_id", F.array_join(queries, "|").alias("matched"), author.alias("author"))


def release(sources: DataFrame, stopped: DataFrame) -> DataFrame:
    """Sources in progress of stopped tasks wait again."""
    held = sources.join(stopped.select("task_id").distinct().withColumn("stopped", F.lit(True)), "task_id", "left")
    freed = F.coalesce("stopped", F.lit(False)) & (F.col("status") == "downloading")
    return held.select("source_id", F.when(freed, "discovered").otherwise(F.col("status")).alias("status"))


def subtitle_report(clips: DataFrame) -> DataFrame:
    """Clips and mean cleanliness per category and bucket of text classes."""
    kind = F.col("subtitle_type")
    bucket = F.when(kind == "none", "clean").when(kind.isin("bottom_simple", "top_simple", "single_region", "watermark_only"), "simple").when(kind == "unknown", "unknown").otherwise("hard")
    return clips.groupBy("category", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.bround(F.avg(1 - F.col("subtitle_score")), 4).alias("avg_cleanliness"))


def production_ready(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """Per category: clips that are approved or unreviewed, clean enough, of a stored source, and 3 to 15 seconds long."""
    stored = sources.select("source_id").distinct().withColumn("stored", F.lit(True))
    ok = F.col("review_status").isin("approved", "unreviewed", "") & (F.col("subtitle_score") <= 0.35) & F.coalesce("stored", F.lit(False)) & F.col("duration").between(3, 15)
    return clips.join(stored, "source_id", "left").groupBy("category").agg(F.count("*").alias("n"), F.count_if(ok).alias("ready"))


def draft(gaps: DataFrame, most: int) -> DataFrame:
    """Requested clips per gap in order of priority, under a running cap."""
    from pyspark.sql import Window

    order = Window.partitionBy("category").orderBy("priority_order", F.desc("missing"), "stage").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("missing").over(order), F.lit(0))
    asked = F.greatest(F.least("missing", F.lit(most) - before), F.lit(0))
    return gaps.withColumn("requested", asked).filter("requested > 0").select("category", "stage", "missing", "requested")
