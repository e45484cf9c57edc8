"""Reading a clip library: filters, pages, rule cascades, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import materials

# ---- fixed values ----
HARD_SUBTITLES = ("multi_region", "colored_block", "complex")
SUBTITLE_LIMITS = {"strict": 0.35, "balanced": 0.5, "loose": 0.7, "off": 1.0}
# ---- end of fixed values ----
CLEANABLE = ("bottom_simple", "top_simple", "single_region", "watermark_only")


def clip_filter(clips: DataFrame, equal: dict | None = None, among: dict | None = None, between: dict | None = None) -> DataFrame:
    """Equality, IN and closed-range conditions; they reach the scan as pushed filters."""
    for column, value in (equal or {}).items():
        clips = clips.filter(F.col(column) == value)
    for column, values in (among or {}).items():
        clips = clips.filter(F.col(column).isin(*values))
    for column, (low, high) in (between or {}).items():
        clips = clips.filter(F.col(column).between(low, high))
    return clips


def quality_gate(
    clips: DataFrame, limits: dict[str, float] | None = None, least_duration: float = 3.0, most_duration: float = 15.0,
    material: float = 0.6, visual: float = 0.5, overall: float = 0.55, otherwise: float = 0.25,
) -> DataFrame:
    """``clip_id, accepted, reason, subtitle_rejected``: the first rule that a clip breaks, and null reason if it breaks none.

    ``limits`` holds the highest subtitle score of each ``policy`` (others: ``otherwise``); a
    ``required_material`` must have the base name of the clip's ``material``, a blank one asks nothing.
    """
    policy = F.create_map(*[F.lit(x) for pair in (limits or SUBTITLE_LIMITS).items() for x in pair])
    limit = F.coalesce(policy[F.coalesce("policy", F.lit(""))], F.lit(otherwise))
    wanted, seen = (materials.material_base(F.trim(F.coalesce(c, F.lit("")))) for c in ("required_material", "material"))
    hard, heavy = F.col("subtitle_type").isin(*HARD_SUBTITLES), F.col("subtitle_score") > limit
    reason = (
        F.when(F.col("duration") < least_duration, "segment_too_short")
        .when(F.col("duration") > most_duration, "quality_gate")
        .when(hard | heavy, "subtitle_too_complex")
        .when((wanted != "") & (seen != wanted), "no_material")
        .when(F.col("material_score") < material, "no_material")
        .when(F.col("visual") < visual, "low_quality")
        .when(F.col("overall") < overall, "quality_gate")
    )
    return clips.select("clip_id", reason.alias("reason")).select("clip_id", F.col("reason").isNull().alias("accepted"), "reason", F.coalesce(F.col("reason") == "subtitle_too_complex", F.lit(False)).alias("subtitle_rejected"))


def tag_lists(tags: DataFrame, bridge: DataFrame) -> DataFrame:
    """``clip_id, tags``: the names of a clip's tags in order of category, then name."""
    named = bridge.join(tags, "tag_id").groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("tag_category", "name"))).alias("t"))
    return named.select("clip_id", F.col("t.name").alias("tags"))


def orphan_tags(tags: DataFrame, bridge: DataFrame) -> DataFrame:
    """Tags that no clip has."""
    return tags.join(bridge.select("tag_id").distinct(), "tag_id", "left_anti")


def preferred_media(clips: DataFrame, cleanups: DataFrame, files: DataFrame, require_review: bool = True) -> DataFrame:
    """``clip_id, media``: the newest derivative that succeeded, is approved and exists, else the original file."""
    usable = cleanups.filter("status = 'succeeded'")
    if require_review:
        usable = usable.filter("review_status = 'approved'")
    there = usable.join(files.select(F.col("path").alias("output_path")), "output_path", "left_semi")
    newest = there.groupBy("clip_id").agg(F.max_by("output_path", "cleanup_id").alias("derivative"))
    return clips.join(newest, "clip_id", "left").select("clip_id", F.coalesce("derivative", "file_path").alias("media"))


def cleanup_routing(clips: DataFrame) -> DataFrame:
    kind = F.col("subtitle_type")
    route = F.when(kind.isNull() | (kind == "unknown"), "unmeasured").when(kind == "none", "not_needed").when(kind.isin(*CLEANABLE), "eligible").otherwise("ineligible")
    return clips.select("clip_id", route.alias("route"))


def seen_urls(hits: DataFrame, sources: DataFrame) -> DataFrame:
    return hits.join(sources.select("url").filter("url <> ''"), "url", "left_semi")


def similar(clips: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Up to ``most`` other clips of the same key, by id; groups are ranked, not paired in full."""
    first = clips.select(key, F.col("clip_id").alias("similar_id")).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("similar_id"))).filter(F.col("place") <= most + 1).drop("place")
    pairs = clips.select(key, "clip_id").join(first, key).filter("clip_id <> similar_id")
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy("clip_id").orderBy("similar_id"))).filter(F.col("place") <= most)
    return ranked.select("clip_id", "similar_id")


def key_groups(clips: DataFrame, key: str) -> DataFrame:
    """Clips that share a key, largest groups first, then by the first clip; blank keys are no group."""
    groups = clips.filter(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n"), F.min("clip_id").alias("first_id")).filter("n > 1")
    return groups.orderBy(F.desc("n"), "first_id")
