"""Production gaps: what is missing per category and stage, how it can be searched, and how urgent it is."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import planning, tables

# ---- fixed values ----
#: Clips wanted of each stage; stages that are not listed are no objectives. Their order is their rank.
TARGETS = {
    "drying": 2, "inside_dryer": 1, "before_drying": 1, "finished_product": 2, "equipment": 1, "factory": 1,
    "loading": 1, "tray_arrangement": 1, "unloading": 1, "packaging": 1, "preparation": 1,
}
ROLES = ("process", "equipment", "detail", "result")
ACTIONABILITY = {"fresh": 1.0, "unknown": 0.7, "mixed": 0.5, "saturated": 0.1}
#: Labels from the least priority on, then those below and without a gap.
LABELS = ((3.0, "严重缺口"), (1.5, "高优先级"), (0.5, "中等"))
LOW_LABEL, COVERED_LABEL = "低优先级", "已覆盖"
# ---- end of fixed values ----


@dataclass(frozen=True)
class Weights:
    """Weights of the components, and what stands for unknown figures."""

    stage: float = 3.0
    gap: float = 1.0
    edit_role: float = 1.5
    query_yield: float = 2.0
    duplicate: float = 2.0
    subtitle: float = 1.5
    tokens: float = 1.0
    token_reference: float = 60000.0
    rediscovery: float = 2.0
    saturated_primary: float = 0.5
    prior: float = 0.5
    estimated_tokens: int = 18000
    queries: int = 4
    rank_beyond: int = 20
    actionability: dict[str, float] = field(default_factory=lambda: dict(ACTIONABILITY))


def objectives(categories: DataFrame, targets: dict[str, int] = TARGETS) -> DataFrame:
    """``category, stage, target, stage_rank`` of every category and wanted stage."""
    each = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(n).alias("target"), F.lit(i).alias("stage_rank")) for i, (s, n) in enumerate(targets.items(), 1)])
    return categories.select("category").distinct().select("category", F.explode(each).alias("o")).select("category", "o.*")


def held(clips: DataFrame) -> DataFrame:
    """``category, stage, current, roles``: clips there are, and the edit roles of the first one."""
    rows = clips.filter("category <> ''").groupBy("category", "stage").agg(F.count("*").alias("current"), F.min_by("roles", "clip_id").alias("roles"))
    return rows.withColumn("roles", F.split(F.coalesce("roles", F.lit("")), ","))


def known_queries(scored: DataFrame, novelty: DataFrame, rediscovery: DataFrame) -> DataFrame:
    """One row per query that was run or found a source: v2 score and figures, saturation and past counts, share of sources processed already."""
    past = novelty.select("query", "saturation", "known_rate", "novelty_rate", "known_sources", F.col("candidates").alias("past_candidates"), "new_to_system", "last_attempt")
    own = scored.select("query", "clips", F.col("score_v2").alias("score"), "candidates", "uniques", "tokens_per_clip", "subtitle_rejection_rate")
    return own.join(past, "query", "full").join(rediscovery.select("query", F.col("rediscovery_rate").alias("rediscovery")), "query", "full")


def planned(goals: DataFrame, known: DataFrame, w: Weights = Weights()) -> DataFrame:
    """The queries of every objective with their figures, saturation and effective priority.

    ``known`` is ``known_queries``. A query without a row is unknown.
    """
    chosen = planning.objective_queries(goals.select("category", "stage"), known, w.queries, w.rediscovery)
    rows = chosen.join(known.withColumnRenamed("score", "raw"), "query", "left").withColumn("saturation", F.coalesce("saturation", F.lit("unknown")))
    history = F.col("origin") == "historical"
    ready = F.create_map(*[F.lit(x) for pair in w.actionability.items() for x in pair])[F.col("saturation")]
    base = F.when(history & (F.col("raw") > 0), F.col("raw")).otherwise(w.prior)
    counted = history & (F.col("candidates") > 0)
    return rows.withColumns({
        "score": F.coalesce("score", F.lit(0.0)), "family": F.coalesce("family", F.lit("other")), "actionability": F.coalesce(ready, F.lit(w.actionability["unknown"])),
        "duplicate_risk": F.when(counted, 1 - F.col("uniques") / F.col("candidates")),
    }).withColumn("effective", F.bround(base * F.col("actionability"), 3))


def _shares(queries: DataFrame) -> DataFrame:
    """Of every objective the best query, and what its queries have in common; ``queries`` of an objective are few."""
    best = F.struct("query", "origin", "score", "actionability", "saturation", "duplicate_risk", "rediscovery", "subtitle_rejection_rate", "tokens_per_clip", "last_attempt", planning.family(F.col("query")).alias("own_family"), F.col("past_candidates").alias("candidates"), "new_to_system", "known_rate", "novelty_rate")
    worn = F.col("saturation") == "saturated"
    in_order = lambda c, when=None: F.transform(F.sort_array(F.collect_list(F.struct("place", c) if when is None else F.when(when, F.struct("place", c)))), lambda x: x[c])
    past = F.sum(F.coalesce("past_candidates", F.lit(0)))
    share = lambda c: F.when(past > 0, F.bround(F.least(F.lit(1.0), F.sum(F.coalesce(c, F.lit(0))) / past), 4))
    return queries.groupBy("category", "stage").agg(
        F.max_by(best, F.struct("effective", "score", (-F.col("place")).alias("p"))).alias("best"), in_order("query").alias("queries"), in_order("family").alias("primary_families"),
        in_order("family", worn).alias("saturated_families"), F.count("*").alias("primary_count"), F.count_if(worn).alias("saturated_primary_count"),
        share("known_sources").alias("historical_known_source_rate"), share("new_to_system").alias("historical_library_novelty_rate"),
    )


def production_gaps(goals: DataFrame, clips: DataFrame, known: DataFrame, w: Weights = Weights(), covered: bool = False) -> DataFrame:
    """Every objective's gap, best query, priority with its components, label, and place in the order of work.

    The priority adds stage, gap, missing edit roles and the best query's yield, less its duplicates,
    subtitle rejections, tokens and rediscovery. What can be acted on is the best query's
    saturation less the share of saturated queries; times the priority it gives the order, then priority,
    rank, category and stage. ``covered`` lists objectives without a gap too. Every aggregate is
    one row per objective or query before it is joined.
    """
    rows = goals.join(held(clips), ["category", "stage"], "left").join(_shares(planned(goals, known, w)), ["category", "stage"], "left")
    rows = rows.withColumn("current", F.coalesce("current", F.lit(0))).withColumn("gap", F.greatest(F.lit(0), F.col("target") - F.col("current")))
    missing = F.filter(F.array(*map(F.lit, ROLES)), lambda r: ~F.array_contains(F.coalesce("roles", F.array(F.lit(""))), r))
    rows = rows.withColumn("edit_role_gap", missing).withColumn("edit_roles_missing", F.size(missing))
    of = lambda c, other=0.0: F.coalesce(F.col(f"best.{c}"), F.lit(other))
    worn = F.when(F.col("primary_count") > 0, F.col("saturated_primary_count") / F.col("primary_count")).otherwise(0.0)
    parts = {
        "stage": w.stage / F.greatest(F.lit(1), "stage_rank"), "gap": w.gap * F.log1p("gap"), "edit_role": w.edit_role * F.col("edit_roles_missing") / 4,
        "query_yield": w.query_yield * F.greatest(F.lit(0.0), of("score")) / 2, "duplicate_penalty": -w.duplicate * of("duplicate_risk"), "subtitle_penalty": -w.subtitle * of("subtitle_rejection_rate"),
        "token_penalty": -w.tokens * F.least(F.lit(1.0), of("tokens_per_clip") / w.token_reference), "rediscovery_penalty": -w.rediscovery * of("rediscovery"),
    }
    rows = rows.withColumn("components", F.struct(*[(F.bround(c, 3) + 0.0).alias(n) for n, c in parts.items()]))
    rows = rows.withColumn("priority", F.bround(sum((F.col(f"components.{n}") for n in parts), F.lit(0.0)), 3))
    rows = rows.withColumn("actionability", of("actionability") * (1 - w.saturated_primary * worn))
    rows = rows.withColumn("effective_priority", F.bround(F.col("priority") * F.col("actionability"), 3))
    label = F.when(F.col("gap") <= 0, COVERED_LABEL)
    for least, name in LABELS:
        label = label.when(F.col("priority") >= least, name)
    rate = lambda c, digits: F.bround(F.col(f"best.{c}"), digits)
    tokens = F.col("best.tokens_per_clip")
    shown = rows.select(
        "category", "stage", "current", "target", "gap", "stage_rank", "components", "priority", F.bround("actionability", 3).alias("query_actionability"), "effective_priority",
        label.otherwise(LOW_LABEL).alias("priority_label"), "edit_role_gap", of("query", "").alias("best_query"), F.bround(of("score"), 3).alias("best_query_score"), of("origin", "").alias("best_query_origin"),
        of("own_family", "").alias("best_query_family"), of("saturation", "").alias("query_saturation"), rate("duplicate_risk", 3).alias("duplicate_risk"), rate("rediscovery", 3).alias("rediscovery_rate"),
        rate("subtitle_rejection_rate", 3).alias("subtitle_rejection_rate"), tokens.alias("tokens_per_clip"), F.when((F.col("best.origin") == "historical") & (tokens > 0), tokens.cast("long")).otherwise(w.estimated_tokens).alias("estimated_tokens"),
        F.col("best.last_attempt").alias("last_attempted"), F.col("best.novelty_rate").alias("library_novelty_rate"), F.col("best.known_rate").alias("known_source_rate"), of("candidates", 0).alias("historical_candidates"), of("new_to_system", 0).alias("historical_new_to_system"),
        F.when(F.col("gap") > 0, "gap").otherwise("covered").alias("status"), "queries", "primary_families", "saturated_families", F.coalesce("primary_count", F.lit(0)).alias("primary_count"),
        F.coalesce("saturated_primary_count", F.lit(0)).alias("saturated_primary_count"), F.bround(worn, 3).alias("saturated_primary_fraction"), "historical_known_source_rate", "historical_library_novelty_rate",
    )
    if not covered:
        shown = shown.filter("gap > 0")
    order = [F.desc("effective_priority"), F.desc("priority"), F.asc("stage_rank"), F.asc("category"), F.asc("stage")]
    return tables.numbered(shown, order, "place", tables.saver(goals.sparkSession, "gaps"))
