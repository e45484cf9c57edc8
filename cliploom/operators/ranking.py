"""Query intelligence: yields, cost, novelty and the two ranking formulas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables
from .coverage import ratio


@dataclass(frozen=True)
class Weights:
    """Weights and references of both formulas."""

    clips: float = 3.0
    accepted: float = 1.0
    conversion: float = 2.0
    approved: float = 0.5
    subtitle: float = 2.5
    duplicate: float = 1.5
    tokens: float = 1.5
    token_reference: float = 60000.0
    v2_yield: float = 3.0
    v2_conversion: float = 2.0
    v2_approved: float = 0.6
    v2_power: float = 1.0
    v2_subtitle: float = 2.5
    v2_tokens: float = 1.5
    v2_zero_tokens: float = 3.0
    v2_zero_yield: float = 1.0
    v2_zero_from: int = 5
    v2_confidence: float = 5.0


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def yields(table: DataFrame) -> DataFrame:
    names = ("candidates", "uniques", "accepted", "downloads", "clips")
    sums = table.groupBy("query").agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in names])
    return sums.select(
        "query", "runs", *names,
        ratio(F.col("uniques"), F.col("candidates")).alias("unique_rate"), ratio(F.col("accepted"), F.col("uniques")).alias("accept_rate"),
        ratio(F.col("clips"), F.col("downloads")).alias("download_to_clip_rate"), F.coalesce(ratio(F.col("clips"), F.col("candidates")), F.lit(0.0)).alias("candidate_to_clip_rate"),
    )


def usefulness(table: DataFrame) -> DataFrame:
    rate = F.coalesce(F.try_divide("clips", "candidates"), F.lit(0.0))
    return yields(table).select("query", "clips", "accepted", F.bround(F.col("clips") * 3.0 + F.col("accepted") + rate * 2, 3).alias("usefulness"))


def source_queries(sources: DataFrame) -> DataFrame:
    """One row per source and query it matched, repeats kept; the bridge of all per-query reports."""
    return sources.select("source_id", "status", "reject_reason", F.explode(F.split("matched", r"\|")).alias("query")).filter("query <> ''")


def run_totals(runs: DataFrame) -> DataFrame:
    """Model runs by source: the log shrinks to one row per source before any join."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    return runs.groupBy("source_id").agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"))


def cost(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Tokens and calls per query, only from sources with a single query; the rest in one row."""
    owned = sources.select("source_id", F.split("matched", r"\|").alias("q"))
    joined = run_totals(runs).join(owned, "source_id", "left")
    query = F.when(F.size("q") == 1, F.get("q", 0)).otherwise(F.lit("(unattributed)"))
    return joined.groupBy(query.alias("query")).agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.count("*").alias("sources"))


def approved(clips: DataFrame, sources: DataFrame) -> DataFrame:
    by_source = clips.groupBy("source_id").agg(F.count("*").alias("clips"), F.count_if(F.col("review_status") == "approved").alias("approved"))
    return source_queries(sources).join(by_source, "source_id").groupBy("query").agg(F.sum("clips").alias("clips"), F.sum("approved").alias("approved"))


def subtitle_rejection(sources: DataFrame) -> DataFrame:
    rejected = F.col("status") == "rejected_preview"
    by = source_queries(sources).groupBy("query").agg(
        F.count("*").alias("seen"), F.count_if(rejected).alias("preview_rejected"), F.count_if(rejected & F.col("reject_reason").startswith("subtitle")).alias("subtitle_rejected")
    )
    return by.withColumn("subtitle_rejection_rate", ratio(F.col("subtitle_rejected"), F.col("seen")))


PROCESSED = ("completed", "analyzed", "no_usable_segment", "duplicate", "rejected_preview")


def rediscovery(sources: DataFrame) -> DataFrame:
    """Share of a query's distinct sources that are processed already."""
    once = source_queries(sources).dropDuplicates(["source_id", "query"])
    return once.groupBy("query").agg(F.count("*").alias("sources"), F.bround(F.avg(F.col("status").isin(*PROCESSED).cast("int")), 4).alias("rediscovery_rate"))


def statistics(yield_rows: DataFrame, sources: DataFrame, clips: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per query: yields, approvals, rejections and cost; all four sides are keyed by query."""
    joined = (
        yields(yield_rows).select("query", "runs", "candidates", "uniques", "accepted", "downloads", "clips")
        .join(approved(clips, sources).select("query", "approved"), "query", "full")
        .join(subtitle_rejection(sources).select("query", "subtitle_rejection_rate"), "query", "full")
        .join(cost(sources, runs).filter("query <> '(unattributed)'").select("query", "tokens"), "query", "full")
    )
    filled = [zero(c).alias(c) for c in ("runs", "candidates", "uniques", "accepted", "downloads", "clips", "approved", "tokens")]
    per = F.when((zero("tokens") > 0) & (zero("clips") > 0), F.col("tokens") / F.col("clips"))
    return joined.select("query", *filled, "subtitle_rejection_rate", per.alias("tokens_per_clip"))


def scores(stats: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Adds ``score_v1`` and ``score_v2``.

    v1 is linear in clips and accepted candidates. v2 grows with the logarithm of clips, is
    damped by the share of unique candidates, charges spending without yield, and shrinks
    towards 0 with few samples.
    """
    clips, candidates = F.col("clips").cast("double"), F.col("candidates").cast("double")
    unique = F.least(F.greatest("uniques", F.lit(0)), F.col("candidates")).cast("double")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    conversion, fresh = part(clips, candidates), part(unique, candidates)
    subtitle, per_clip = F.coalesce("subtitle_rejection_rate", F.lit(0.0)), F.coalesce("tokens_per_clip", F.lit(0.0))
    spent = F.least(F.lit(1.0), per_clip / w.token_reference)
    repeated = F.when(candidates > 0, 1 - fresh).otherwise(0.0)
    v1 = w.clips * clips + w.accepted * F.col("accepted") + w.conversion * conversion + w.approved * F.col("approved") - w.subtitle * subtitle - w.duplicate * repeated - w.tokens * spent
    nothing = clips == 0
    idle_cost = F.when(nothing & (F.col("tokens") > 0), F.least(F.lit(1.0), F.log1p("tokens") / F.log1p(F.lit(w.token_reference)))).otherwise(0.0)
    idle = F.when(nothing & (candidates >= w.v2_zero_from), w.v2_zero_yield).otherwise(0.0)
    useful = (w.v2_yield * F.log1p(clips) + w.v2_conversion * conversion) * F.pow(fresh, F.lit(w.v2_power))
    total = useful + w.v2_approved * F.log1p("approved") - w.v2_subtitle * subtitle - w.v2_tokens * spent - w.v2_zero_tokens * idle_cost - idle
    return stats.withColumn("score_v1", F.bround(v1, 3)).withColumn("score_v2", F.bround(total * unique / (unique + w.v2_confidence), 3))


def rank_table(stats: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Both ranks on the rounded scores and their difference; bookkeeping rows are left out.

    Ranks are numbers over ranges of the scores, so no task sorts all queries.
    """
    save = tables.saver(stats.sparkSession, "ranks")
    ranked = scores(stats.filter(~F.col("query").startswith("(")), w).select("query", "clips", "candidates", "score_v1", "score_v2")
    for version in ("v1", "v2"):
        numbered = tables.numbered(ranked, [F.desc(f"score_{version}"), F.asc("query")], f"rank_{version}", save, version)
        ranked = numbered.withColumn(f"rank_{version}", F.col(f"rank_{version}").cast("int"))
    return ranked.withColumn("rank_delta", F.col("rank_v1") - F.col("rank_v2"))


def recent(yield_rows: DataFrame, most: int = 500) -> DataFrame:
    """The newest rows of each query, by id."""
    newest = Window.partitionBy("query").orderBy(F.desc("yield_id"), F.desc("created_at"), F.desc("candidates"))
    return yield_rows.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most)


def novelty(
    yield_rows: DataFrame, sources: DataFrame, clips: DataFrame, as_of: Column, days: int = 30, expiry: int = 30,
    least: int = 8, samples: int = 3, high: float = 0.8, fresh_rate: float = 0.3, mixed: float = 0.4, zero_runs: int = 3,
) -> DataFrame:
    """Lifetime and window counts per query of the yields, with a saturation class and its actionability.

    ``known_sources`` and ``represented`` are the stored sources that a query found, and those
    of them with clips. Where old rows have neither new nor known counts, the stored sources
    stand for the known ones, up to the number of candidates.
    """
    start, dead = as_of - F.make_dt_interval(F.lit(days)), as_of - F.make_dt_interval(F.lit(expiry))
    inside = F.col("created_at") >= start
    by = recent(yield_rows).groupBy("query").agg(
        F.sum("candidates").alias("candidates"), F.sum("fresh").alias("new_to_system"), F.sum("known").alias("counted"),
        F.count_if(inside).alias("samples"), F.count_if(inside & (F.col("candidates") > 0) & (F.col("fresh") == 0)).alias("zero_runs"),
        F.max(F.when(F.col("place") == 1, F.col("created_at"))).alias("last_attempt"),
    )
    with_clips = clips.select("source_id").distinct().withColumn("has_clip", F.lit(True))
    found = source_queries(sources).select("source_id", "query").distinct().join(with_clips, "source_id", "left")
    stored = found.groupBy("query").agg(F.count("*").alias("known_sources"), F.count_if("has_clip").alias("represented"))
    by = by.join(stored, "query", "left").fillna(0, ["known_sources", "represented"])
    old = (F.col("candidates") > 0) & (F.col("new_to_system") == 0) & (F.col("counted") == 0)
    by = by.withColumn("known", F.when(old, F.least("candidates", "known_sources")).otherwise(F.col("counted"))).drop("counted")
    known = F.when(F.col("candidates") > 0, F.least(F.lit(1.0), F.col("known") / F.col("candidates")))
    new = F.when(F.col("candidates") > 0, F.least(F.lit(1.0), F.col("new_to_system") / F.col("candidates")))
    k, n = F.coalesce(known, F.lit(0.0)), F.coalesce(new, F.lit(0.0))
    some = F.col("new_to_system") > 0
    worn = ((F.col("candidates") >= least) | (F.col("samples") >= samples)) & (k >= high) | (F.col("zero_runs") >= zero_runs)
    state = (
        F.when(F.col("candidates") <= 0, "unknown").when(F.col("last_attempt") < dead, "unknown").when(worn, "saturated")
        .when(some & (n >= fresh_rate), "fresh").when((k >= mixed) | some & (k > 0), "mixed").when(some, "fresh").otherwise("unknown")
    )
    factor = F.when(F.col("saturation") == "saturated", 0.3).when(F.col("saturation") == "mixed", 0.7).when(F.col("saturation") == "unknown", 0.8).otherwise(1.0)
    rated = by.withColumn("known_rate", F.bround(known, 4)).withColumn("novelty_rate", F.bround(new, 4)).withColumn("saturation", state)
    return rated.withColumn("actionability", factor)
