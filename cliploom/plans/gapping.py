"""The registered production gaps, composed of statistics, novelty and rediscovery of the queries, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gaps, ranking
from ..sources.adapters import MATERIALS, PHRASES, pick
from ..sources.adapters import library as table
from .decisions import FAMILY_SQL, OBJECTIVE_SQL
from .records import _rows

#: Sixty times the usual targets, since the given tables hold many clips of each stage.
TARGETS = {s: 60 * n for s, n in gaps.TARGETS.items()}
#: The given queries q0 to q60 as texts that name materials.
NAMED = f"concat({pick('CAST(substr(query, 2) AS INT)', MATERIALS)}, {pick('floor(CAST(substr(query, 2) AS INT) / 7e0)', PHRASES)})"
CLIPS = f"SELECT clip_id, {pick('clip_id % 1033', [*MATERIALS, ''])} AS category, stage, roles FROM {{clips}}"


def query(spark, sf_dir, statistics, novelty):
    named = lambda df: df.withColumn("query", F.expr(NAMED))
    known = gaps.known_queries(named(ranking.scores(statistics)), named(novelty), named(ranking.rediscovery(table(spark, sf_dir, "sources"))))
    goals = gaps.objectives(table(spark, sf_dir, "wanted"), TARGETS)
    found = gaps.production_gaps(goals, _rows(spark, sf_dir, CLIPS), known, covered=True)
    lists = {c: F.array_join(c, "|") for c in ("edit_role_gap", "queries", "primary_families", "saturated_families")}
    return found.withColumns(lists).select(*[c for c in found.columns if c not in ("components", "last_attempted", "place")], *[F.col(f"components.{c}").alias(f"{c}_component" if c in found.columns else c) for c in found.schema["components"].dataType.names], F.col("place").cast("int").alias("place"), F.date_format("last_attempted", "yyyy-MM-dd").alias("last_attempted"))


def sql(scored: str, novelty: str, rediscovery: str) -> str:
    """``scored`` and the others are the twins of the queries that the plan is made of."""
    w = gaps.Weights()
    goal_rows = ", ".join(f"('{s}', {n}, {i})" for i, (s, n) in enumerate(TARGETS.items(), 1))
    ready = "CASE saturation " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in w.actionability.items()) + f" ELSE {w.actionability['unknown']}::DOUBLE END"
    label = "CASE WHEN gap <= 0 THEN '" + gaps.COVERED_LABEL + "' " + " ".join(f"WHEN priority >= {a} THEN '{x}'" for a, x in gaps.LABELS) + f" ELSE '{gaps.LOW_LABEL}' END"
    role = "list_filter([" + ", ".join(f"'{r}'" for r in gaps.ROLES) + "], lambda r: NOT list_contains(string_split(COALESCE(roles, ''), ','), r))"
    parts = ("stage", "gap", "edit_role", "query_yield", "duplicate_penalty", "subtitle_penalty", "token_penalty", "rediscovery_penalty")
    objective = OBJECTIVE_SQL.replace("FROM goals, searches", "FROM goals, known")
    return f"""WITH known AS (SELECT {NAMED} AS query, clips, score, candidates, uniques, tokens_per_clip, subtitle_rejection_rate, saturation, known_rate, novelty_rate, known_sources, past_candidates, new_to_system, last_attempt, rediscovery FROM
  (SELECT query, clips, score_v2 AS score, candidates, uniques, tokens_per_clip, subtitle_rejection_rate FROM ({scored}) s0) a
  FULL JOIN (SELECT query, saturation, known_rate, novelty_rate, known_sources, candidates AS past_candidates, new_to_system, last_attempt FROM ({novelty}) n0) n USING (query)
  FULL JOIN (SELECT query, rediscovery_rate AS rediscovery FROM ({rediscovery}) d0) d USING (query)),
{objective},
t(stage, target, stage_rank) AS (VALUES {goal_rows}),
o AS (SELECT x.category, x.stage, place, x.query, origin, COALESCE(family, 'other') AS family, COALESCE(x.score, 0) AS score, COALESCE(saturation, 'unknown') AS saturation, k.score AS raw, k.candidates, k.uniques, k.tokens_per_clip,
  k.subtitle_rejection_rate, k.rediscovery, known_rate, novelty_rate, known_sources, past_candidates, new_to_system, last_attempt FROM objective x LEFT JOIN known k ON x.query = k.query),
p AS (SELECT *, {ready} AS ready, CASE WHEN origin = 'historical' AND candidates > 0 THEN 1 - uniques::DOUBLE / candidates END AS risk, {FAMILY_SQL} AS own_family FROM o),
e AS (SELECT *, round_even((CASE WHEN origin = 'historical' AND raw > 0 THEN raw ELSE {w.prior} END)::DOUBLE * ready, 3) AS effective FROM p),
b AS (SELECT category, stage, arg_max(e, (effective, score, -place)) AS best, string_agg(query, '|' ORDER BY place) AS queries, string_agg(family, '|' ORDER BY place) AS primary_families,
  COALESCE(string_agg(family, '|' ORDER BY place) FILTER (WHERE saturation = 'saturated'), '') AS saturated_families, count(*) AS primary_count, count(*) FILTER (WHERE saturation = 'saturated') AS saturated_primary_count,
  sum(past_candidates)::DOUBLE AS past, sum(known_sources)::DOUBLE AS k, sum(new_to_system)::DOUBLE AS f FROM e GROUP BY 1, 2),
h AS (SELECT category, stage, count(*) AS current, arg_min(roles, clip_id) AS roles FROM ({CLIPS.replace('{clips}', 'clips')}) c WHERE category <> '' GROUP BY 1, 2),
g AS (SELECT w.category, t.stage, t.target, t.stage_rank, COALESCE(current, 0) AS current, greatest(0, target - COALESCE(current, 0)) AS gap, {role} AS missing, b.* EXCLUDE (category, stage)
  FROM (SELECT DISTINCT category FROM wanted) w CROSS JOIN t LEFT JOIN h ON h.category = w.category AND h.stage = t.stage LEFT JOIN b ON b.category = w.category AND b.stage = t.stage),
c AS (SELECT *, round_even({w.stage}::DOUBLE / stage_rank, 3) AS c_stage, round_even({w.gap}::DOUBLE * ln(1 + gap::DOUBLE), 3) AS c_gap, round_even({w.edit_role}::DOUBLE * len(missing) / 4, 3) AS c_edit_role,
  round_even({w.query_yield}::DOUBLE * greatest(0, COALESCE(best.score, 0)) / 2, 3) AS c_query_yield, round_even(-{w.duplicate}::DOUBLE * COALESCE(best.risk, 0), 3) + 0.0::DOUBLE AS c_duplicate_penalty,
  round_even(-{w.subtitle}::DOUBLE * COALESCE(best.subtitle_rejection_rate, 0), 3) + 0.0::DOUBLE AS c_subtitle_penalty, round_even(-{w.tokens}::DOUBLE * least(1, COALESCE(best.tokens_per_clip, 0) / {w.token_reference}), 3) + 0.0::DOUBLE AS c_token_penalty,
  round_even(-{w.rediscovery}::DOUBLE * COALESCE(best.rediscovery, 0), 3) + 0.0::DOUBLE AS c_rediscovery_penalty, CASE WHEN primary_count > 0 THEN saturated_primary_count::DOUBLE / primary_count ELSE 0 END AS worn FROM g),
q AS (SELECT *, round_even({' + '.join('c_' + x for x in parts)}, 3) AS priority, COALESCE(best.ready, 0) * (1 - {w.saturated_primary}::DOUBLE * worn) AS act FROM c),
z AS (SELECT *, round_even(priority * act, 3) AS effective_priority FROM q)
SELECT category, stage, current, CAST(target AS INT) AS target, gap, CAST(stage_rank AS INT) AS stage_rank, priority, round_even(act, 3) AS query_actionability, effective_priority, {label} AS priority_label, array_to_string(missing, '|') AS edit_role_gap,
  COALESCE(best.query, '') AS best_query, round_even(COALESCE(best.score, 0), 3) AS best_query_score, COALESCE(best.origin, '') AS best_query_origin, COALESCE(best.own_family, '') AS best_query_family, COALESCE(best.saturation, '') AS query_saturation,
  round_even(best.risk, 3) AS duplicate_risk, round_even(best.rediscovery, 3) AS rediscovery_rate, round_even(best.subtitle_rejection_rate, 3) AS subtitle_rejection_rate, best.tokens_per_clip AS tokens_per_clip,
  CASE WHEN best.origin = 'historical' AND best.tokens_per_clip > 0 THEN CAST(floor(best.tokens_per_clip) AS BIGINT) ELSE {w.estimated_tokens} END AS estimated_tokens, strftime(best.last_attempt, '%Y-%m-%d') AS last_attempted,
  best.novelty_rate AS library_novelty_rate, best.known_rate AS known_source_rate, COALESCE(best.past_candidates, 0) AS historical_candidates, COALESCE(best.new_to_system, 0) AS historical_new_to_system, CASE WHEN gap > 0 THEN 'gap' ELSE 'covered' END AS status,
  queries, primary_families, saturated_families, primary_count, saturated_primary_count, round_even(worn, 3) AS saturated_primary_fraction, CASE WHEN past > 0 THEN round_even(least(1, COALESCE(k, 0) / past), 4) END AS historical_known_source_rate,
  CASE WHEN past > 0 THEN round_even(least(1, COALESCE(f, 0) / past), 4) END AS historical_library_novelty_rate, {', '.join(f'c_{x} AS {x}' for x in parts if x not in ('stage', 'gap'))}, c_stage AS stage_component, c_gap AS gap_component,
  CAST(row_number() OVER (ORDER BY effective_priority DESC, priority DESC, stage_rank, category, stage) AS INT) AS place FROM z"""
