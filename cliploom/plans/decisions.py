"""Registered queries of material names and objectives with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import materials
from ..operators import planning
from ..sources.adapters import STAGES
from ..sources.adapters import library as table

CONFIGURED = ["芒果", "苹果干"]


def _goals(spark, sf_dir):
    wanted = table(spark, sf_dir, "wanted")
    return wanted.select("category", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))


def _names(spark, sf_dir):
    return table(spark, sf_dir, "searches").select("query", "clips", "score", "rediscovery")


def _objective(spark, sf_dir):
    return planning.objective_queries(_goals(spark, sf_dir), _names(spark, sf_dir))


def _rounded(df):
    return df.withColumn("score", F.bround("score", 6))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def _cases(words: dict, column: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{'|'.join(own)}') THEN '{name}'" for name, own in words.items()) + f" ELSE '{other}' END"


_FORMS = "".join(materials.FORMS)
_STRIP = f"regexp_replace(trim({{0}}), '^(.+?)({'|'.join(materials.PROCESS_WORDS)})+$', '\\1')"
_BASE = f"regexp_replace({{0}}, '^(.{{{{2,}}}})[{_FORMS}]$', '\\1')"
_FULL_BASE = _BASE.replace("{0}", _STRIP)
_CATEGORY = _cases(materials.CATEGORY_WORDS, "{0}", "unknown")
_FORM = f"CASE WHEN regexp_matches({{0}}, '^.{{{{2,}}}}[{_FORMS}]$') THEN right({{0}}, 1) WHEN {_CATEGORY} IN ('herb', 'seafood', 'grain') THEN '' ELSE '干' END"
FAMILY_SQL = _FAMILY = _cases(planning.FAMILY_WORDS, "query", "other")
_STAGE_LIST = ", ".join(f"('{s}')" for s in STAGES)
_GOALS = f"goals AS (SELECT category, {_BASE.format('category')} AS base, stage FROM wanted, (VALUES {_STAGE_LIST}) s(stage))"
_TEMPLATE_ROWS = _values((s, i, t) for s, own in planning.STAGE_TEMPLATES.items() for i, t in enumerate(own))
_LABEL_ROWS = _values(planning.STAGE_LABELS.items())
_WORD_ROWS = _values((s, w) for s, own in planning.STAGE_WORDS.items() for w in own)
_STAGE_FAMILY_ROWS = _values((s, i, f) for s in STAGES for i, f in enumerate(planning.STAGE_FAMILIES.get(s, planning.USUAL_FAMILIES)))
_FAMILY_ROWS = _values((f, i, t) for f, own in planning.FAMILY_TEMPLATES.items() for i, t in enumerate(own))
_RECOMMENDED = f"""rec0 AS (
  SELECT category, stage, 2 * turn AS o, replace(template, '{{material}}', base) AS query FROM goals JOIN (VALUES {_TEMPLATE_ROWS}) t(stage, turn, template) USING (stage)
  UNION ALL SELECT category, stage, 2 * turn + 1, replace(template, '{{material}}', category) FROM goals JOIN (VALUES {_TEMPLATE_ROWS}) t(stage, turn, template) USING (stage)
  UNION ALL SELECT category, stage, -1, category || ' ' || label FROM goals JOIN (VALUES {_LABEL_ROWS}) l(stage, label) USING (stage)),
rec AS (SELECT category, stage, query, row_number() OVER (PARTITION BY category, stage ORDER BY min(o)) AS place FROM rec0 GROUP BY category, stage, query)"""
_HISTORY = "hist AS (SELECT DISTINCT category, query, clips, score, rediscovery FROM goals, searches WHERE clips > 0 AND contains(query, base))"
_RANK_SQL = f"""WITH {_GOALS}, {_RECOMMENDED}, {_HISTORY},
best AS (SELECT category, query, score, row_number() OVER (PARTITION BY category ORDER BY score DESC, query) AS r FROM hist QUALIFY r <= 2),
every AS (SELECT g.category, g.stage, query, 'historical' AS origin, score, 0 AS tier, r FROM goals g JOIN best USING (category)
  UNION ALL SELECT category, stage, query, 'template', 0.0, 1, place FROM rec WHERE place <= 4 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.category = rec.category AND b.query = rec.query)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY category, stage ORDER BY tier, r) AS place FROM every)
SELECT category, stage, CAST(place AS INT) AS place, query, origin, round_even(score, 6) AS score FROM ordered WHERE place <= 4"""
_TEXTS = f"""texts AS (SELECT category, stage, turn, family, step, replace(template, '{{material}}', base) AS query FROM goals
  JOIN (VALUES {_STAGE_FAMILY_ROWS}) f(stage, turn, family) USING (stage) JOIN (VALUES {_FAMILY_ROWS}) t(family, step, template) USING (family))"""
OBJECTIVE_SQL = _OBJECTIVE = f"""{_GOALS}, {_HISTORY}, {_TEXTS}, words(stage, word) AS (VALUES {_WORD_ROWS}),
own AS (SELECT category, stage, query, score - {planning.REDISCOVERY} * COALESCE(rediscovery, 0) AS score, {_FAMILY} AS family,
  NOT EXISTS (SELECT 1 FROM words w WHERE w.stage = g.stage) OR EXISTS (SELECT 1 FROM words w WHERE w.stage = g.stage AND contains(query, word)) AS relevant
  FROM goals g JOIN hist USING (category)),
one AS (SELECT * FROM own WHERE relevant QUALIFY row_number() OVER (PARTITION BY category, stage, family ORDER BY score DESC, query) = 1),
leads AS (SELECT *, row_number() OVER (PARTITION BY category, stage ORDER BY score DESC, query) AS r FROM one QUALIFY r <= 2),
opens AS (SELECT * FROM texts t WHERE NOT EXISTS (SELECT 1 FROM leads l WHERE l.category = t.category AND l.stage = t.stage AND (l.family = t.family OR l.query = t.query))
  QUALIFY row_number() OVER (PARTITION BY category, stage, family ORDER BY step) = 1),
others AS (SELECT *, row_number() OVER (PARTITION BY category, stage ORDER BY score DESC, query) AS r FROM own WHERE NOT relevant),
every AS (SELECT category, stage, query, 'historical' AS origin, family, score, 0 AS tier, r FROM leads
  UNION ALL SELECT category, stage, query, 'template', family, NULL, 1, turn FROM opens
  UNION ALL SELECT category, stage, query, 'historical', NULL, score, 2, r FROM others o WHERE NOT EXISTS
    (SELECT 1 FROM opens p WHERE p.category = o.category AND p.stage = o.stage AND p.query = o.query)),
objective AS (SELECT *, row_number() OVER (PARTITION BY category, stage ORDER BY tier, r) AS place FROM every QUALIFY place <= 4)"""

_EXPANDED = f"""WITH n AS (SELECT category AS material, {_BASE.format('category')} AS b, {_FORM.format('category')} AS f, {_CATEGORY.format('category')} AS c FROM wanted),
p AS (SELECT *, CASE WHEN c IN ('herb', 'seafood', 'grain') THEN '' ELSE '片' END AS s FROM n),
t AS (SELECT material, unnest([material, b || '烘干', CASE WHEN s <> '' THEN b || s || '烘干' END, b || '热泵烘干', b || '烘干机', b || '烘干房', b || f || '制作', b || f || '加工', b || f || '生产', b || s || '干燥']) AS query,
  generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 1) AS o FROM p),
d AS (SELECT material, query, min(o) AS o FROM t WHERE query IS NOT NULL GROUP BY 1, 2)
SELECT material, query, CAST(row_number() OVER (PARTITION BY material ORDER BY o) - 1 AS INT) AS place FROM d"""

_STAGE_MATCH = f"""WITH {_GOALS}, words(stage, word) AS (VALUES {_WORD_ROWS})
SELECT DISTINCT stage, query, NOT EXISTS (SELECT 1 FROM words w WHERE w.stage = g.stage) OR EXISTS (SELECT 1 FROM words w WHERE w.stage = g.stage AND contains(query, word)) AS hit
FROM (SELECT DISTINCT stage FROM goals) g, searches"""


def _stage_match(spark, sf_dir):
    rows = _names(spark, sf_dir).select("query", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    return rows.select("stage", "query", planning.matches_stage(F.col("query"), F.col("stage")).alias("hit"))


def _canonical(spark, sf_dir):
    s = table(spark, sf_dir, "searches")
    return s.select("query", materials.canonical(F.col("query"), F.col("reference")).alias("material"), materials.implied_state(F.col("query")).alias("state"))


_OWN, _REF = _FULL_BASE.format("query"), _FULL_BASE.format("reference")
_CANONICAL = f"""SELECT query, CASE WHEN ends_with({_OWN}, {_REF}) OR ends_with({_REF}, {_OWN}) THEN {_REF} ELSE {_OWN} END AS material,
  CASE WHEN regexp_matches(query, '^.{{2,}}干$') THEN 'dried' ELSE 'unknown' END AS state FROM searches"""
_MATERIALS = f"""WITH own AS (SELECT category, count(*) AS n FROM clips WHERE category <> '' GROUP BY 1),
named AS (SELECT COALESCE(m, category) AS material, o, n FROM (VALUES {_values((i, m) for i, m in enumerate(CONFIGURED))}) c(o, m) FULL JOIN own ON m = category)
SELECT CAST(row_number() OVER (ORDER BY o ASC NULLS LAST, n DESC, material) AS INT) AS place, material FROM named"""

QUERIES = {
    "canonical_material": (_canonical, _CANONICAL),
    "material_base": (
        lambda s, d: table(s, d, "searches").select("query", materials.material_base(F.col("query")).alias("base"), materials.category(F.col("query")).alias("category"), materials.form(F.col("query")).alias("form")),
        f"SELECT query, {_OWN} AS base, {_CATEGORY.format('query')} AS category, {_FORM.format('query')} AS form FROM searches",
    ),
    "expand_keywords": (lambda s, d: table(s, d, "wanted").select(F.col("category").alias("material"), F.posexplode(materials.expanded(F.col("category"))).alias("place", "query")), _EXPANDED),
    "stage_match": (_stage_match, _STAGE_MATCH),
    "query_family": (lambda s, d: table(s, d, "searches").select("query", planning.family(F.col("query")).alias("family")), f"SELECT query, {_FAMILY} AS family FROM searches"),
    "recommended_queries": (
        lambda s, d: _goals(s, d).select("category", "stage", F.posexplode(planning.recommended(F.col("category"), F.col("stage"))).alias("turn", "query")),
        f"WITH {_GOALS}, {_RECOMMENDED} SELECT category, stage, CAST(place - 1 AS INT) AS turn, query FROM rec WHERE place <= 6",
    ),
    "rank_queries": (lambda s, d: _rounded(planning.rank_queries(_goals(s, d), _names(s, d))), _RANK_SQL),
    "objective_queries": (lambda s, d: _rounded(_objective(s, d)), f"WITH {_OBJECTIVE} SELECT category, stage, CAST(place AS INT) AS place, query, origin, family, round_even(score, 6) AS score FROM objective"),
    "reserve_queries": (
        lambda s, d: planning.reserve_queries(_goals(s, d), _objective(s, d)),
        f"""WITH {_OBJECTIVE}, leftover AS (SELECT *, row_number() OVER (PARTITION BY category, stage ORDER BY turn, step) AS place FROM texts t WHERE NOT EXISTS
  (SELECT 1 FROM objective o WHERE o.category = t.category AND o.stage = t.stage AND o.query = t.query))
SELECT category, stage, CAST(place AS INT) AS place, query, family FROM leftover WHERE place <= 4""",
    ),
    "production_materials": (lambda s, d: planning.production_materials(CONFIGURED, table(s, d, "clips")), _MATERIALS),
}
