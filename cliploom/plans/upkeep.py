"""Registered queries of library upkeep with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, upkeep
from ..sources.adapters import STAGES
from ..sources.adapters import library as table


def _pair(a, b, f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, a), table(spark, sf_dir, b))


def _one(a, f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, a))


def _versioned(clips):
    return clips.withColumn("version", F.concat(F.lit("v"), F.col("clip_id") % 4))


def _reviews(clips):
    text = F.when(F.col("clip_id") % 7 == 0, "x").otherwise((F.col("clip_id") * F.when(F.col("clip_id") % 5 == 0, -1).otherwise(1)).cast("string"))
    status = F.when(F.col("clip_id") % 11 == 0, "great").otherwise(F.lit("approved"))
    word = F.when(F.col("clip_id") % 13 == 0, "maybe").when(F.col("clip_id") % 2 == 0, " Yes").otherwise("0")
    return clips.select(F.col("clip_id").alias("line"), text.alias("clip_id_text"), status.alias("status"), word.alias("favorite_text"))


def _found(sources):
    return sources.filter("source_id % 4 = 0").select("source_id", F.concat(F.lit("q"), F.col("source_id") % 59).alias("query"), F.lit("z").alias("author"))


_GAPS = """
g0 AS (SELECT CASE WHEN trim(category) = '' THEN '(legacy)' ELSE category END AS category, CASE WHEN trim(stage) = '' THEN 'other' ELSE stage END AS stage, count(*) AS total FROM clips GROUP BY 1, 2),
g AS (SELECT category, stage, COALESCE(total, 0) AS total FROM (SELECT DISTINCT category FROM g0) x CROSS JOIN (VALUES """ + ", ".join(f"('{s}')" for s in STAGES) + """) s(stage) LEFT JOIN g0 USING (category, stage)),
k AS (SELECT category, stage, 400 - total AS missing, CASE WHEN total = 0 THEN 0 WHEN total / 400.0 < 0.5 THEN 1 ELSE 2 END AS p FROM g WHERE total < 400),
r AS (SELECT *, COALESCE(sum(missing) OVER (PARTITION BY category ORDER BY p, missing DESC, stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)"""

QUERIES = {
    "review_import": (_one("clips", lambda c: upkeep.import_reviews(_reviews(c), c)), """
WITH r AS (SELECT clip_id AS line, CASE WHEN clip_id % 7 = 0 THEN NULL ELSE clip_id * CASE WHEN clip_id % 5 = 0 THEN -1 ELSE 1 END END AS number, CASE WHEN clip_id % 11 = 0 THEN 'great' ELSE 'approved' END AS status,
 CASE WHEN clip_id % 13 = 0 THEN NULL WHEN clip_id % 2 = 0 THEN true ELSE false END AS fav FROM clips)
SELECT line, CASE WHEN number IS NULL THEN 'skipped:bad_id' WHEN c.clip_id IS NULL THEN 'skipped:unknown_id' WHEN status = 'great' THEN 'skipped:bad_status' WHEN fav IS NULL THEN 'skipped:bad_boolean'
 WHEN status = c.review_status AND fav = c.favorite THEN 'skipped:unchanged' ELSE 'changed' END AS outcome, c.review_status AS old_status, status AS new_status FROM r LEFT JOIN clips c ON r.number = c.clip_id"""),
    "apply_reviews": (_one("clips", lambda c: upkeep.apply_reviews(c, c.filter("clip_id % 10 = 3").select("clip_id", F.lit("approved").alias("status")))), "SELECT clip_id, CASE WHEN clip_id % 10 = 3 THEN 'approved' ELSE review_status END AS review_status FROM clips"),
    "tag_audit": (_one("clips", lambda c: upkeep.audit(_versioned(c))), """
WITH t AS (SELECT *, concat('v', clip_id % 4) AS version FROM clips), s AS (SELECT version, max(k) AS top FROM (SELECT version, stage, count(*) AS k FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT version, count(*) AS n, count(DISTINCT description) AS descriptions, count(DISTINCT (overall, material_score, visual)) AS vectors, count(DISTINCT stage) AS stages, round_even(max(top)::DOUBLE / count(*), 4) AS top_stage_share, count(DISTINCT stage) = 1 AS single_stage FROM t JOIN s USING (version) GROUP BY version"""),
    "tag_duplicates": (_one("clips", lambda c: upkeep.identical_groups(_versioned(c))), "SELECT concat('v', clip_id % 4) AS version, md5(description) AS text_md5, count(*) AS n, min(clip_id) AS first_id FROM clips GROUP BY 1, 2 HAVING count(*) > 1"),
    "merge_discovery": (_one("sources", lambda s: upkeep.merge_discovery(s, _found(s))), "SELECT source_id, CASE WHEN source_id % 4 = 0 AND NOT list_contains(string_split(matched, '|'), 'q' || (source_id % 59)) THEN matched || '|q' || (source_id % 59) ELSE matched END AS matched, author FROM (SELECT source_id, author, array_to_string(list_transform(list_filter(string_split(matched, '|'), lambda x, i: i = 1 OR x <> string_split(matched, '|')[1]), lambda x: x), '|') AS matched FROM sources)"),
    "release_sources": (_one("sources", lambda s: upkeep.release(s, s.filter("task_id % 3 = 0"))), "SELECT source_id, CASE WHEN task_id % 3 = 0 AND status = 'downloading' THEN 'discovered' ELSE status END AS status FROM sources"),
    "subtitle_report": (_one("clips", upkeep.subtitle_report), "SELECT category, CASE WHEN subtitle_type = 'none' THEN 'clean' WHEN subtitle_type IN ('bottom_simple', 'top_simple', 'single_region', 'watermark_only') THEN 'simple' WHEN subtitle_type = 'unknown' THEN 'unknown' ELSE 'hard' END AS bucket, count(*) AS n, round_even(avg(1 - subtitle_score), 4) AS avg_cleanliness FROM clips GROUP BY 1, 2"),
    "production_ready": (_pair("clips", "sources", upkeep.production_ready), "SELECT category, count(*) AS n, count(*) FILTER (WHERE review_status IN ('approved', 'unreviewed', '') AND subtitle_score <= 0.35::DOUBLE AND source_id IN (SELECT source_id FROM sources) AND duration BETWEEN 3 AND 15) AS ready FROM clips GROUP BY 1"),
    "plan_draft": (_one("clips", lambda c: upkeep.draft(coverage.gaps(c, 400), 500)), f"WITH {_GAPS} SELECT category, stage, missing, CAST(least(missing, 500 - before) AS BIGINT) AS requested FROM r WHERE 500 - before > 0"),
}
