"""Registered queries of library records with their SQL twins.

Fixtures are SQL over the adapted tables that both engines run (``{clips}`` and so on); the
twins say the expected rows in their own words.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..operators import records
from ..sources.adapters import ADAPTERS, ROLES, STAGES
from ..sources.adapters import library as table


def _rows(spark, sf_dir, sql):
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in ADAPTERS if "{" + n + "}" in sql})


def _twin(fixtures: dict[str, str], sql: str) -> str:
    named = ", ".join(f"{n} AS ({x.format(**{a: a for a in ADAPTERS})})" for n, x in fixtures.items())
    return f"WITH {named} {sql}"


_S = "CAST({} AS VARCHAR(20))".format
TAGGED = f"""SELECT clip_id, concat('m', {_S('clip_id % 9')}) AS material, CASE WHEN clip_id % 2 = 0 THEN 'sliced' ELSE 'whole' END AS material_form, state AS material_state,
  stage AS process_stage, shot AS shot_type, 'static' AS camera_motion, subtitle_type, CASE WHEN clip_id % 4 = 0 THEN 'belt dryer' ELSE '' END AS equipment_type,
  CASE WHEN clip_id % 3 = 0 THEN 'workshop' END AS scene, CASE WHEN clip_id % 5 = 0 THEN 'worker' ELSE 'none' END AS person_role, clip_id % 5 = 0 AS people,
  CAST(clip_id % 10 AS INT) AS people_count, roles FROM {{clips}}"""
TAGS = f"SELECT DISTINCT clip_id % 4 + 1 AS tag_id, concat('m', {_S('clip_id % 4')}) AS name, 'material' AS tag_category FROM {{clips}}"
_P = "(clip_id * {} % 21) / 2e1".format
SCORES = f"SELECT clip_id, {_P(7)} AS material_relevance, {_P(11)} AS visual_quality, CASE WHEN clip_id % 6 > 0 THEN {_P(13)} END AS subtitle_cleanliness, {_P(17)} AS stability, {_P(19)} AS composition FROM {{clips}}"
LISTS = """SELECT clip_id, CASE clip_id % 4 WHEN 0 THEN concat('["', replace(roles, ',', '","'), '"]') WHEN 1 THEN roles WHEN 2 THEN concat(roles, ',nonsense,') END AS value FROM {clips}"""
ANSWER = """concat('{{"material":"m', {m}, '","process_stage":"', CASE WHEN event % 7 = 0 THEN 'flying' ELSE stage END, '","people":false,"people_count":', {c},
  ',"person_role":"none","edit_roles":["hook","packaging","process"', CASE WHEN event % 11 = 0 THEN ',"villain"' ELSE '' END, '],"scores":{{"material_relevance":0.5,"stability":1.0}}}}')"""
ANSWERS = "SELECT event, stage, CASE event % 5 WHEN 0 THEN concat('Sure: ```json ', j, ' ```') WHEN 1 THEN concat('I see ', j, ' there') WHEN 2 THEN j WHEN 3 THEN 'no answer' ELSE concat(j, '}}') END AS answer FROM (SELECT event, stage, " + ANSWER.replace("{m}", _S("event % 7")).replace("{c}", _S("event % 3")) + " AS j FROM (SELECT clip_id AS event, stage FROM {clips}) x) y"
FILES = f"""SELECT clip_id, concat('/lib/', CASE WHEN clip_id % 19 = 0 THEN '../x' ELSE 'a' END, '/clips/', {_S('clip_id')}, '.mp4') AS file_path, concat('/lib/a/thumbs/', {_S('clip_id')}, '.jpg') AS thumbnail_path,
  provenance, duration FROM {{clips}}"""
PRESENT = f"""SELECT file_path AS path, clip_id * 1000 AS bytes FROM ({FILES}) a WHERE clip_id % 10 <> 0 UNION ALL SELECT thumbnail_path, 700 FROM ({FILES}) b WHERE clip_id % 7 <> 0"""
PROBES = f"SELECT file_path AS path, duration AS seconds, clip_id % 13 <> 0 AS has_video FROM ({FILES}) a WHERE clip_id % 17 <> 0"
DEMOS = """SELECT clip_id, CASE clip_id % 4 WHEN 0 THEN 'mock' WHEN 1 THEN 'remote' WHEN 2 THEN 'local_test' ELSE 'unknown' END AS provenance,
  CASE WHEN clip_id % 3 > 0 THEN CAST(clip_id % 1300 AS INT) END AS width, CAST(clip_id % 500 AS INT) AS height, clip_id * 100 AS size_bytes FROM {clips}"""
SOURCES = """SELECT source_id, status, CASE WHEN source_id % 3 = 0 THEN 0.5 END AS material_score, CASE WHEN source_id % 5 = 0 THEN 0.5 END AS subtitle_score, CAST(NULL AS DOUBLE) AS quality_score FROM {sources}"""
RUNS = """SELECT run_id, source_id, operation, status, CASE run_id % 4 WHEN 0 THEN 'QuotaError' WHEN 1 THEN 'Timeout' END AS error_type, CASE run_id % 3 WHEN 0 THEN 'HTTP 403 denied' WHEN 1 THEN 'slow' END AS error_message FROM {ai_runs}"""
VERSIONS = """SELECT clip_id, v AS version, stage, CASE WHEN clip_id % 3 = v THEN 'macro' ELSE shot END AS shot, CASE WHEN clip_id % 5 = 0 AND v = 2 THEN NULL ELSE description END AS description
  FROM {clips}, (SELECT 1 AS v UNION ALL SELECT 2) w WHERE clip_id % 4 <> v"""
BLANKS = f"""SELECT clip_id, CASE WHEN clip_id % 3 = 0 THEN '' ELSE 'kept' END AS category, CASE WHEN clip_id % 4 = 0 THEN '' ELSE 'remote' END AS provenance, CASE WHEN clip_id % 5 < 3 THEN '' ELSE 'v9' END AS prompt_version,
  CASE WHEN clip_id % 2 = 0 THEN concat('/lib/pear/clips/', {_S('clip_id')}) ELSE concat('/lib/plum/', {_S('clip_id')}) END AS file_path FROM {{clips}}"""
TAG_RUNS = "SELECT clip_id, 'clip_tagging' AS operation, v AS prompt_version FROM {clips}, (SELECT 'v1' AS v UNION ALL SELECT 'v2' UNION ALL SELECT '') w WHERE v <> 'v2' OR clip_id % 6 = 0"
CLEANED = """SELECT clip_id, CASE clip_id % 8 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'not_needed' WHEN 2 THEN 'failed_quality' WHEN 3 THEN 'derivative_deleted' WHEN 4 THEN 'residual_subtitle' WHEN 5 THEN 'running' ELSE 'succeeded' END AS status,
  CASE clip_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE '' END AS review, CASE WHEN clip_id % 16 = 1 THEN 'too short' ELSE '' END AS skip_reason, clip_id % 5 <> 0 AS healthy,
  (clip_id % 40) / 1e2 AS b, (clip_id % 40 + clip_id % 50) / 1e2 AS a, (clip_id % 30) / 1e2 AS x FROM {clips} WHERE clip_id % 9 <> 0"""
MEASURED = """SELECT clip_id, subtitle_type, CASE WHEN clip_id % 3 = 0 THEN subtitle_type WHEN clip_id % 3 = 1 THEN 'bottom_simple' ELSE '' END AS measured_class FROM {clips}"""
OPINIONS = """SELECT clip_id, CASE WHEN clip_id % 7 > 0 THEN subtitle_type END AS subtitle_class, CASE WHEN clip_id % 4 > 0 THEN 'complex' END AS model_class,
  CASE clip_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS model_complexity, (clip_id % 50) / 5e1 AS cleanliness, clip_id % 2 AS most_boxes,
  (clip_id % 25) / 1e2 AS avg_area, 0.08 + (clip_id % 20) / 1e2 AS center_area, 0.4 + (clip_id % 60) / 1e2 AS multi FROM {clips}"""
TRACKS = """SELECT clip_id, frame AS track, x1 AS persistence, y1 / 1e1 AS jitter_y, x2 AS growth, y1 AS median_y1 FROM {regions}"""
BOXES = "SELECT clip_id, frame, x1, y1, x2, y2, 0.9 AS confidence FROM {regions}"
REST = "SELECT clip_id, frame, x1, y1, x2, y2, CASE WHEN frame = 0 THEN 0.1 ELSE 0.9 END AS confidence FROM {regions} WHERE clip_id % 3 > 0 AND frame < 2"
COVERS = "SELECT clip_id, min(x1) AS x1, min(y1) AS y1, min(x1) + 0.25 AS x2, min(y1) + 0.25 AS y2 FROM {regions} GROUP BY clip_id"

LATER = StructType([StructField("event_id", LongType()), StructField("event_type", StringType()), StructField("score", DoubleType()), StructField("was_reserve", BooleanType())])


def _read(spark, sf_dir):
    return records.with_schema(spark.read.parquet(f"{sf_dir}/events.parquet"), LATER, {"was_reserve": False})


def _tags(s, d):
    t = _rows(s, d, TAGGED)
    return records.tag_rows(t.withColumn("edit_roles", F.split("roles", ",")))


def _inserted(s, d):
    dimension, bridge = records.insert_clips(_tags(s, d), _rows(s, d, TAGS))
    n = bridge.groupBy("tag_id").agg(F.count("*").alias("clips"))
    return dimension.join(n, "tag_id", "left").select("tag_id", "name", "tag_category", F.coalesce("clips", F.lit(0)).alias("clips"))


def _answers(s, d):
    out = records.parse_answers(_rows(s, d, ANSWERS), ROLES, STAGES)
    return out.select("event", "material", "process_stage", "people", "people_count", "person_role", F.array_join("edit_roles", ",").alias("roles"), "overall", "reason")


EXPORT = f"""SELECT clip_id, concat('/lib/', {_S('clip_id')}) AS file_path, CASE WHEN clip_id % 3 = 0 THEN concat('/clean/', {_S('clip_id')}) END AS derivative_path, '' AS thumbnail_path, category AS library_category,
  'm' AS material, 'whole' AS material_form, state AS material_state, stage AS process_stage, '' AS equipment_type, false AS equipment_visible, shot AS shot_type, 'static' AS camera_motion, false AS people, subtitle_type,
  roles AS edit_roles, duration, overall AS overall_score, review_status, favorite, provenance, 'p' AS source_platform, {_S('source_id')} AS source_video_id, '' AS source_url FROM {{clips}}"""
_EXPORT_TWIN = ", ".join("CASE WHEN trim(library_category) = '' THEN '(legacy)' ELSE library_category END AS library_category" if c == "library_category" else c for c in records.EXPORT_FIELDS)
_TAG_ROWS = " UNION ALL ".join(f"SELECT clip_id, {c} AS name, '{c}' AS tag_category FROM t" for c in ("material", "material_form", "material_state", "process_stage", "shot_type", "camera_motion", "subtitle_type"))
_TAG_ROWS += " UNION ALL SELECT clip_id, 'belt dryer', 'equipment_type' FROM t WHERE clip_id % 4 = 0 UNION ALL SELECT clip_id, 'workshop', 'scene' FROM t WHERE clip_id % 3 = 0 UNION ALL SELECT clip_id, 'worker', 'person_role' FROM t WHERE clip_id % 5 = 0"
_TAG_ROWS += " UNION ALL SELECT clip_id, 'people_present', 'people' FROM t WHERE clip_id % 10 = 5 UNION ALL SELECT clip_id, unnest(string_split(roles, ',')), 'edit_role' FROM t"
_OPEN = "clip_id % 9 = 0 OR clip_id % 8 = 5"
_SCAN = """scan AS (SELECT clip_id, CASE WHEN measured_class <> '' THEN measured_class ELSE subtitle_type END AS k, measured_class <> '' AS measured, COALESCE(c.status, '') AS status, c.review, c.skip_reason, c.healthy FROM m LEFT JOIN c USING (clip_id)),
found AS (SELECT *, CASE WHEN status = 'succeeded' THEN 'eligible_processed' WHEN status = 'not_needed' THEN 'not_needed' WHEN k IN ('none', 'watermark_only') THEN 'not_needed' WHEN k NOT IN ('bottom_simple', 'top_simple', 'single_region') THEN 'ineligible'
  WHEN status IN ('failed_quality', 'residual_subtitle') THEN 'eligible_failed' WHEN status = 'derivative_deleted' THEN 'eligible_deleted' ELSE 'eligible_unprocessed' END AS eligibility FROM scan)"""


def _scan(s, d):
    return records.cleanup_scan(_rows(s, d, MEASURED), _rows(s, d, CLEANED))


def _report(s, d):
    r = _rows(s, d, CLEANED).withColumns({"before": F.col("b"), "after": F.col("a"), "regions": F.array(F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("x").alias("x2"), F.lit(0.5).alias("y2")))})
    return records.cleanup_report(_scan(s, d), r)


def _evidence(s, d):
    return records.evidence_reduction(_rows(s, d, BOXES), _rows(s, d, REST), _rows(s, d, COVERS), digits=8)


_W = "greatest(0, least(r.x2, k.x2) - greatest(r.x1, k.x1)) * greatest(0, least(r.y2, k.y2) - greatest(r.y1, k.y1))"
_EVIDENCE = f"""bf AS (SELECT clip_id, max(n) AS before_count, round_even(avg(a), 8) AS before_area FROM (SELECT clip_id, frame, count(*) AS n, sum((x2 - x1) * (y2 - y1)) AS a FROM b GROUP BY 1, 2) GROUP BY 1),
af AS (SELECT clip_id, max(n) AS after_count, round_even(avg(a), 8) AS after_area FROM (SELECT clip_id, frame, count(*) AS n, sum((x2 - x1) * (y2 - y1)) AS a FROM r GROUP BY 1, 2) GROUP BY 1),
lf AS (SELECT clip_id, count(*) AS residual FROM (SELECT DISTINCT r.clip_id, frame, r.x1, r.y1, r.x2, r.y2 FROM r JOIN k USING (clip_id) WHERE r.confidence >= 0.3 AND round_even({_W} / ((r.x2 - r.x1) * (r.y2 - r.y1)), 4) >= 0.1) GROUP BY 1),
j AS (SELECT clip_id, before_count, COALESCE(after_count, 0) AS after_count, before_area, COALESCE(after_area, 0.0) AS after_area, COALESCE(residual, 0) AS residual FROM bf LEFT JOIN af USING (clip_id) LEFT JOIN lf USING (clip_id)),
o AS (SELECT *, after_count < before_count OR (before_area > 0 AND after_area <= before_area * 0.5) AS reduced FROM j)
SELECT *, reduced AND residual = 0 AS success FROM o"""

QUERIES = {
    "read_library": (_read, "SELECT event_id, event_type, CAST(NULL AS DOUBLE) AS score, false AS was_reserve FROM events"),
    "parse_model_answers": (_answers, _twin({"a": ANSWERS}, """SELECT event, CASE WHEN r IS NULL THEN 'm' || event % 7 END AS material, CASE WHEN r IS NULL THEN stage END AS process_stage, CASE WHEN r IS NULL THEN event % 3 > 0 END AS people,
  CASE WHEN r IS NULL THEN CAST(event % 3 AS INT) END AS people_count, CASE WHEN r IS NULL THEN CASE WHEN event % 3 > 0 THEN 'unknown' ELSE 'none' END END AS person_role, CASE WHEN r IS NULL THEN 'hook,process' END AS roles,
  CASE WHEN r IS NULL THEN 0.325 END AS overall, r AS reason FROM (SELECT event, stage, CASE WHEN event % 5 >= 3 THEN 'invalid_json' WHEN event % 7 = 0 THEN 'unknown_stage' WHEN event % 11 = 0 THEN 'unknown_role' END AS r FROM a)""")),
    "overall_score": (
        lambda s, d: _rows(s, d, SCORES).select("clip_id", records.overall(F.col).alias("overall")),
        _twin({"t": SCORES}, "SELECT clip_id, round_even(material_relevance * 0.35 + visual_quality * 0.2 + COALESCE(subtitle_cleanliness, 0) * 0.15 + stability * 0.15 + composition * 0.15, 4) AS overall FROM t"),
    ),
    "parse_lists": (
        lambda s, d: _rows(s, d, LISTS).select("clip_id", F.array_join(records.parsed_list(F.col("value"), ROLES), "|").alias("roles")),
        _twin({"t": "SELECT clip_id, roles FROM {clips}"}, "SELECT clip_id, CASE WHEN clip_id % 4 = 3 THEN '' ELSE replace(roles, ',', '|') END AS roles FROM t"),
    ),
    "tag_rows": (_tags, _twin({"t": TAGGED}, _TAG_ROWS)),
    "insert_clips": (_inserted, _twin({"t": TAGGED, "g": TAGS}, f""", r AS ({_TAG_ROWS}), f AS (SELECT DISTINCT name, tag_category FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.name = r.name AND g.tag_category = r.tag_category)),
dim AS (SELECT * FROM g UNION ALL SELECT (SELECT max(tag_id) FROM g) + row_number() OVER (ORDER BY tag_category, name), name, tag_category FROM f)
SELECT tag_id, name, tag_category, (SELECT count(DISTINCT clip_id) FROM r WHERE r.name = dim.name AND r.tag_category = dim.tag_category) AS clips FROM dim""")),
    "backfill_metadata": (
        lambda s, d: records.backfill(_rows(s, d, BLANKS), _rows(s, d, TAG_RUNS), F.lit("local_test")),
        _twin({"t": BLANKS}, """SELECT clip_id, 'library_category' AS field, CASE WHEN clip_id % 2 = 0 THEN 'pear' ELSE 'plum' END AS new, '' AS reason FROM t WHERE clip_id % 3 = 0 UNION ALL
  SELECT clip_id, 'provenance', 'local_test', '' FROM t WHERE clip_id % 4 = 0 UNION ALL
  SELECT clip_id, 'tag_prompt_version', CASE WHEN clip_id % 6 = 0 THEN '' ELSE 'v1' END, CASE WHEN clip_id % 6 = 0 THEN 'ambiguous: v1,v2' ELSE '' END FROM t WHERE clip_id % 5 < 3"""),
    ),
    "export_manifest": (
        lambda s, d: records.manifest(_rows(s, d, EXPORT)),
        _twin({"t": EXPORT}, f"SELECT {_EXPORT_TWIN}, COALESCE(derivative_path, file_path) AS preferred_path, CASE WHEN clip_id % 3 = 0 THEN 'derivative' ELSE 'original' END AS preferred_kind, review_status <> 'rejected' AS usable_for_production FROM t"),
    ),
    "review_export": (
        lambda s, d: table(s, d, "clips").withColumn("review_note", F.lit("")).select(*records.REVIEW_FIELDS),
        "SELECT clip_id, review_status, favorite, '' AS review_note FROM clips",
    ),
    "file_inventory": (lambda s, d: records.suffixed(_rows(s, d, PRESENT), (".mp4", ".mov")), _twin({"p": PRESENT}, "SELECT * FROM p WHERE path LIKE '%.mp4'")),
    "missing_thumbnails": (
        lambda s, d: records.missing_thumbnails(_rows(s, d, FILES), _rows(s, d, PRESENT)),
        _twin({"t": FILES}, "SELECT clip_id, thumbnail_path FROM t WHERE clip_id % 10 <> 0 AND clip_id % 7 = 0"),
    ),
    "clip_acceptance": (
        lambda s, d: records.acceptance(_rows(s, d, FILES), _rows(s, d, PRESENT), _rows(s, d, PROBES), "/lib/a"),
        _twin({"t": FILES}, """SELECT *, file_exists AND inside_library_root AND provenance_is_real AND thumbnail_exists AND readable AND duration_in_range AND video_stream AS ok FROM
  (SELECT clip_id, clip_id % 10 <> 0 AS file_exists, clip_id % 19 <> 0 AS inside_library_root, provenance = 'remote' AS provenance_is_real, clip_id % 7 <> 0 AS thumbnail_exists, clip_id % 10 <> 0 AND clip_id % 17 <> 0 AS readable,
   clip_id % 10 <> 0 AND clip_id % 17 <> 0 AND duration BETWEEN 3 AND 15 AS duration_in_range, clip_id % 10 <> 0 AND clip_id % 17 <> 0 AND clip_id % 13 <> 0 AS video_stream FROM t)"""),
    ),
    "demo_removal": (
        lambda s, d: records.demo_removal(_rows(s, d, DEMOS)).withColumn("signals", F.array_join("signals", "|")),
        _twin({"t": DEMOS}, """SELECT clip_id, clip_id % 4 = 0 AS removable, CASE clip_id % 4 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'real' WHEN 2 THEN 'local_kept' ELSE 'unknown_origin' END AS code,
  CASE WHEN clip_id % 4 <> 0 THEN '' ELSE concat_ws('|', CASE WHEN greatest(COALESCE(width, 0), height) BETWEEN 1 AND 640 THEN 'small_picture' END, CASE WHEN size_bytes <= 204800 THEN 'small_file' END) END AS signals FROM t"""),
    ),
    "legacy_failures": (
        lambda s, d: records.legacy_failures(_rows(s, d, SOURCES), _rows(s, d, RUNS)),
        _twin({"t": SOURCES, "r": RUNS}, """, e AS (SELECT source_id, run_id, operation, CASE WHEN run_id % 4 = 0 THEN 'quota' ELSE '403' END AS marker FROM r WHERE status <> 'ok' AND (run_id % 4 = 0 OR run_id % 3 = 0)
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY run_id, operation, run_id % 4 <> 0) = 1)
SELECT source_id, run_id, operation, marker, run_id IS NOT NULL AS migrate FROM t LEFT JOIN e USING (source_id) WHERE status = 'rejected_preview' AND material_score IS NULL AND subtitle_score IS NULL"""),
    ),
    "tag_version_compare": (
        lambda s, d: records.version_compare(_rows(s, d, VERSIONS), "1", "2"),
        _twin({"t": VERSIONS}, """SELECT clip_id, a.stage AS stage_a, b.stage AS stage_b, a.shot AS shot_a, b.shot AS shot_b, a.description AS description_a, b.description AS description_b,
  concat_ws(',', CASE WHEN a.shot <> b.shot THEN 'shot' END, CASE WHEN clip_id % 5 = 0 THEN 'description' END) AS differs FROM t a JOIN t b USING (clip_id) WHERE a.version = 1 AND b.version = 2"""),
    ),
    "cleanup_scan": (_scan, _twin({"m": MEASURED, "c": CLEANED}, f""", {_SCAN} SELECT clip_id, k AS subtitle_class, measured, eligibility, eligibility NOT IN ('not_needed', 'ineligible') AS eligible,
  CASE WHEN status = 'succeeded' THEN CASE WHEN healthy THEN 'existing_succeeded:' || CASE WHEN review = '' THEN 'pending' ELSE review END ELSE 'missing_derivative' END WHEN status = 'not_needed' THEN CASE WHEN skip_reason = '' THEN status ELSE skip_reason END
  WHEN eligibility = 'not_needed' THEN 'classification=' || k WHEN eligibility = 'ineligible' THEN 'classification_not_eligible:' || k WHEN status = 'derivative_deleted' THEN status WHEN status <> '' THEN 'existing_' || status ELSE 'stored_classification' END AS reason FROM found""")),
    "cleanup_report": (_report, _twin({"m": MEASURED, "c": CLEANED}, f""", {_SCAN} SELECT (SELECT count(*) FROM found) AS clips, (SELECT count(*) FROM found WHERE eligibility = 'eligible_unprocessed') AS eligible_unprocessed,
  count(*) FILTER (WHERE status = 'not_needed') AS not_needed, count(*) FILTER (WHERE status = 'ineligible') AS ineligible, count(*) FILTER (WHERE status = 'failed_processing') AS failed_processing, count(*) FILTER (WHERE status = 'failed_quality') AS failed_quality,
  count(*) FILTER (WHERE status = 'residual_subtitle') AS residual_subtitle, count(*) FILTER (WHERE status = 'succeeded' AND review = 'approved') AS approved, count(*) FILTER (WHERE status = 'succeeded' AND review = 'rejected') AS rejected,
  count(*) FILTER (WHERE status = 'succeeded' AND review = '') AS succeeded_pending_review, count(*) FILTER (WHERE status = 'succeeded' AND NOT healthy) AS missing_derivative,
  round_even(avg(a - b) FILTER (WHERE status = 'succeeded'), 4) AS mean_gain, round_even(avg(round_even(x * 0.5, 5)) FILTER (WHERE status = 'succeeded'), 4) AS mean_masked_area FROM c""")),
    "hybrid_verdict": (
        lambda s, d: records.hybrid_verdict(_rows(s, d, OPINIONS)),
        _twin({"t": OPINIONS}, """, q AS (SELECT *, CASE model_complexity WHEN 'low' THEN 0.85 WHEN 'high' THEN 0.15 ELSE 0.5 END AS o, subtitle_class IN ('unknown', 'complex', 'single_region') AS open,
  CASE WHEN subtitle_class IS NULL THEN 0.0 WHEN subtitle_class = 'none' THEN CASE WHEN most_boxes = 0 THEN 1.0 ELSE 0.5 END WHEN subtitle_class = 'bottom_simple' THEN round_even(least(1.0::DOUBLE, 0.5 + greatest(0, 0.12::DOUBLE - avg_area) / 0.12::DOUBLE), 3)
  WHEN subtitle_class = 'large_center_text' THEN round_even(least(1.0::DOUBLE, 0.5 + (center_area - 0.08::DOUBLE) / 0.08::DOUBLE), 3) WHEN subtitle_class IN ('multi_region', 'colored_block') THEN round_even(least(1.0::DOUBLE, 0.5 + (multi - 0.4::DOUBLE) / 0.6::DOUBLE), 3)
  WHEN subtitle_class = 'watermark_only' THEN 0.9 ELSE 0.5 END AS confidence FROM t)
SELECT clip_id, confidence, subtitle_class IS NULL OR open OR confidence <= 0.65 AS ask, CASE WHEN subtitle_class IS NULL THEN COALESCE(model_class, 'unknown') WHEN open AND model_class IS NOT NULL THEN model_class ELSE subtitle_class END AS verdict,
  CASE WHEN subtitle_class IS NULL THEN CASE WHEN model_class IS NULL THEN 'unavailable' ELSE 'model_fallback' END WHEN model_class IS NULL THEN 'local' ELSE 'hybrid' END AS decision,
  CASE WHEN subtitle_class IS NULL AND model_class IS NOT NULL THEN o WHEN open AND model_class IS NOT NULL AND model_complexity IS NOT NULL THEN round_even((cleanliness + o) / 2, 3) ELSE cleanliness END AS cleanliness FROM q"""),
    ),
    "evidence_reduction": (_evidence, _twin({"b": BOXES, "r": REST, "k": COVERS}, f", {_EVIDENCE}")),
    "moving_text": (
        lambda s, d: records.moving_text(_rows(s, d, TRACKS)),
        _twin({"t": TRACKS}, """, w AS (SELECT clip_id, track, CASE WHEN jitter_y > 0.05 THEN 'moving_text_vertical_jitter:' || printf('%.3f', jitter_y) WHEN growth > 0.75 AND median_y1 < 0.5 THEN 'floating_top_text_growth:' || printf('%.2f', growth) END AS reason
  FROM t WHERE persistence >= 0.55) SELECT clip_id, arg_min(reason, (track, reason)) AS reason FROM w WHERE reason IS NOT NULL GROUP BY 1"""),
    ),
}
