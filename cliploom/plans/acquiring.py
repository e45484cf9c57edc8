"""Registered queries of acquisition and of incremental merges with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acquisition, health, merging, tables
from ..operators import vocabulary as v
from ..sources.adapters import pick
from ..sources.adapters import library as table
from .records import _rows, _twin

AS_OF = "1998-09-01 00:00:00"
REASONS = ["", "no_material", "duplicate_video", "already_processed", "duration_unknown_unresolved", "colored_text_block", "low_quality", "duplicate_url", "large_center_text"]
_S = "CAST({} AS VARCHAR(20))".format
_AT = f"TIMESTAMP '{AS_OF}' - INTERVAL '1' HOUR * CAST({{}} AS INT)"

STORED = f"""SELECT source_id, 'douyin' AS platform, {_S('source_id')} AS platform_video_id, url AS source_url, {pick('source_id % 1013', list(v.STATUSES))} AS status,
  NULLIF({pick('source_id % 1019', REASONS)}, '') AS reject_reason, CASE WHEN source_id % 4 <> 1 THEN {_AT.format('source_id % 911')} END AS last_attempt_at, {_AT.format('source_id % 57')} AS created_at FROM {{sources}} WHERE source_id % 5 <> 4"""
FOUND = f"""SELECT source_id AS hit_id, 'douyin' AS platform, CASE WHEN source_id % 29 = 0 THEN '' WHEN source_id % 6 = 5 THEN concat('x', {_S('source_id')}) ELSE {_S('source_id')} END AS platform_video_id,
  CASE WHEN source_id % 31 = 0 THEN NULL WHEN source_id % 8 = 0 THEN concat(url, '?new') ELSE url END AS source_url, {pick('source_id % 37', ['', '开箱 苹果', '游戏', '烘干 香蕉', '明星 综艺'])} AS title,
  {pick('source_id % 41', ['苹果干', '香菇', ''])} AS material, source_id % 13 = 0 AS unreadable, source_id % 17 = 0 AS no_video, source_id % 19 = 0 AS seen_id, source_id % 23 = 0 AS seen_url,
  CASE WHEN source_id % 7 <> 0 THEN duration * 4 END AS duration FROM {{sources}}"""
KINDS = f"""SELECT source_id, {pick('source_id % 101', ['mock', ' Local', 'douyin', '', 'web'])} AS adapter, {pick('source_id % 103', ['douyin', 'mock', 'local', 'Other ', ''])} AS platform,
  CASE WHEN source_id % 3 = 0 THEN {_S('source_id')} WHEN source_id % 3 = 1 THEN {_S('100000000000 + source_id')} ELSE concat('a', {_S('100000000000 + source_id')}) END AS video_id,
  {pick('source_id % 107', ['', 'https://www.douyin.com/video/1', 'https://v.example.com/1'])} AS url FROM {{sources}}"""
REJECTED = f"""SELECT source_id, NULLIF({pick('source_id % 1021', [*REASONS, 'too_many_stickers', 'subtitle_too_complex', 'quality_gate'])}, '') AS reason, source_id % 11 = 0 AS subtitle, source_id % 3 = 0 AS quality FROM {{sources}}"""
#: Hits of tasks; one source in a quarter of all.
HITS = f"""SELECT source_id AS seq, task_id % 11 AS task_id, concat('q', {_S('source_id % 59')}) AS query, 'douyin' AS platform, CASE WHEN source_id % 4 = 0 THEN '1' ELSE {_S('source_id % 3001')} END AS platform_video_id,
  source_id % 3 = 0 AS accepted, source_id % 6 = 0 AS downloaded, CASE WHEN source_id % 6 = 0 THEN source_id % 3 ELSE 0 END AS clips FROM {{sources}}"""
#: Changes of sources in two batches with a late one in each; one source has a fifth of them, and a time with several.
CHANGES = f"""SELECT source_id % 2 AS batch, 'douyin' AS platform, CASE WHEN source_id % 5 = 0 THEN 'hot' ELSE {_S('source_id % 499')} END AS platform_video_id, {_AT.format('100 + source_id % 397 - 60 * (source_id % 2)')} AS changed_at, source_id AS seq,
  url AS source_url, concat('t', {_S('source_id % 7')}) AS title, author, CASE WHEN source_id % 3 = 0 THEN task_id END AS task_id, CAST(NULL AS VARCHAR(9)) AS author_id, CAST(NULL AS VARCHAR(9)) AS cover_url,
  CASE WHEN source_id % 7 = 0 THEN '2024' END AS publish_time, CAST(NULL AS VARCHAR(9)) AS source_stats_json, CASE WHEN source_id % 6 < 2 THEN matched END AS matched_queries, CAST(NULL AS VARCHAR(9)) AS media_url,
  CASE WHEN source_id % 5 < 3 THEN duration END AS duration, CAST(NULL AS DOUBLE) AS preview_material_score, CASE WHEN source_id % 11 = 0 THEN source_id % 10 / 1e1 END AS preview_subtitle_score, CAST(NULL AS DOUBLE) AS preview_quality_score,
  {pick('source_id % 1013', list(v.STATUSES))} AS status, NULLIF({pick('source_id % 1019', REASONS)}, '') AS reject_reason, source_id % 3 = 1 AS touch FROM {{sources}}"""
#: Cleanups of clips: versions of a clip written again and again, the newest batch first in time for some.
CLEANED = f"""SELECT clip_id % 2 AS batch, floor(clip_id / 9e0) AS clip_id, concat('v', {_S('clip_id % 2')}) AS version, {_AT.format('300 + clip_id % 211 - 90 * (clip_id % 2)')} AS changed_at, clip_id AS seq,
  {pick('clip_id % 1009', ['succeeded', 'failed_quality', 'not_needed', 'pending'])} AS status, {pick('clip_id % 1013', ['pending', 'approved', 'rejected'])} AS review_status, clip_id % 4 = 0 AS eligible, clip_id % 500 AS processing_ms,
  CASE WHEN clip_id % 3 = 0 THEN concat('/clean/', {_S('clip_id')}) END AS output_path FROM {{clips}}"""

#: Clips with plain and crooked paths, some outside the library; cleanups inside and beside it; the files that there are.
NAMED = f"""SELECT clip_id, CASE clip_id % 7 WHEN 0 THEN concat('/other/', {_S('clip_id')}, '.mp4') WHEN 1 THEN concat('file:/lib//x/../', {_S('clip_id')}, '.mp4') WHEN 2 THEN '' ELSE concat('/lib/./', {_S('clip_id')}, '.mp4') END AS file_path,
  CASE WHEN clip_id % 3 = 0 THEN NULL WHEN clip_id % 11 = 0 THEN '/lib/../thumb.jpg' ELSE concat('/lib/t/', {_S('clip_id')}, '.jpg') END AS thumbnail_path FROM {{clips}}"""
OUTPUTS = f"SELECT clip_id, CASE WHEN clip_id % 2 = 0 THEN concat('/lib/clean/', {_S('clip_id')}, '.mp4') ELSE concat('/away/', {_S('clip_id')}, '.mp4') END AS output_path FROM {{clips}} WHERE clip_id % 5 = 0"
THERE = f"""SELECT concat('/lib/', {_S('clip_id')}, '.mp4') AS path FROM {{clips}} WHERE clip_id % 4 <> 1 UNION ALL SELECT concat('/lib/t/', {_S('clip_id')}, '.JPG') FROM {{clips}} WHERE clip_id % 13 = 0
  UNION ALL SELECT concat('/lib/t/', {_S('clip_id')}, '.jpg') FROM {{clips}} WHERE clip_id % 13 > 2 UNION ALL SELECT concat('/lib/clean/', {_S('clip_id')}, '.mp4') FROM {{clips}} WHERE clip_id % 4 = 0 UNION ALL SELECT concat('/away/', {_S('clip_id')}, '.mp4') FROM {{clips}} WHERE clip_id % 3 = 0"""


def _problems(s, d):
    return health.problems(_rows(s, d, NAMED), _rows(s, d, OUTPUTS), _rows(s, d, THERE), "/lib")


def _orphans(s, d):
    return health.orphans(_rows(s, d, NAMED), _rows(s, d, OUTPUTS), _rows(s, d, THERE), "/lib")

ANSWERS = f"""SELECT clip_id, clip_id % 31 AS frames, clip_id % 9 <> 0 AS answered, clip_id % 4 <> 0 AS accept, NULLIF({pick('clip_id % 1013', ['', 'too_many_stickers', 'low_quality', 'colored_text_block'])}, '') AS reject_reason, clip_id % 17 <> 0 AS material_visible,
  material_score AS relevance, visual AS quality, {pick('clip_id % 1019', ['low', 'medium', 'high', 'unknown', ''])} AS complexity, CASE WHEN clip_id % 5 < 3 THEN subtitle_type END AS measured_class, cleanliness, {pick('clip_id % 1021', ['strict', 'balanced', 'loose', 'off', 'odd'])} AS policy FROM {{clips}}"""
PROBED = f"SELECT source_id, {pick('source_id % 1009', ['invalid_media_source', 'media_unreachable', 'duration_unknown_unresolved', 'odd', ''])} AS state, CASE WHEN source_id % 3 > 0 THEN duration * 4 END AS seconds FROM {{sources}}"
STAGED = f"SELECT clip_id, stage, {pick('task_id', ['drying', '', 'factory', 'loading'])} AS wanted_stage FROM {{clips}}"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _decided(s, d):
    found = _rows(s, d, FOUND).select("hit_id", "platform", "platform_video_id")
    return acquisition.decided(found, _rows(s, d, STORED), _as_of()).select("hit_id", "skip", "why")


def _filtered(s, d):
    return acquisition.filtered(_rows(s, d, FOUND), _rows(s, d, STORED), _as_of()).select("hit_id", "accepted", "reason", "detail", "duration_unknown")


def _flags(s, d):
    return acquisition.source_flags(_rows(s, d, HITS), _rows(s, d, STORED), table(s, d, "clips"))


def _stored(spark, sf_dir, what, sql):
    """A new store to which two batches are applied, the second one twice."""
    store = merging.Store(spark, f"{tables.shared_folder(spark)}/{tables.unique(what.name)}", what, buckets=16)
    changes = _rows(spark, sf_dir, sql)
    missing = [c for c in [*what.overwrite, *what.fill] if c not in changes.columns]
    changes = changes.withColumns({c: F.lit(None).cast(what.values[c]) for c in missing})
    for batch in (0, 1, 1):
        store.apply(changes.filter(F.col("batch") == batch).drop("batch"), batch)
    return store


def _sources(s, d):
    names = ("source_url", "title", "author", "task_id", "publish_time", "matched_queries", "duration", "preview_subtitle_score", "status", "reject_reason", "attempt_count", "last_attempt_at", "created_at", "updated_at", "updated_seq", "batch_id")
    return _stored(s, d, merging.SOURCES, CHANGES).current().select("platform", "platform_video_id", *names)


def _cleanups(s, d):
    return _stored(s, d, merging.CLEANUPS, CLEANED).current().select("clip_id", "version", "status", "review_status", "eligible", "processing_ms", "output_path", "created_at", "updated_at", "updated_seq", "batch_id")


def _audit(s, d):
    return _stored(s, d, merging.SOURCES, CHANGES).audit().filter("action <> 'late'").groupBy("batch_id", "action", "field").agg(F.count("*").alias("n"), F.count("old_value").alias("had"))


def _in(names):
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


_AGE = f"(epoch(TIMESTAMP '{AS_OF}') - epoch(COALESCE(last_attempt_at, created_at))) / 3600.0"
_DECIDED = f"""o AS (SELECT *, {_AGE} AS age FROM stored), d AS (SELECT f.*, CASE WHEN o.source_id IS NULL THEN 'new'
  WHEN o.reject_reason = 'duration_unknown_unresolved' THEN CASE WHEN age < 6 THEN 'duration_unresolved_recent' ELSE 'retry_duration_unresolved' END
  WHEN o.status IN {_in(v.COMPLETED)} THEN 'already_processed' WHEN o.status IN {_in(v.IN_PROGRESS)} THEN CASE WHEN age < 6 THEN 'in_progress' ELSE 'stale_in_progress' END
  WHEN o.status IN {_in(v.REJECTED)} THEN CASE WHEN age < 720 THEN 'recently_rejected' ELSE 'retry_rejected' END
  WHEN o.status IN {_in(v.FAILED)} THEN CASE WHEN age < 24 THEN 'recent_failure' ELSE 'retry_failed' END ELSE 'unknown_status' END AS why
  FROM found f LEFT JOIN o ON o.platform = f.platform AND o.platform_video_id = f.platform_video_id),
e AS (SELECT *, why IN ('duration_unresolved_recent', 'already_processed', 'in_progress', 'recently_rejected', 'recent_failure') AS skip FROM d)"""
_OFF = " OR ".join(f"contains(title, '{w}')" for w in v.OFF_TOPIC)
_FILTERED = f"""SELECT hit_id, reason IS NULL AS accepted, reason, CASE WHEN reason = 'already_processed' THEN why END AS detail, reason IS NULL AND duration IS NULL AS duration_unknown FROM (
  SELECT *, CASE WHEN platform_video_id = '' OR COALESCE(source_url, '') = '' THEN 'unreachable' WHEN unreadable THEN 'corrupt_media' WHEN no_video THEN 'unusable_media' WHEN seen_id THEN 'duplicate_video' WHEN seen_url THEN 'duplicate_url'
    WHEN skip THEN 'already_processed' WHEN why = 'new' AND source_url IN (SELECT source_url FROM stored) THEN 'duplicate_url' WHEN duration IS NULL THEN NULL WHEN duration < 5 OR duration > 300 THEN 'duration_out_of_range'
    WHEN ({_OFF}) AND NOT COALESCE(list_bool_or(list_transform(string_split(material, ''), lambda c: c <> '' AND contains(title, c))), false) THEN 'title_irrelevant' END AS reason FROM e)"""
_KIND = """SELECT source_id, CASE lower(trim(adapter)) WHEN 'mock' THEN 'mock' WHEN 'local' THEN 'local_test' WHEN 'douyin' THEN CASE WHEN real THEN 'douyin_real' ELSE 'mock' END
  ELSE CASE lower(trim(platform)) WHEN 'local' THEN 'local_test' WHEN 'mock' THEN 'mock' WHEN 'douyin' THEN CASE WHEN real AND (url = '' OR contains(url, 'douyin.com')) THEN 'douyin_real' ELSE 'mock' END ELSE 'unknown' END END AS kind
  FROM (SELECT *, regexp_full_match(video_id, '[0-9]+') AND length(video_id) >= 12 AS real FROM k)"""
_BUCKET = f"""SELECT CASE WHEN reason IN {_in(v.BOOKKEEPING_REASONS)} THEN 'duplicate' WHEN subtitle OR COALESCE(reason IN {_in(v.SUBTITLE_REASONS)}, false) THEN 'subtitle' WHEN quality THEN 'quality' ELSE 'other' END AS bucket, count(*) AS n FROM r GROUP BY 1"""
_FLAGGED = f"""x AS (SELECT h.*, row_number() OVER (PARTITION BY h.task_id, h.platform_video_id ORDER BY seq) > 1 AS again, o.source_id IS NULL AS new, o.source_id IS NOT NULL AS known, COALESCE(o.status IN {_in(v.HANDLED)}, false) AS processed,
  o.source_id IS NOT NULL AND o.source_id IN (SELECT source_id FROM clips) AS represented FROM hits h LEFT JOIN stored o ON o.platform_video_id = h.platform_video_id)"""


def _folded(keys: str, first: str, step: str, rows: str = "changes") -> str:
    """SQL that applies the changes of each key one by one; late ones of the second batch lose."""
    return f"""s0 AS (SELECT {keys}, max((changed_at, seq)) AS top FROM {rows} WHERE batch = 0 GROUP BY ALL),
live AS (SELECT c.* FROM {rows} c LEFT JOIN s0 USING ({keys}) WHERE batch = 0 OR s0.top IS NULL OR (c.changed_at, c.seq) > s0.top),
lists AS (SELECT {keys}, list(c ORDER BY batch, changed_at, seq) AS cs FROM live c GROUP BY {keys})"""


#: The sequential rule as it stands: each change meets the status that the one before left.
_SOURCES = f"""{_folded('platform, platform_video_id', '', '')},
steps AS (SELECT platform, platform_video_id, cs, list_reduce(list_transform(cs, lambda c: [c.status, c.reject_reason]), lambda a, c: CASE WHEN a[1] IN {_in(v.SETTLED_STATUSES)} AND COALESCE(c[2] IN {_in(v.BOOKKEEPING_REASONS)}, false) THEN a ELSE c END) AS verdict FROM lists)
SELECT platform, platform_video_id, cs[-1].source_url AS source_url, cs[-1].title AS title, cs[-1].author AS author, list_filter(cs, lambda c: c.task_id IS NOT NULL)[-1].task_id AS task_id,
  list_filter(cs, lambda c: c.publish_time IS NOT NULL)[-1].publish_time AS publish_time, list_filter(cs, lambda c: c.matched_queries IS NOT NULL)[-1].matched_queries AS matched_queries,
  list_filter(cs, lambda c: c.duration IS NOT NULL)[-1].duration AS duration, list_filter(cs, lambda c: c.preview_subtitle_score IS NOT NULL)[-1].preview_subtitle_score AS preview_subtitle_score, verdict[1] AS status, verdict[2] AS reject_reason,
  len(list_filter(cs, lambda c: c.touch)) AS attempt_count, list_filter(cs, lambda c: c.touch)[-1].changed_at AS last_attempt_at, list_min(list_transform(list_filter(cs, lambda c: c.batch = cs[1].batch), lambda c: c.changed_at)) AS created_at,
  cs[-1].changed_at AS updated_at, cs[-1].seq AS updated_seq, cs[-1].batch AS batch_id FROM steps"""
_CLEANUPS = f"""{_folded('clip_id, version', '', '')}
SELECT CAST(clip_id AS BIGINT) AS clip_id, version, cs[-1].status AS status, cs[-1].review_status AS review_status, cs[-1].eligible AS eligible, cs[-1].processing_ms AS processing_ms, cs[-1].output_path AS output_path,
  list_min(list_transform(list_filter(cs, lambda c: c.batch = cs[1].batch), lambda c: c.changed_at)) AS created_at, cs[-1].changed_at AS updated_at, cs[-1].seq AS updated_seq, cs[-1].batch AS batch_id FROM lists"""

_CLASS = "CASE measured_class " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in v.CLASS_REASONS.items()) + " ELSE 'subtitle_too_complex' END"
_LIMIT = "CASE policy " + " ".join(f"WHEN '{k}' THEN {x}::DOUBLE" for k, x in v.SCORE_LIMITS.items()) + f" ELSE {v.SCORE_LIMITS['strict']}::DOUBLE END"
_PREVIEWED = f"""SELECT clip_id, rule IN ('measurement', 'policy') AS accepted, CASE rule WHEN 'frames' THEN 'unusable_visual' WHEN 'answer' THEN 'other' WHEN 'model' THEN COALESCE(reject_reason, 'other') WHEN 'material' THEN 'no_material' WHEN 'quality' THEN 'low_quality'
  WHEN 'class' THEN {_CLASS} WHEN 'score' THEN {_CLASS} WHEN 'complexity' THEN 'subtitle_too_complex' END AS reason, rule IN ('class', 'score', 'complexity') OR rule = 'model' AND COALESCE(reject_reason IN {_in(v.SUBTITLE_REASONS)}, false) AS subtitle_rejected, rule = 'answer' AS failed, rule FROM (
  SELECT *, CASE WHEN frames = 0 THEN 'frames' WHEN NOT answered THEN 'answer' WHEN NOT accept THEN 'model' WHEN NOT material_visible OR relevance < 0.35::DOUBLE THEN 'material' WHEN quality < 0.45::DOUBLE THEN 'quality' WHEN measured_class IN {_in(v.HARD_CLASSES)} THEN 'class'
    WHEN measured_class IS NOT NULL THEN CASE WHEN round_even(1 - cleanliness, 3) > {_LIMIT} THEN 'score' ELSE 'measurement' END
    WHEN complexity = 'low' OR complexity = 'medium' AND policy IN ('balanced', 'loose', 'off') OR complexity IN ('high', 'unknown') AND policy = 'off' THEN 'policy' ELSE 'complexity' END AS rule FROM t)"""

QUERIES = {
    "acquisition_decision": (_decided, _twin({"stored": STORED, "found": FOUND}, f", {_DECIDED} SELECT hit_id, skip, why FROM e")),
    "candidate_filter": (_filtered, _twin({"stored": STORED, "found": FOUND}, f", {_DECIDED} {_FILTERED}")),
    "provenance": (lambda s, d: _rows(s, d, KINDS).select("source_id", acquisition.provenance(F.col("adapter"), F.col("platform"), F.col("video_id"), F.col("url")).alias("kind")), _twin({"k": KINDS}, _KIND)),
    "rejection_bucket": (lambda s, d: _rows(s, d, REJECTED).groupBy(acquisition.rejection_bucket(F.col("reason"), F.col("subtitle"), F.col("quality")).alias("bucket")).agg(F.count("*").alias("n")), _twin({"r": REJECTED}, _BUCKET)),
    "known_sources": (lambda s, d: _flags(s, d).select("seq", "again", "new", "known", "processed", "represented"), _twin({"hits": HITS, "stored": STORED}, f", {_FLAGGED} SELECT seq, again, new, known, processed, represented FROM x")),
    "write_yields": (
        lambda s, d: acquisition.yield_rows(_flags(s, d)),
        _twin({"hits": HITS, "stored": STORED}, f""", {_FLAGGED} SELECT task_id, query, count(*) AS candidates, count(*) FILTER (NOT again) AS uniques, count(*) FILTER (again) AS current_run_duplicate, count(*) FILTER (new) AS new_to_system, count(*) FILTER (known) AS known_source,
  count(*) FILTER (processed) AS already_processed, count(*) FILTER (represented) AS already_represented, count(*) FILTER (accepted) AS accepted, count(*) FILTER (downloaded) AS downloads, CAST(sum(clips) AS BIGINT) AS clips FROM x GROUP BY 1, 2"""),
    ),
    "preview_decision": (lambda s, d: acquisition.previews(_rows(s, d, ANSWERS)).select("clip_id", "accepted", "reason", "subtitle_rejected", "failed", "rule"), _twin({"t": ANSWERS}, _PREVIEWED)),
    "duration_route": (
        lambda s, d: acquisition.duration_routes(_rows(s, d, PROBED)).select("source_id", "ready", "reason", "status"),
        _twin({"t": PROBED}, """SELECT source_id, seconds BETWEEN 5 AND 300 AND seconds IS NOT NULL AS ready, CASE WHEN seconds IS NULL THEN CASE state WHEN 'invalid_media_source' THEN state WHEN 'media_unreachable' THEN 'unreachable' ELSE 'duration_unknown_unresolved' END WHEN seconds NOT BETWEEN 5 AND 300 THEN 'duration_out_of_range' END AS reason,
  CASE WHEN seconds IS NULL THEN CASE WHEN state IN ('invalid_media_source', 'media_unreachable', 'duration_unknown_unresolved') THEN 'failed_media' ELSE 'rejected' END WHEN seconds NOT BETWEEN 5 AND 300 THEN 'rejected' END AS status FROM t"""),
    ),
    "stage_target_gate": (lambda s, d: acquisition.stage_gate(_rows(s, d, STAGED)).select("clip_id", "accepted", "reason"), _twin({"t": STAGED}, "SELECT clip_id, wanted_stage IN ('', stage) AS accepted, CASE WHEN wanted_stage NOT IN ('', stage) THEN 'target_stage_mismatch' END AS reason FROM t")),
    "missing_files": (_problems, _twin({"n": NAMED, "o": OUTPUTS, "p": THERE}, f"""SELECT 'video' AS kind, clip_id, CASE clip_id % 7 WHEN 0 THEN concat('/other/', clip_id, '.mp4') WHEN 2 THEN NULL ELSE concat('/lib/', clip_id, '.mp4') END AS path,
  CASE WHEN clip_id % 7 IN (0, 2) THEN 'outside_root' ELSE 'missing_file' END AS reason FROM n WHERE clip_id % 7 IN (0, 2) OR clip_id % 4 = 1
  UNION ALL SELECT 'thumbnail', clip_id, CASE WHEN clip_id % 11 = 0 THEN '/thumb.jpg' ELSE thumbnail_path END, CASE WHEN clip_id % 11 = 0 THEN 'outside_root' ELSE 'missing_file' END FROM n WHERE clip_id % 3 <> 0 AND (clip_id % 11 = 0 OR thumbnail_path NOT IN (SELECT path FROM p))
  UNION ALL SELECT 'cleanup', clip_id, output_path, 'missing_file' FROM o WHERE output_path NOT IN (SELECT path FROM p)""")),
    "orphan_files": (_orphans, _twin({"n": NAMED, "o": OUTPUTS, "p": THERE}, """SELECT path, CASE WHEN path LIKE '%.mp4' THEN 'media' ELSE 'thumbnail' END AS kind FROM p WHERE path LIKE '/lib/%'
  AND path NOT IN (SELECT concat('/lib/', clip_id, '.mp4') FROM n WHERE clip_id % 7 NOT IN (0, 2)) AND path NOT IN (SELECT output_path FROM o) AND path NOT IN (SELECT thumbnail_path FROM n WHERE thumbnail_path IS NOT NULL)""")),
    "upsert_sources": (_sources, _twin({"changes": CHANGES}, f", {_SOURCES}")),
    "upsert_cleanups": (_cleanups, _twin({"changes": CLEANED}, f", {_CLEANUPS}")),
    "source_audit": (_audit, None),
}
