"""Registered queries of gates, frames, boxes, links, tags and media with their SQL twins.

Fixtures are SQL over the given and the adapted tables that both engines run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import coverage, geometry, library, records, rules
from ..sources.adapters import MATERIALS, pick
from ..sources.adapters import library as table
from .records import _TAG_ROWS, _S, TAGGED, TAGS, _rows, _tags, _twin

SITE, PREFIX = "example.com", "https://v.example.com/video/"
GATED = f"""SELECT clip_id, duration, subtitle_type, subtitle_score, material_score, visual, overall, {pick('clip_id', ['strict', 'balanced', 'loose', 'off', 'odd'])} AS policy,
  {pick('clip_id', MATERIALS)} AS material, {pick('clip_id * 3', [*MATERIALS, ''])} AS required_material FROM {{clips}}"""
NUMBERED = "SELECT clip_id, frame, row_number() OVER (PARTITION BY clip_id, frame ORDER BY x1, y1, x2, y2) AS box, x1, y1, x2, y2 FROM {regions}"
#: Given pages with links and JSON fields of videos put in front, some of them twice.
_VIDEO = _S("1000000 + page_id % 50")
PAGES = f"""SELECT page_id, concat('<a href="/video/', {_VIDEO}, '">', CASE WHEN page_id % 3 = 0 THEN concat('{{{{"aweme_id" : "', {_S('20000000000 + page_id')}, '"}}}}') ELSE '' END, html,
  '<a href="//x/note/', {_S('900000 + page_id')}, '?a=1"><a href="/video/', {_VIDEO}, '"><a href="/video/12345">') AS html FROM {{pages}}"""
URLS = f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('//v.example.com/video/', {_VIDEO}, '?a=1') WHEN 1 THEN concat('  https://V.Example.com/note/', {_VIDEO}, '/x#t ')
  WHEN 2 THEN concat(url, '/video/12345') WHEN 3 THEN concat('https://else.org/video/', {_VIDEO}) WHEN 4 THEN concat(url, '?to=/video/', {_VIDEO}) ELSE concat('v.example.com/video/', {_VIDEO}) END AS url FROM {{pages}}"""
DERIVED = f"""SELECT clip_id, clip_id * 10 + v AS cleanup_id, CASE (clip_id + v) % 4 WHEN 0 THEN 'failed_quality' ELSE 'succeeded' END AS status,
  CASE (clip_id + v * 2) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'approved' END AS review_status, concat('/clean/', {_S('clip_id')}, '_', {_S('v')}) AS output_path
  FROM {{clips}}, (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3) w WHERE clip_id % 6 > 0"""
STORED = f"SELECT output_path AS path FROM ({DERIVED}) d WHERE cleanup_id % 7 <> 0"
ORIGINALS = f"SELECT clip_id, concat('/lib/', {_S('clip_id')}, '.mp4') AS file_path FROM {{clips}}"


def _given(spark, sf_dir, sql):
    return spark.sql(sql, pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _links(s, d):
    found = _given(s, d, PAGES).select("page_id", text.page_video_ids(F.col("html")).alias("ids"))
    return found.select("page_id", F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", " ").alias("ids"))


def _urls(s, d):
    url = F.col("url")
    return _given(s, d, URLS).select("page_id", text.is_permalink(url, SITE).alias("is_permalink"), text.permalink_id(url).alias("video_id"), text.canonical_url(url, PREFIX).alias("canonical"))


def _lists(s, d):
    lists = library.tag_lists(*records.insert_clips(_tags(s, d), _rows(s, d, TAGS)))
    return lists.select("clip_id", F.array_join("tags", ",").alias("tags"))


def _orphans(s, d):
    """Tags left when every clip of one material, and of one stage, has gone."""
    tags, bridge = records.insert_clips(_tags(s, d), _rows(s, d, TAGS))
    left = _rows(s, d, TAGGED).filter("clip_id % 9 <> 2 AND process_stage <> 'drying'")
    return library.orphan_tags(tags, rules.removed(bridge, left)).select("name", "tag_category")


def _media(s, d):
    return library.preferred_media(_rows(s, d, ORIGINALS), _rows(s, d, DERIVED), _rows(s, d, STORED))


def _overview(s, d):
    return coverage.overview(table(s, d, "clips"), F.col("category") == "mushroom", "remote")


def _with_pages(sql: str, body: str) -> str:
    return f"WITH p AS ({sql.format(pages='pages')}) {body}"


def _middles(n: str, start: str, width: str) -> str:
    return f"list_transform(range(0, {n}), lambda i: {start} + {width} * (i + 0.5::DOUBLE) / {n})"


_AREA = "round_even(round_even(x2 - x1, 4) * round_even(y2 - y1, 4), 5) AS a, round_even((x1 + x2) / 2, 4) AS cx, round_even((y1 + y2) / 2, 4) AS cy"
_SHARED = "greatest(0.0::DOUBLE, least(m.x2, o.x2) - greatest(m.x1, o.x1)) * greatest(0.0::DOUBLE, least(m.y2, o.y2) - greatest(m.y1, o.y1))"
_FRAMES = f"""WITH n AS (SELECT source_id, duration AS d, CAST(CASE WHEN duration <= 15 THEN 6 WHEN duration <= 45 THEN 8 WHEN duration <= 90 THEN 10 ELSE 12 END AS BIGINT) AS n FROM sources),
  t AS (SELECT source_id, 'uniform' AS strategy, {_middles('n', '0.0::DOUBLE', 'd')} AS l FROM n
   UNION ALL SELECT source_id, 'uniform_edges', list_concat(list_concat({_middles('(n // 3)', '0.0::DOUBLE', '(d * 0.15::DOUBLE)')}, {_middles('(n - 2 * (n // 3))', '(d * 0.35::DOUBLE)', '(d * 0.3::DOUBLE)')}),
     {_middles('(n // 3)', '(d - d * 0.15::DOUBLE)', '(d * 0.15::DOUBLE)')}) FROM n
   UNION ALL SELECT source_id, 'dense_start', list_concat({_middles('(n // 2)', '0.0::DOUBLE', '(d * 0.4::DOUBLE)')}, {_middles('(n - n // 2)', '(d * 0.4::DOUBLE)', '(d * 0.6::DOUBLE)')}) FROM n
   UNION ALL SELECT source_id, 'clip', [d * 0.2::DOUBLE, d * 0.4::DOUBLE, d * 0.6::DOUBLE, d * 0.8::DOUBLE] FROM n)
  SELECT DISTINCT source_id, strategy, round_even(unnest(l), 8) AS "at" FROM t"""

QUERIES = {
    "quality_gate": (lambda s, d: library.quality_gate(_rows(s, d, GATED)), _twin({"g": GATED}, """, r AS (SELECT clip_id, CASE WHEN duration < 3 THEN 'segment_too_short' WHEN duration > 15 THEN 'quality_gate' WHEN subtitle_type IN ('multi_region', 'colored_block', 'complex') THEN 'subtitle_too_complex'
  WHEN subtitle_score > CASE policy WHEN 'strict' THEN 0.35::DOUBLE WHEN 'balanced' THEN 0.5::DOUBLE WHEN 'loose' THEN 0.7::DOUBLE WHEN 'off' THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END THEN 'subtitle_too_complex'
  WHEN required_material <> '' AND regexp_replace(required_material, '[干片]$', '') <> regexp_replace(material, '[干片]$', '') THEN 'no_material' WHEN material_score < 0.6::DOUBLE THEN 'no_material'
  WHEN visual < 0.5::DOUBLE THEN 'low_quality' WHEN overall < 0.55::DOUBLE THEN 'quality_gate' END AS reason FROM g)
SELECT clip_id, reason IS NULL AS accepted, reason, COALESCE(reason = 'subtitle_too_complex', false) AS subtitle_rejected FROM r""")),
    "region_match": (lambda s, d: geometry.matched_regions(_rows(s, d, NUMBERED)), _twin({"b": NUMBERED}, f""", z AS (SELECT *, {_AREA} FROM b),
p AS (SELECT m.clip_id, m.frame, m.box, o.box AS other, round_even({_SHARED} / (m.a + o.a - {_SHARED}), 4) AS iou, round_even(sqrt((m.cx - o.cx) * (m.cx - o.cx) + (m.cy - o.cy) * (m.cy - o.cy)), 4) AS far
  FROM z m JOIN z o ON m.clip_id = o.clip_id AND m.frame = o.frame + 1),
f AS (SELECT clip_id, frame, box, first(other ORDER BY iou DESC, other) FILTER (WHERE iou >= 0.3::DOUBLE) AS most, min(other) FILTER (WHERE far <= 0.08::DOUBLE) AS nearest FROM p GROUP BY 1, 2, 3)
SELECT clip_id, frame, box, COALESCE(most, nearest) AS "match" FROM b LEFT JOIN f USING (clip_id, frame, box)""")),
    "frame_plan": (lambda s, d: rules.frame_plan(table(s, d, "sources").select("source_id", F.col("duration").alias("seconds")), digits=8), _FRAMES),
    "html_links": (_links, _with_pages(PAGES, """, l AS (SELECT page_id, list_concat(regexp_extract_all(html, '/(?:video|note)/([0-9]{6,})', 1), regexp_extract_all(html, '"(?:aweme_id|awemeId|aweme_id_str)"\\s*:\\s*"?([0-9]{10,})"?', 1)) AS x FROM p),
k AS (SELECT page_id, list_filter(x, lambda v, i: list_position(x, v) = i) AS ids FROM l) SELECT page_id, len(ids) AS n_ids, array_to_string(ids, ' ') AS ids FROM k""")),
    "url_filter": (_urls, _with_pages(URLS, f""", v AS (SELECT page_id, url, CAST(1000000 + page_id % 50 AS VARCHAR) AS id FROM p)
SELECT page_id, page_id % 6 IN (0, 1) AS is_permalink, CASE WHEN page_id % 6 IN (0, 1, 3, 5) THEN id END AS video_id, CASE WHEN page_id % 6 IN (0, 1, 3, 5) THEN '{PREFIX}' || id ELSE string_split(trim(url), '?')[1] END AS canonical FROM v""")),
    "clip_tags_list": (_lists, _twin({"t": TAGGED}, f", r AS (SELECT DISTINCT * FROM ({_TAG_ROWS})) SELECT clip_id, string_agg(name, ',' ORDER BY tag_category, name) AS tags FROM r GROUP BY 1")),
    "orphan_tags": (_orphans, _twin({"t": TAGGED, "g": TAGS}, f""", r AS ({_TAG_ROWS}), left_rows AS (SELECT * FROM r WHERE clip_id IN (SELECT clip_id FROM t WHERE clip_id % 9 <> 2 AND process_stage <> 'drying')),
every AS (SELECT name, tag_category FROM r UNION SELECT name, tag_category FROM g) SELECT name, tag_category FROM every WHERE NOT EXISTS (SELECT 1 FROM left_rows l WHERE l.name = every.name AND l.tag_category = every.tag_category)""")),
    "library_overview": (_overview, """SELECT count(*) AS total, count(*) FILTER (WHERE provenance = 'remote') AS "real", count(*) FILTER (WHERE review_status IN ('', 'unreviewed')) AS unreviewed, count(*) FILTER (WHERE review_status = 'approved') AS approved,
  count(*) FILTER (WHERE favorite) AS favorite, count(*) FILTER (WHERE category = 'mushroom') AS filtered, round_even(sum(duration) FILTER (WHERE category = 'mushroom'), 2) AS filtered_seconds FROM clips"""),
    "preferred_media": (_media, _twin({"o": ORIGINALS, "c": DERIVED, "f": STORED}, """, g AS (SELECT clip_id, max(cleanup_id) AS newest FROM c WHERE status = 'succeeded' AND review_status = 'approved' AND output_path IN (SELECT path FROM f) GROUP BY 1)
SELECT clip_id, COALESCE('/clean/' || clip_id || '_' || (newest - clip_id * 10), file_path) AS media FROM o LEFT JOIN g USING (clip_id)""")),
}
