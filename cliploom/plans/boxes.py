"""Registered queries of text boxes, subtitle classes, tracks, masks and time ranges with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, segments, tracks
from ..sources.adapters import library as table
from .records import _rows

_SHARE = "round_even(count(*) FILTER (WHERE {}) / count(*)::DOUBLE, 4)".format
_MEAN = "round_even(sum({}) / count(*), 8)".format
_ZONES = "list_sort(list_distinct(flatten(list(zones))))"
_WORDS = "|".join(geometry.PROMOTION)
GEO = f"""geo AS (SELECT *, round_even(width * height, 5) AS area, CASE WHEN center_y < 0.25 THEN 'top' WHEN center_y < 0.72 THEN 'center' ELSE 'bottom' END AS zone,
  round_even(width * height, 5) <= 0.02 AND (x2 <= 0.18 OR x1 >= 1 - 0.18::DOUBLE) AND (y2 <= 0.18 OR y1 >= 1 - 0.18::DOUBLE) AS watermark
  FROM (SELECT *, round_even(x2 - x1, 4) AS width, round_even(y2 - y1, 4) AS height, round_even((x1 + x2) / 2, 4) AS center_x, round_even((y1 + y2) / 2, 4) AS center_y FROM regions)),
fr AS (SELECT s.clip_id, s.frame, count(area) AS boxes, count(*) FILTER (WHERE area > 0.02) AS significant, COALESCE(round_even(sum(area), 5), 0) AS area, COALESCE(max(area), 0) AS largest,
  COALESCE(round_even(sum(area) FILTER (WHERE zone = 'top'), 5), 0) AS top_area, COALESCE(round_even(sum(area) FILTER (WHERE zone = 'center'), 5), 0) AS center_area, COALESCE(round_even(sum(area) FILTER (WHERE zone = 'bottom'), 5), 0) AS bottom_area,
  count(*) FILTER (WHERE width >= 0.7 AND height >= 0.08) AS bands, COALESCE(round_even(sum(area) FILTER (WHERE watermark), 5), 0) AS watermark_area,
  COALESCE(list_sort(list(DISTINCT zone) FILTER (WHERE area > 0.02)), []) AS zones, COALESCE(list_sort(list(DISTINCT zone) FILTER (WHERE zone IS NOT NULL)), []) AS all_zones,
  COALESCE(bool_or(regexp_matches(words, '{_WORDS}')), false) AS promotion FROM sampled s LEFT JOIN geo g ON g.clip_id = s.clip_id AND g.frame = s.frame GROUP BY 1, 2),
tm AS (SELECT clip_id, {_SHARE('boxes > 0')} AS presence, {_SHARE('bottom_area > 0')} AS bottom, {_SHARE('center_area >= 0.1')} AS center, {_SHARE('largest >= 0.1')} AS large,
  {_SHARE('len(CASE WHEN len(zones) > 0 THEN zones ELSE all_zones END) >= 2')} AS multi, {_SHARE('bands > 0')} AS band, {_MEAN('area')} AS avg_area, {_MEAN('top_area')} AS avg_top, {_MEAN('center_area')} AS avg_center, {_MEAN('bottom_area')} AS avg_bottom,
  max(boxes) AS most_boxes, max(significant) AS most_significant, max(boxes) > 0 AND bool_and(boxes = 0 OR watermark_area >= area - 1e-9) AS watermark_only,
  count(*) FILTER (WHERE promotion) >= greatest(1, count(*) // 2) AS promotion, {_ZONES} AS zones FROM fr GROUP BY clip_id),
cl AS (SELECT *, CASE WHEN most_boxes = 0 THEN 'none' WHEN watermark_only THEN 'watermark_only' WHEN promotion THEN 'promotional_overlay' WHEN avg_area >= 0.25 THEN 'dense_text' WHEN avg_center >= 0.1 AND center >= 0.5 THEN 'large_center_text'
  WHEN band >= 0.4 AND multi >= 0.4 THEN 'colored_block' WHEN multi >= 0.4 THEN 'multi_region' WHEN band >= 0.4 THEN 'colored_block' WHEN shown = ['bottom'] AND avg_area <= 0.12 AND most_significant <= 3 THEN 'bottom_simple'
  WHEN shown = ['bottom'] THEN 'single_region' WHEN shown = ['top'] THEN 'top_simple' WHEN most_boxes <= 1 THEN 'single_region' ELSE 'complex' END AS subtitle_class FROM
  (SELECT *, CASE WHEN len(zones) > 0 THEN zones ELSE list_filter([CASE WHEN avg_bottom > 0 THEN 'bottom' END, CASE WHEN avg_center > 0 THEN 'center' END, CASE WHEN avg_top > 0 THEN 'top' END], lambda z: z IS NOT NULL) END AS shown FROM tm))"""
_CLEAN = """SELECT clip_id, CASE WHEN subtitle_class = 'none' THEN 1.0 ELSE round_even(greatest(0, least(1, 1 - (0.45::DOUBLE * center * least(1, avg_center / 0.1::DOUBLE) + 0.35::DOUBLE * multi
  + 0.3::DOUBLE * least(1, greatest(0, avg_area - avg_bottom) / 0.25::DOUBLE) + 0.25::DOUBLE * band + 0.08::DOUBLE * bottom + CASE WHEN NOT watermark_only AND avg_top > 0 THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN subtitle_class = 'dense_text' THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN watermark_only THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN promotion THEN 0.25::DOUBLE ELSE 0 END))), 3) END AS cleanliness FROM cl"""
_FRAME = ["clip_id", "frame", "boxes", "significant", "area", "largest", "top_area", "center_area", "bottom_area", "bands", "watermark_area", "promotion"]
_TIME = ["clip_id", "presence", "bottom", "center", "large", "multi", "band", "avg_area", "avg_top", "avg_center", "avg_bottom", "most_boxes", "most_significant", "watermark_only", "promotion"]


def _frames(spark, sf_dir):
    return geometry.frames(table(spark, sf_dir, "regions"), table(spark, sf_dir, "sampled"))


def _metrics(spark, sf_dir):
    return geometry.temporal(_frames(spark, sf_dir), digits=8)


def _classified(spark, sf_dir):
    return segments.classify(_metrics(spark, sf_dir))


#: Steady lines of text at three heights that tremble, jump or pause, beside the given boxes.
LINES = """SELECT clip_id, CAST(frame AS DOUBLE) * 0.5e0 AS t, x1, y1, x2, y2, 0.2 + event % 8 / 1e1 AS confidence, concat(words, event % 3) AS text FROM (
  SELECT clip_id, frame, row_number() OVER (PARTITION BY clip_id, frame ORDER BY x1, y1, x2, y2) * 5 + frame AS event, x1, y1, x2, y2, words FROM {regions}) r
  UNION ALL SELECT clip_id, frame * 0.5e0 + CASE WHEN frame >= 3 THEN clip_id % 3 ELSE 0 END, 0.1 + frame % 2 / 2e2, 0.75 + line * 0.08 + clip_id % 5 * frame / 2e2, 0.5 + clip_id % 4 / 1e1, 0.8 + line * 0.08 + clip_id % 5 * frame / 2e2, 0.9, concat('line ', line, ' ', frame % 2)
  FROM {sampled}, (SELECT 0 AS line UNION ALL SELECT 1) l WHERE (clip_id + line) % 3 > 0"""
SIZES = "SELECT DISTINCT clip_id, CAST(CASE WHEN clip_id % 2 = 0 THEN 1080 ELSE 120 END AS INT) AS width, CAST(CASE WHEN clip_id % 2 = 0 THEN 1920 ELSE 160 END AS INT) AS height FROM {sampled}"


def _tracks(spark, sf_dir):
    return tracks.tracks(_rows(spark, sf_dir, LINES))


def _stats(spark, sf_dir):
    return tracks.stats(_tracks(spark, sf_dir), 4)


def _shown(found):
    spans = F.array_join(F.transform("intervals", lambda x: F.format_string("%.2f-%.2f", x["start"], x["end"])), " ")
    return found.withColumn("intervals", spans).withColumn("texts", F.array_join("texts", "|"))


def _masks(spark, sf_dir):
    found = tracks.masks(tracks.stable(_stats(spark, sf_dir)), _rows(spark, sf_dir, SIZES))
    return found.select("clip_id", "track", "x1", "y1", "x2", "y2", "area", "persistence", "reason")


_IOU = """CASE WHEN least(b.x2, o.x2) > greatest(b.x1, o.x1) AND least(b.y2, o.y2) > greatest(b.y1, o.y1) AND b.area + o.area - (least(b.x2, o.x2) - greatest(b.x1, o.x1)) * (least(b.y2, o.y2) - greatest(b.y1, o.y1)) > 0
  THEN round_even((least(b.x2, o.x2) - greatest(b.x1, o.x1)) * (least(b.y2, o.y2) - greatest(b.y1, o.y1)) / (b.area + o.area - (least(b.x2, o.x2) - greatest(b.x1, o.x1)) * (least(b.y2, o.y2) - greatest(b.y1, o.y1))), 4) ELSE 0 END"""
_FAR = "round_even(sqrt((b.cx - o.cx) * (b.cx - o.cx) + (b.cy - o.cy) * (b.cy - o.cy)), 4)"
_FIT = f"CASE WHEN o.t = b.t THEN -1 WHEN {_IOU} >= {tracks.LEAST_IOU}::DOUBLE THEN 1 + {_IOU} WHEN abs(b.cy - o.cy) <= {tracks.MOST_DISTANCE}::DOUBLE AND {_FAR} <= {tracks.MOST_DISTANCE * 1.6!r}::DOUBLE THEN 0.5 + greatest(0, 1 - {_FAR}) ELSE -1 END"
#: Every box of a clip in turn meets the last boxes of its tracks.
_TRACKED = f"""WITH RECURSIVE lines AS ({LINES.format(regions='regions', sampled='sampled')}),
sized AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY round_even(t, 3), x1, y1, x2, y2, area, cx, cy, text) AS n, {{'t': round_even(t, 3), 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'area': area, 'cx': cx, 'cy': cy, 'text': text}} AS b FROM (
  SELECT *, round_even(round_even(greatest(0, x2 - x1), 4) * round_even(greatest(0, y2 - y1), 4), 5) AS area, round_even((x1 + x2) / 2, 4) AS cx, round_even((y1 + y2) / 2, 4) AS cy FROM lines WHERE confidence >= {tracks.LEAST_CONFIDENCE}::DOUBLE)),
walk AS (SELECT clip_id, n, [b] AS last, 1::BIGINT AS k, b FROM sized WHERE n = 1
  UNION ALL SELECT clip_id, n, CASE WHEN k > len(last) THEN list_append(last, b) ELSE list_transform(last, lambda o, i: CASE WHEN i = k THEN b ELSE o END) END, k, b FROM (
    SELECT s.clip_id, s.n, w.last, s.b, CASE WHEN list_max(fits) > 0 THEN list_position(fits, list_max(fits)) ELSE len(w.last) + 1 END AS k
    FROM walk w JOIN (SELECT * FROM sized) s ON s.clip_id = w.clip_id AND s.n = w.n + 1, LATERAL (SELECT list_transform(w.last, lambda o: ({_FIT.replace('b.', 's.b.')})::DOUBLE) AS fits) x)),
tracked AS (SELECT clip_id, b.t AS t, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2, b.cx AS cx, b.cy AS cy, b.text AS text, k - 1 AS track FROM walk)"""
_SPANS = f"""sp AS (SELECT clip_id, track, string_agg(printf('%.2f-%.2f', greatest(0, a - {tracks.PADDING}), z + {tracks.PADDING}), ' ' ORDER BY a) AS intervals FROM (
  SELECT clip_id, track, run, min(t) AS a, max(t) AS z FROM (SELECT *, sum(o) OVER (PARTITION BY clip_id, track ORDER BY t) AS run FROM (
    SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY clip_id, track ORDER BY t) <= {tracks.GAP}::DOUBLE THEN 0 ELSE 1 END AS o FROM (SELECT DISTINCT clip_id, track, t FROM tracked))) GROUP BY 1, 2, 3) GROUP BY 1, 2),
tx AS (SELECT clip_id, track, string_agg(text, '|' ORDER BY o) AS texts FROM (SELECT clip_id, track, trim(text) AS text, min((t, x1, y1)) AS o, row_number() OVER (PARTITION BY clip_id, track ORDER BY min((t, x1, y1))) AS r FROM tracked GROUP BY 1, 2, 3) WHERE r <= {tracks.TEXTS} GROUP BY 1, 2)"""
_MEDIANS = ", ".join(f"median({c}) AS m_{c}" for c in ("x1", "y1", "x2", "y2"))
_TRACK_STATS = f"""{_TRACKED}, {_SPANS},
m AS (SELECT clip_id, track, count(DISTINCT t) AS sample_count, min(t) AS first_seen, max(t) AS last_seen, {_MEDIANS}, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, list({{'cx': cx, 'cy': cy}}) AS centres FROM tracked GROUP BY 1, 2),
st AS (SELECT *, round_even(least(1, sample_count / 4.0::DOUBLE), 4) AS persistence, round_even(list_max(list_transform(centres, lambda p: abs(p.cy - (m_y1 + m_y2) / 2))), 5) AS vertical_jitter,
  round_even(list_max(list_transform(centres, lambda p: sqrt((p.cx - (m_x1 + m_x2) / 2) * (p.cx - (m_x1 + m_x2) / 2) + (p.cy - (m_y1 + m_y2) / 2) * (p.cy - (m_y1 + m_y2) / 2)))), 5) AS center_jitter,
  round_even(greatest(0, greatest(0, (x2 - x1) * (y2 - y1)) / greatest(1e-9, (m_x2 - m_x1) * (m_y2 - m_y1)) - 1), 4) AS growth, round_even(greatest(1e-9, (m_x2 - m_x1) * (m_y2 - m_y1)), 5) AS median_area, round_even(greatest(0, (x2 - x1) * (y2 - y1)), 5) AS union_area FROM m),
ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY persistence DESC, union_area DESC, track) AS place FROM st),
steady AS (SELECT * FROM ranked WHERE sample_count >= 2 AND persistence >= {tracks.STABLE['persistence']}::DOUBLE AND (persistence >= 0.9::DOUBLE OR last_seen - first_seen >= {tracks.STABLE['seconds']}::DOUBLE) AND vertical_jitter <= {tracks.STABLE['jitter']}::DOUBLE
  AND growth <= {tracks.STABLE['growth']}::DOUBLE AND median_area <= {tracks.STABLE['area']}::DOUBLE AND union_area <= {tracks.STABLE['union_area']}::DOUBLE)"""
_STAT_SQL = _TRACK_STATS + """ SELECT clip_id, track, CAST(sample_count AS INT) AS sample_count, persistence, first_seen, last_seen, round_even(m_x1, 5) AS median_x1, round_even(m_y1, 5) AS median_y1, round_even(m_x2, 5) AS median_x2, round_even(m_y2, 5) AS median_y2,
  round_even(x1, 5) AS x1, round_even(y1, 5) AS y1, round_even(x2, 5) AS x2, round_even(y2, 5) AS y2, vertical_jitter, center_jitter, growth, median_area, union_area, intervals, texts, CAST(place AS INT) AS place FROM ranked JOIN sp USING (clip_id, track) JOIN tx USING (clip_id, track)"""
_INSIDE = "round_even(greatest(0, least({0}, 1)), 5)".format
_MX, _MY = (f"greatest({tracks.MASK['margin']}::DOUBLE, {tracks.MASK['pixels']}::DOUBLE / {c})" for c in ("width", "height"))
_MASKED = f"""{_TRACK_STATS}, sizes AS ({SIZES.format(sampled='sampled')}),
wide AS (SELECT s.clip_id, track, place, persistence, {_INSIDE(f'round_even(x1, 5) - {_MX}')} AS x1, {_INSIDE(f'round_even(y1, 5) - {_MY}')} AS y1, {_INSIDE(f'round_even(x2, 5) + {_MX}')} AS x2, {_INSIDE(f'round_even(y2, 5) + {_MY}')} AS y2 FROM steady s JOIN sizes USING (clip_id)),
fit AS (SELECT *, round_even(w * h, 5) AS area FROM (SELECT *, round_even(x2 - x1, 5) AS w, round_even(y2 - y1, 5) AS h FROM wide) WHERE w > 0 AND h > 0 AND w <= {tracks.MASK['width']}::DOUBLE AND h <= {tracks.MASK['height']}::DOUBLE AND round_even(w * h, 5) <= {tracks.MASK['area']}::DOUBLE),
top AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY area DESC, place) AS r FROM fit QUALIFY r <= {tracks.MASK['count']}),
why AS (SELECT clip_id, CASE WHEN clip_id NOT IN (SELECT clip_id FROM steady) THEN 'no_stable_subtitle_track' WHEN total IS NULL THEN 'mask_geometry_guard' WHEN round_even(total, 5) > {tracks.MASK['total']}::DOUBLE THEN 'mask_total_area_guard' END AS reason
  FROM sizes LEFT JOIN (SELECT clip_id, sum(area) AS total FROM top GROUP BY 1) USING (clip_id))
SELECT clip_id, track, x1, y1, x2, y2, area, persistence, reason FROM why LEFT JOIN (SELECT * FROM top WHERE clip_id IN (SELECT clip_id FROM why WHERE reason IS NULL)) t USING (clip_id)"""


def _ranges(spark, sf_dir):
    c = table(spark, sf_dir, "clips")
    start = F.col("clip_id") % 3 * 20.0 + F.col("overall") - 1
    return c.select(F.col("source_id").alias("video_id"), start.alias("start"), (start + F.col("duration") * 2).alias("end"), (F.col("clip_id") % 7 != 0).alias("usable"))


def _cuts(spark, sf_dir):
    """Boundaries of every second video."""
    c = table(spark, sf_dir, "clips").filter("source_id % 2 = 0")
    return c.select(F.col("source_id").alias("video_id"), F.explode(F.array(F.col("clip_id") % 3 * 20.0 + 14.5, F.col("clip_id") % 3 * 20.0 + F.col("visual") * 30)).alias("t"))


def _split(spark, sf_dir):
    held = _cuts(spark, sf_dir).groupBy("video_id").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    rows = _ranges(spark, sf_dir).join(held, "video_id", "left").withColumn("ts", F.coalesce("ts", F.expr("cast(array() as array<double>)")))
    return segments.clamp(segments.split_long(rows))


def _normalized(spark, sf_dir):
    durations = table(spark, sf_dir, "clips").select(F.col("source_id").alias("video_id"), (F.col("source_id") % 70).cast("double").alias("duration")).distinct()
    return segments.normalized(_ranges(spark, sf_dir), durations, _cuts(spark, sf_dir))


_RANGES_SQL = "rg AS (SELECT row_number() OVER () AS id, source_id AS video_id, clip_id % 3 * 20.0::DOUBLE + overall - 1 AS a, clip_id % 3 * 20.0::DOUBLE + overall - 1 + duration * 2 AS e, clip_id % 7 <> 0 AS usable FROM clips)"
_CUTS_SQL = "ts AS (SELECT video_id, list_sort(list(DISTINCT t)) AS ts FROM (SELECT source_id AS video_id, unnest([clip_id % 3 * 20.0::DOUBLE + 14.5, clip_id % 3 * 20.0::DOUBLE + visual * 30]) AS t FROM clips WHERE source_id % 2 = 0) GROUP BY 1)"


def _walked(ranges: str) -> str:
    """SQL that cuts the rows of ``ranges`` (id, video_id, a, e, ts) one cut after another; ``pieces`` holds the parts of 3 seconds at least."""
    near = "list_sort(list_transform(list_filter(ts, lambda t: abs(t - (pos + 15)) <= 1.5::DOUBLE), lambda t: {'d': abs(t - (pos + 15)), 't': t}))[1].t"
    return f"""walk AS (SELECT id, video_id, a, e, ts, a AS pos, []::DOUBLE[] AS cuts, false AS done FROM {ranges}
  UNION ALL SELECT id, video_id, a, e, ts, CASE WHEN stop THEN pos ELSE cut END, CASE WHEN stop THEN cuts ELSE list_append(cuts, cut) END, stop FROM (
    SELECT *, e - pos <= 15.01::DOUBLE OR e - cut < 3 AS stop FROM (SELECT * EXCLUDE (found), CASE WHEN found - pos < 3 OR found >= e THEN least(pos + 15, e) ELSE found END AS cut FROM (SELECT *, COALESCE(nullif({near}, 0), pos + 15) AS found FROM walk WHERE NOT done)))),
marks AS (SELECT id, video_id, a, e, len(cuts) AS n, list_concat([a], CASE WHEN len(cuts) > 0 AND e - cuts[-1] < 3 THEN cuts[:-2] ELSE cuts END, [e]) AS m FROM walk WHERE done),
pieces AS (SELECT video_id, x, y FROM (SELECT video_id, CASE WHEN n = 0 THEN a ELSE round_even(m[i], 3) END AS x, CASE WHEN n = 0 THEN e ELSE round_even(m[i + 1], 3) END AS y FROM marks, LATERAL (SELECT unnest(range(1, len(m))) AS i) q) WHERE y - x >= 3)"""


_SPLIT_SQL = f"""WITH RECURSIVE {_RANGES_SQL}, {_CUTS_SQL}, held AS (SELECT id, rg.video_id, a, e, COALESCE(ts, []) AS ts FROM rg LEFT JOIN ts USING (video_id)), {_walked('held')}
SELECT video_id, x AS start, least(y, x + 15) AS "end" FROM pieces"""
#: Pieces of a video in turn: one stays if it begins no more than half a second before the end of the last that stayed.
_NORMAL_SQL = f"""WITH RECURSIVE {_RANGES_SQL}, {_CUTS_SQL}, ds AS (SELECT DISTINCT source_id AS video_id, (source_id % 70)::DOUBLE AS d FROM clips),
held AS (SELECT id, video_id, a, e, COALESCE(ts, []) AS ts FROM (SELECT id, rg.video_id, greatest(0, least(a, d)) AS a, greatest(0, least(e, d)) AS e FROM rg JOIN ds USING (video_id) WHERE usable AND d > 0) c LEFT JOIN ts USING (video_id) WHERE e - a >= 3),
{_walked('held')}, placed AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY x, y) AS r FROM pieces),
kept AS (SELECT video_id, r, x, y, true AS stays, y AS until FROM placed WHERE r = 1
  UNION ALL SELECT p.video_id, p.r, p.x, p.y, p.x >= k.until - 0.5::DOUBLE, CASE WHEN p.x >= k.until - 0.5::DOUBLE THEN p.y ELSE k.until END FROM kept k JOIN placed p ON p.video_id = k.video_id AND p.r = k.r + 1)
SELECT video_id, x AS start, y AS "end" FROM kept WHERE stays QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY r) <= 12"""

QUERIES = {
    "region_geometry": (lambda s, d: geometry.geometry(table(s, d, "regions")).select("clip_id", "frame", "area", "center_x", "center_y", "zone", "watermark"), f"WITH {GEO} SELECT clip_id, frame, area, center_x, center_y, zone, watermark FROM geo"),
    "frame_metrics": (lambda s, d: _frames(s, d).select(*_FRAME), f"WITH {GEO} SELECT {', '.join(_FRAME)} FROM fr"),
    "temporal_metrics": (lambda s, d: _metrics(s, d).select(*_TIME), f"WITH {GEO} SELECT {', '.join(_TIME)} FROM tm"),
    "classify_subtitles": (lambda s, d: _classified(s, d).select("clip_id", "subtitle_class"), f"WITH {GEO} SELECT clip_id, subtitle_class FROM cl"),
    "cleanliness": (lambda s, d: segments.cleanliness(_classified(s, d)).select("clip_id", "cleanliness"), f"WITH {GEO} {_CLEAN}"),
    "region_tracks": (lambda s, d: _tracks(s, d).select("clip_id", "t", "x1", "y1", "x2", "y2", "track"), _TRACKED + " SELECT clip_id, t, x1, y1, x2, y2, track FROM tracked"),
    "track_stats": (lambda s, d: _shown(_stats(s, d)).drop("total"), _STAT_SQL),
    "stable_tracks": (lambda s, d: tracks.stable(_stats(s, d)).select("clip_id", "track", "persistence", "vertical_jitter", "growth"), _TRACK_STATS + " SELECT clip_id, track, persistence, vertical_jitter, growth FROM steady"),
    "plan_masks": (_masks, _MASKED),
    "split_segments": (_split, _SPLIT_SQL),
    "normalize_segments": (_normalized, _NORMAL_SQL),
}
