"""The registered queries over the driver's tables and their SQL twins.

``QUERIES`` holds, for each key, the Spark query and the DuckDB SQL over the adapted tables
(``cliploom.sources.adapters``); both carry the same column names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import coverage, duplicates, geometry, library, ranking, search, tables, usage
from ..sources.adapters import REVIEWS, STAGES
from ..sources.adapters import library as table
from ..sources.adapters import oracle
from . import acquiring, boxes, decisions, gapping, intake, objectives, records, rules, selection, upkeep

#: The moment that ages are measured from, and the days after which a query counts as untried.
AS_OF_YIELDS, EXPIRY_YIELDS = "1999-12-01 00:00:00", 900
#: Queries whose rows stand for old ones without counts.
_UNCOUNTED = ("q5", "q10", "q20", "q55")

_CAT = "CASE WHEN trim(category) = '' THEN '(legacy)' ELSE category END"
_AVG = ", ".join(f"round_even(avg({c}), 3) AS avg_{c}" for c in coverage.AVERAGED)
_STAGES = ", ".join(f"('{s}')" for s in STAGES)

_KEY = "substr(sha256(category || '|' || regexp_extract(description, 'of (.*) no', 1) || '|' || printf('%.1f', floor(duration))), 1, 16)"


def _ratio(a: str, b: str, digits: int = 3) -> str:
    return f"CASE WHEN {b} > 0 THEN round_even(CAST({a} AS DOUBLE) / {b}, {digits}) END"


_STAGE_SQL = f"""
WITH counts AS (SELECT {_CAT} AS category, CASE WHEN trim(stage) = '' THEN 'other' ELSE stage END AS stage, count(*) AS total,
  count(*) FILTER (WHERE review_status = 'approved') AS approved FROM clips GROUP BY 1, 2),
known(stage) AS (VALUES {_STAGES}),
grid AS (SELECT c.category, k.stage FROM (SELECT DISTINCT category FROM counts) c, known k),
stages AS (SELECT g.category, g.stage, COALESCE(total, 0) AS total, COALESCE(approved, 0) AS approved FROM grid g LEFT JOIN counts c ON g.category = c.category AND g.stage = c.stage),
full_stages AS (SELECT category, stage, total AS count, total, approved, 400 AS target, greatest(400 - total, 0) AS missing, {_ratio('total', '400')} AS ratio,
  CASE WHEN total = 0 THEN 'critical' WHEN total / 400.0 < 0.5 THEN 'high' WHEN total / 400.0 < 1 THEN 'medium' ELSE 'healthy' END AS priority FROM stages)
"""
_YIELD = "SELECT query, count(*) AS runs, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(uniques) AS BIGINT) AS uniques, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(downloads) AS BIGINT) AS downloads, CAST(sum(clips) AS BIGINT) AS clips FROM yields GROUP BY query"
_BRIDGE = "SELECT source_id, status, reject_reason, unnest(string_split(matched, '|')) AS query FROM sources"
_COST = """SELECT CASE WHEN len(string_split(matched, '|')) = 1 THEN matched ELSE '(unattributed)' END AS query, CAST(sum(calls) AS BIGINT) AS calls,
  CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS sources FROM
  (SELECT source_id, count(*) AS calls, sum(prompt_tokens + completion_tokens) AS tokens FROM ai_runs GROUP BY source_id) r LEFT JOIN sources USING (source_id) GROUP BY 1"""
_APPROVED = f"""SELECT query, CAST(sum(clips) AS BIGINT) AS clips, CAST(sum(approved) AS BIGINT) AS approved FROM ({_BRIDGE}) JOIN
  (SELECT source_id, count(*) AS clips, count(*) FILTER (WHERE review_status = 'approved') AS approved FROM clips GROUP BY source_id) USING (source_id) GROUP BY query"""
_REJECTED = f"""SELECT query, count(*) AS seen, count(*) FILTER (WHERE status = 'rejected_preview') AS preview_rejected,
  count(*) FILTER (WHERE status = 'rejected_preview' AND reject_reason LIKE 'subtitle%') AS subtitle_rejected,
  round_even(count(*) FILTER (WHERE status = 'rejected_preview' AND reject_reason LIKE 'subtitle%')::DOUBLE / count(*), 3) AS subtitle_rejection_rate FROM ({_BRIDGE}) GROUP BY query"""
_STATS = f"""
WITH y AS ({_YIELD}), a AS ({_APPROVED}), r AS ({_REJECTED}), c AS ({_COST}),
stats AS (SELECT query, COALESCE(y.runs, 0) AS runs, COALESCE(y.candidates, 0) AS candidates, COALESCE(y.uniques, 0) AS uniques, COALESCE(y.accepted, 0) AS accepted,
  COALESCE(y.downloads, 0) AS downloads, COALESCE(y.clips, 0) AS clips, COALESCE(a.approved, 0) AS approved, COALESCE(c.tokens, 0) AS tokens, r.subtitle_rejection_rate,
  CASE WHEN COALESCE(c.tokens, 0) > 0 AND COALESCE(y.clips, 0) > 0 THEN c.tokens::DOUBLE / y.clips END AS tokens_per_clip
  FROM y FULL JOIN a USING (query) FULL JOIN r USING (query) FULL JOIN (SELECT query, tokens FROM c WHERE query <> '(unattributed)') c USING (query)),
s1 AS (SELECT *, CASE WHEN candidates > 0 THEN clips::DOUBLE / candidates ELSE 0 END AS conv, least(greatest(uniques, 0), candidates)::DOUBLE AS u,
  CASE WHEN candidates > 0 THEN least(greatest(uniques, 0), candidates)::DOUBLE / candidates ELSE 0 END AS fresh,
  COALESCE(subtitle_rejection_rate, 0) AS sub, least(1.0, COALESCE(tokens_per_clip, 0) / 60000.0::DOUBLE) AS spent FROM stats),
scored AS (SELECT *, round_even(3.0::DOUBLE * clips + accepted + 2.0::DOUBLE * conv + 0.5::DOUBLE * approved - 2.5::DOUBLE * sub - 1.5::DOUBLE * CASE WHEN candidates > 0 THEN 1 - fresh ELSE 0 END - 1.5::DOUBLE * spent, 3) AS score_v1,
  round_even(((3.0::DOUBLE * ln(1 + clips) + 2.0::DOUBLE * conv) * fresh + 0.6::DOUBLE * ln(1 + approved) - 2.5::DOUBLE * sub - 1.5::DOUBLE * spent
   - 3.0::DOUBLE * CASE WHEN clips = 0 AND tokens > 0 THEN least(1.0, ln(1 + tokens) / ln(60001.0::DOUBLE)) ELSE 0 END
   - CASE WHEN clips = 0 AND candidates >= 5 THEN 1.0 ELSE 0 END) * u / (u + 5.0::DOUBLE), 3) AS score_v2 FROM s1)
"""
_USE = """count(*) AS calls, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS failed,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round_even(avg(latency_ms), 3) AS avg_latency_ms"""
_SOURCE_CLIPS = "(SELECT source_id, count(*) AS clips, count(*) FILTER (WHERE review_status = 'approved') AS approved, sum(overall) AS s FROM clips GROUP BY source_id)"
_BITS = "bit_count(xor(('0x' || substr({0}, 1, 8))::BIGINT, ('0x' || substr({1}, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr({0}, 9, 8))::BIGINT, ('0x' || substr({1}, 9, 8))::BIGINT))"
_REVIEW_NAMES = [s for s in REVIEWS if s]
_REVIEW_SQL = "WITH r AS (SELECT CASE WHEN review_status = '' THEN 'unreviewed' ELSE review_status END AS s, favorite FROM clips) " + " UNION ALL ".join(
    [f"SELECT '{s}' AS status, count(*) FILTER (WHERE s = '{s}') AS n FROM r" for s in _REVIEW_NAMES] + ["SELECT 'favorite' AS status, count(*) FILTER (WHERE favorite) AS n FROM r", "SELECT 'total' AS status, count(*) AS n FROM r"]
)

Query = tuple[Callable[[SparkSession, str], DataFrame], str]


def _on(*names: str):
    """A query over adapted tables: the decorated function gets them as DataFrames."""

    def wrap(f):
        return lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names])

    return wrap


def _statistics(y, s, c, r):
    return ranking.statistics(y, s, c, r)


_ALL = ("yields", "sources", "clips", "ai_runs")
_STAT_COLUMNS = "query, runs, candidates, uniques, accepted, downloads, clips, approved, tokens, subtitle_rejection_rate"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits: customers' keys as candidates, half of them beyond the stored sources."""
    read = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = (F.col("event_id") * 3).alias("source_id")
    return read.select(F.col("event_id").alias("hit_id"), source, F.concat(F.lit("https://v.example.com/video/"), (F.lit(100000000000) + F.col("event_id") * 3).cast("string")).alias("url"))


def _novelty(spark, sf_dir):
    rows = table(spark, sf_dir, "yields").withColumn("known", F.when(F.col("query").isin(*_UNCOUNTED), 0).otherwise(F.col("known")))
    return ranking.novelty(rows, table(spark, sf_dir, "sources"), table(spark, sf_dir, "clips"), F.lit(AS_OF_YIELDS).cast("timestamp"), expiry=EXPIRY_YIELDS)


def _urls(spark, sf_dir):
    return library.seen_urls(_hits(spark, sf_dir), table(spark, sf_dir, "sources")).select("hit_id", "url")


def _texts(function):
    def query(spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return docs.select("doc_id", function(F.col("text")).alias("result"))

    return query


def _keyed(clips):
    """Clips with the content key of their category, kind of event and whole seconds."""
    key = duplicates.content_key(F.col("category"), F.regexp_extract("description", "of (.*) no", 1), F.floor("duration").cast("double"))
    return clips.select("clip_id", key.alias("key"))


_SEARCHED = "SELECT clip_id, description, shot AS scene, url AS title, author FROM {clips} c LEFT JOIN {sources} s ON c.source_id = s.source_id"
_SEARCHES = ("CLICK no 1_", "Author4", "video/1000000001", "ro", "close_up", "no match at all")


def _free_text(spark, sf_dir):
    rows = spark.sql(_SEARCHED, clips=table(spark, sf_dir, "clips"), sources=table(spark, sf_dir, "sources"))
    columns = ["description", "scene", "title", "author"]
    index = search.text_index(rows, columns, tables.saver(spark, "texts"))
    found = [search.free_text(rows, index, columns, text).select(F.lit(text).alias("text"), "clip_id") for text in _SEARCHES]
    return reduce(DataFrame.union, found)


def _pages(spark, sf_dir):
    """The fourth page from the end by score, and the last one by length, asked for beyond the end."""
    clips = table(spark, sf_dir, "clips")
    last = (clips.count() - 1) // 50
    deep = search.page(clips, "overall", 50, last - 3).select(F.lit("deep").alias("page"), "clip_id", F.col("overall").alias("value"))
    return deep.union(search.page(clips, "duration", 50, last + 7, descending=False).select(F.lit("last"), "clip_id", "duration"))


def _phash(clips):
    return duplicates.by_phash(clips.filter("clip_id % 4 = 0"), clips.filter("clip_id % 4 <> 0"))


def _sha(clips):
    return duplicates.by_sha(clips.filter("clip_id % 4 = 0"), clips.filter("clip_id % 4 <> 0"))


QUERIES: dict[str, Query] = {
    "coverage_summary": (_on("clips")(coverage.summary), f"SELECT {_CAT} AS category, count(*) AS total, count(*) FILTER (WHERE provenance = 'remote') AS real, count(*) FILTER (WHERE review_status = 'approved') AS approved, count(*) FILTER (WHERE favorite) AS favorites, {_AVG} FROM clips GROUP BY 1"),
    "coverage_stage": (_on("clips")(lambda c: coverage.stages(c, 400)), _STAGE_SQL + "SELECT * FROM full_stages"),
    "gap_ranking": (_on("clips")(lambda c: coverage.gaps(c, 400)), _STAGE_SQL + "SELECT category, stage, total, missing, priority, CAST(CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END AS INT) AS priority_order FROM full_stages WHERE missing > 0"),
    "coverage_shot": (_on("clips")(lambda c: coverage.dimension(c, "shot")), f"SELECT {_CAT} AS category, CASE WHEN shot = '' THEN 'unknown' ELSE shot END AS shot, count(*) AS n FROM clips GROUP BY 1, 2"),
    "coverage_state": (_on("clips")(lambda c: coverage.dimension(c, "state")), f"SELECT {_CAT} AS category, CASE WHEN state = '' THEN 'unknown' ELSE state END AS state, count(*) AS n FROM clips GROUP BY 1, 2"),
    "coverage_edit_role": (_on("clips")(coverage.edit_roles), f"SELECT category, role, count(*) AS n FROM (SELECT {_CAT} AS category, clip_id, unnest(list_distinct(string_split(roles, ','))) AS role FROM clips) GROUP BY 1, 2"),
    "quality_distribution": (_on("clips")(coverage.quality), f"SELECT {_CAT} AS category, count(*) FILTER (WHERE overall >= 0.9::DOUBLE) AS band_90, count(*) FILTER (WHERE overall >= 0.8::DOUBLE AND overall < 0.9::DOUBLE) AS band_80, count(*) FILTER (WHERE overall >= 0.7::DOUBLE AND overall < 0.8::DOUBLE) AS band_70, count(*) FILTER (WHERE overall < 0.7::DOUBLE) AS band_low FROM clips GROUP BY 1"),
    "review_counts": (_on("clips")(coverage.reviews), _REVIEW_SQL),
    "category_counts": (_on("clips")(lambda c: c.groupBy(coverage.label("category", "(legacy)").alias("category")).agg(F.count("*").alias("n"))), f"SELECT {_CAT} AS category, count(*) AS n FROM clips GROUP BY 1"),
    "search_yield": (_on("yields")(ranking.yields), f"WITH y AS ({_YIELD}) SELECT *, {_ratio('uniques', 'candidates')} AS unique_rate, {_ratio('accepted', 'uniques')} AS accept_rate, {_ratio('clips', 'downloads')} AS download_to_clip_rate, COALESCE({_ratio('clips', 'candidates')}, 0) AS candidate_to_clip_rate FROM y"),
    "query_usefulness": (_on("yields")(ranking.usefulness), f"WITH y AS ({_YIELD}) SELECT query, clips, accepted, round_even(clips * 3.0::DOUBLE + accepted + CASE WHEN candidates > 0 THEN clips::DOUBLE / candidates ELSE 0 END * 2, 3) AS usefulness FROM y"),
    "query_cost": (_on("sources", "ai_runs")(ranking.cost), _COST),
    "query_approved": (_on("clips", "sources")(ranking.approved), _APPROVED),
    "query_subtitle_rejection": (_on("sources")(ranking.subtitle_rejection), _REJECTED),
    "query_rediscovery": (_on("sources")(ranking.rediscovery), f"SELECT query, count(*) AS sources, round_even(avg(CASE WHEN status IN {ranking.PROCESSED} THEN 1.0::DOUBLE ELSE 0 END), 4) AS rediscovery_rate FROM (SELECT DISTINCT source_id, status, query FROM ({_BRIDGE})) GROUP BY query"),
    "query_last_attempt": (_on("yields")(lambda y: y.groupBy("query").agg(F.max("created_at").alias("last_attempt"))), "SELECT query, max(created_at) AS last_attempt FROM yields GROUP BY query"),
    "query_statistics": (_on(*_ALL)(lambda *t: _statistics(*t).drop("tokens_per_clip")), _STATS + f"SELECT {_STAT_COLUMNS} FROM scored"),
    "query_scores": (_on(*_ALL)(lambda *t: ranking.scores(_statistics(*t)).select("query", "score_v1", "score_v2")), _STATS + "SELECT query, score_v1, score_v2 FROM scored"),
    "rank_table": (_on(*_ALL)(lambda *t: ranking.rank_table(_statistics(*t))), _STATS + ", ranked AS (SELECT query, clips, candidates, score_v1, score_v2, row_number() OVER (ORDER BY score_v1 DESC, query) AS rank_v1, row_number() OVER (ORDER BY score_v2 DESC, query) AS rank_v2 FROM scored) SELECT query, clips, candidates, score_v1, score_v2, CAST(rank_v1 AS INT) AS rank_v1, CAST(rank_v2 AS INT) AS rank_v2, CAST(rank_v1 - rank_v2 AS INT) AS rank_delta FROM ranked"),
    "recent_yields": (_on("yields")(lambda y: ranking.recent(y).groupBy("query").agg(F.count("*").alias("n"), F.min("yield_id").alias("oldest"))), "SELECT query, count(*) AS n, min(yield_id) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY yield_id DESC, created_at DESC, candidates DESC) AS place FROM yields) WHERE place <= 500 GROUP BY query"),
    "query_novelty": (_novelty, f"""
WITH stored AS (SELECT query, count(*) AS known_sources, count(*) FILTER (WHERE source_id IN (SELECT source_id FROM clips)) AS represented FROM (SELECT DISTINCT source_id, query FROM ({_BRIDGE})) GROUP BY query),
old_rows AS (SELECT * REPLACE (CASE WHEN query IN {_UNCOUNTED} THEN 0 ELSE known END AS known) FROM yields),
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY yield_id DESC, created_at DESC, candidates DESC) AS place FROM old_rows) WHERE place <= 500),
b AS (SELECT query, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(fresh) AS BIGINT) AS new_to_system, CAST(sum(known) AS BIGINT) AS counted,
 count(*) FILTER (WHERE created_at >= TIMESTAMP '{AS_OF_YIELDS}' - INTERVAL 30 DAY) AS samples,
 count(*) FILTER (WHERE created_at >= TIMESTAMP '{AS_OF_YIELDS}' - INTERVAL 30 DAY AND candidates > 0 AND fresh = 0) AS zero_runs,
 max(CASE WHEN place = 1 THEN created_at END) AS last_attempt FROM recent GROUP BY query),
j AS (SELECT b.*, COALESCE(known_sources, 0) AS known_sources, COALESCE(represented, 0) AS represented, CASE WHEN candidates > 0 AND new_to_system = 0 AND counted = 0 THEN least(candidates, COALESCE(known_sources, 0)) ELSE counted END AS known FROM b LEFT JOIN stored USING (query)),
k AS (SELECT *, CASE WHEN candidates > 0 THEN least(1.0::DOUBLE, known::DOUBLE / candidates) END AS kr, CASE WHEN candidates > 0 THEN least(1.0::DOUBLE, new_to_system::DOUBLE / candidates) END AS nr FROM j),
s AS (SELECT *, CASE WHEN candidates <= 0 THEN 'unknown' WHEN last_attempt < TIMESTAMP '{AS_OF_YIELDS}' - INTERVAL {EXPIRY_YIELDS} DAY THEN 'unknown'
 WHEN ((candidates >= 8 OR samples >= 3) AND COALESCE(kr, 0) >= 0.8::DOUBLE) OR zero_runs >= 3 THEN 'saturated' WHEN new_to_system > 0 AND COALESCE(nr, 0) >= 0.3::DOUBLE THEN 'fresh'
 WHEN COALESCE(kr, 0) >= 0.4::DOUBLE OR (new_to_system > 0 AND COALESCE(kr, 0) > 0) THEN 'mixed' WHEN new_to_system > 0 THEN 'fresh' ELSE 'unknown' END AS saturation FROM k)
SELECT query, candidates, new_to_system, known, known_sources, represented, samples, zero_runs, last_attempt, round_even(kr, 4) AS known_rate, round_even(nr, 4) AS novelty_rate, saturation,
 CASE saturation WHEN 'saturated' THEN 0.3::DOUBLE WHEN 'mixed' THEN 0.7::DOUBLE WHEN 'unknown' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS actionability FROM s"""),
    "source_yield": (_on("sources", "clips")(usage.source_yield), f"SELECT source_id, author, clips, approved, round_even(s / clips, 3) AS avg_overall FROM sources JOIN {_SOURCE_CLIPS} USING (source_id)"),
    "author_yield": (_on("sources", "clips")(usage.author_yield), f"SELECT author, count(*) AS videos, CAST(sum(clips) AS BIGINT) AS clips, CAST(sum(approved) AS BIGINT) AS approved, round_even(sum(s) / sum(clips), 3) AS avg_overall FROM sources JOIN {_SOURCE_CLIPS} USING (source_id) GROUP BY author"),
    "task_performance": (_on("sources", "clips", "ai_runs")(usage.task_performance), f"WITH t AS (SELECT task_id, count(*) AS candidates, CAST(COALESCE(sum(clips), 0) AS BIGINT) AS clips, CAST(COALESCE(sum(calls), 0) AS BIGINT) AS calls, CAST(COALESCE(sum(tokens), 0) AS BIGINT) AS tokens FROM sources LEFT JOIN {_SOURCE_CLIPS} USING (source_id) LEFT JOIN (SELECT source_id, count(*) AS calls, sum(prompt_tokens + completion_tokens) AS tokens FROM ai_runs GROUP BY source_id) USING (source_id) GROUP BY task_id) SELECT *, {_ratio('tokens', 'clips')} AS tokens_per_clip FROM t"),
    "ai_usage": (_on("ai_runs")(usage.by_model), f"SELECT provider, model, {_USE} FROM ai_runs GROUP BY 1, 2"),
    "ai_operation_stats": (_on("ai_runs")(usage.by_operation), f"SELECT operation, {_USE}, round_even(avg(frames), 3) AS avg_frames FROM ai_runs GROUP BY 1"),
    "ai_cost_per_clip": (_on("ai_runs", "clips")(usage.cost_per_clip), f"WITH t AS (SELECT (SELECT count(*) FROM ai_runs WHERE origin = 'pipeline') AS calls, (SELECT CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) FROM ai_runs WHERE origin = 'pipeline') AS tokens, (SELECT count(*) FROM clips) AS clips) SELECT *, {_ratio('tokens', 'clips')} AS tokens_per_clip, {_ratio('calls', 'clips')} AS calls_per_clip FROM t"),
    "latest_per_clip": (_on("ai_runs")(usage.latest_per_source), "SELECT source_id, operation, run_id, prompt_tokens FROM (SELECT *, row_number() OVER (PARTITION BY source_id, operation ORDER BY run_id DESC, prompt_tokens DESC, latency_ms DESC, model) AS place FROM ai_runs) WHERE place = 1"),
    "clip_filter": (_on("clips")(lambda c: library.clip_filter(c, {"provenance": "remote", "favorite": True}, {"subtitle_type": ["none", "bottom_simple"]}, {"overall": (0.2, 0.9)}).select("clip_id", "overall")), "SELECT clip_id, overall FROM clips WHERE provenance = 'remote' AND favorite AND subtitle_type IN ('none', 'bottom_simple') AND overall BETWEEN 0.2::DOUBLE AND 0.9::DOUBLE"),
    "clip_free_text": (_free_text, f"WITH t AS ({_SEARCHED.format(clips='clips', sources='sources')}) SELECT text, clip_id FROM t, (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in _SEARCHES)}) q(text) WHERE description ILIKE '%' || text || '%' OR scene ILIKE '%' || text || '%' OR title ILIKE '%' || text || '%' OR author ILIKE '%' || text || '%'"),
    "clip_page": (_pages, "SELECT 'deep' AS page, clip_id, overall AS value FROM (SELECT clip_id, overall, row_number() OVER (ORDER BY overall DESC, clip_id DESC) AS r, count(*) OVER () AS n FROM clips) WHERE (r - 1) // 50 = (n - 1) // 50 - 3 UNION ALL SELECT 'last', clip_id, duration FROM (SELECT clip_id, duration, row_number() OVER (ORDER BY duration, clip_id DESC) AS r, count(*) OVER () AS n FROM clips) WHERE (r - 1) // 50 = (n - 1) // 50"),
    "clip_by_edit_role": (_on("clips")(lambda c: c.filter(F.array_contains(F.split("roles", ","), "hook")).select("clip_id")), "SELECT clip_id FROM clips WHERE list_contains(string_split(roles, ','), 'hook')"),
    "clip_stats": (_on("clips")(lambda c: c.filter("favorite").agg(F.count("*").alias("n"), F.bround(F.sum("duration"), 2).alias("seconds"))), "SELECT count(*) AS n, round_even(sum(duration), 2) AS seconds FROM clips WHERE favorite"),
    "cleanup_routing": (_on("clips")(library.cleanup_routing), f"SELECT clip_id, CASE WHEN subtitle_type = 'unknown' THEN 'unmeasured' WHEN subtitle_type = 'none' THEN 'not_needed' WHEN subtitle_type IN {library.CLEANABLE} THEN 'eligible' ELSE 'ineligible' END AS route FROM clips"),
    "url_seen": (_urls, "SELECT event_id AS hit_id, concat('https://v.example.com/video/', CAST(100000000000 + event_id * 3 AS VARCHAR)) AS url FROM events WHERE event_id * 3 IN (SELECT source_id FROM sources)"),
    "dup_sha256": (_on("clips")(_sha), "SELECT n.clip_id, min(l.clip_id) AS match_id FROM clips n JOIN clips l ON n.sha = l.sha WHERE n.clip_id % 4 = 0 AND l.clip_id % 4 <> 0 GROUP BY 1"),
    "dup_phash": (_on("clips")(_phash), f"""
WITH new AS (SELECT DISTINCT category, phash FROM clips WHERE clip_id % 4 = 0), lib AS (SELECT category, phash, min(clip_id) AS match_id FROM clips WHERE clip_id % 4 <> 0 GROUP BY 1, 2),
near AS (SELECT n.category, n.phash, match_id, CAST({_BITS.format('n.phash', 'l.phash')} AS INT) AS distance FROM new n JOIN lib l ON n.category = l.category)
SELECT category, phash, min(match_id) AS match_id, arg_min(distance, match_id) AS distance FROM near WHERE distance <= 6 GROUP BY 1, 2"""),
    "dup_cascade": (_on("clips")(lambda c: duplicates.cascade(c.filter("clip_id % 4 = 0"), c.filter("clip_id % 4 <> 0"))), f"""
WITH new AS (SELECT clip_id, category, phash, sha FROM clips WHERE clip_id % 4 = 0), lib AS (SELECT clip_id, category, phash, sha FROM clips WHERE clip_id % 4 <> 0),
exact AS (SELECT n.clip_id, min(l.clip_id) AS match_id FROM new n JOIN lib l ON n.sha = l.sha GROUP BY 1),
hashes AS (SELECT DISTINCT category, phash FROM new), firsts AS (SELECT category, phash, min(clip_id) AS match_id FROM lib GROUP BY 1, 2),
close AS (SELECT h.category, h.phash, match_id, CAST({_BITS.format('h.phash', 'f.phash')} AS INT) AS distance FROM hashes h JOIN firsts f ON h.category = f.category),
near AS (SELECT category, phash, min(match_id) AS match_id, arg_min(distance, match_id) AS distance FROM close WHERE distance <= 6 GROUP BY 1, 2)
SELECT n.clip_id, CASE WHEN e.match_id IS NOT NULL THEN 'sha256' ELSE 'phash' END AS detector, COALESCE(e.match_id, p.match_id) AS match_id, CASE WHEN e.match_id IS NULL THEN p.distance END AS distance
FROM new n LEFT JOIN exact e USING (clip_id) LEFT JOIN near p ON n.category = p.category AND n.phash = p.phash WHERE e.match_id IS NOT NULL OR p.match_id IS NOT NULL"""),
    "similar_clips": (_on("clips")(lambda c: library.similar(_keyed(c), "key", 3)), f"WITH k AS (SELECT clip_id, {_KEY} AS key FROM clips) SELECT clip_id, similar_id FROM (SELECT a.clip_id, b.clip_id AS similar_id, row_number() OVER (PARTITION BY a.clip_id ORDER BY b.clip_id) AS place FROM k a JOIN k b ON a.key = b.key AND a.clip_id <> b.clip_id) WHERE place <= 3"),
    "content_key_groups": (_on("clips")(lambda c: library.key_groups(_keyed(c), "key")), f"SELECT {_KEY} AS key, count(*) AS n, min(clip_id) AS first_id FROM clips GROUP BY 1 HAVING count(*) > 1"),
    "active_intervals": (_on("regions")(lambda r: geometry.intervals(r.select("clip_id", F.col("x1").alias("t")).distinct(), ["clip_id"], "t", 0.05, 0.01).select("clip_id", F.bround("start", 4).alias("start"), F.bround("end", 4).alias("end"))), """
WITH p AS (SELECT DISTINCT clip_id, x1 AS t FROM regions), g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 0.05::DOUBLE OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM p WINDOW w AS (PARTITION BY clip_id ORDER BY t)),
r AS (SELECT *, sum(o) OVER (PARTITION BY clip_id ORDER BY t) AS run FROM g), i AS (SELECT clip_id, run, min(t) - 0.01::DOUBLE AS s, max(t) + 0.01::DOUBLE AS e FROM r GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN s > max(e) OVER v OR max(e) OVER v IS NULL THEN 1 ELSE 0 END AS o FROM i WINDOW v AS (PARTITION BY clip_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, sum(o) OVER (PARTITION BY clip_id ORDER BY s) AS island FROM m)
SELECT clip_id, round_even(greatest(min(s), 0), 4) AS "start", round_even(max(e), 4) AS "end" FROM n GROUP BY clip_id, island"""),
    "redact_digits": (_texts(text.redact_digits), "SELECT doc_id, regexp_replace(text, '[0-9]{7,}', '<num>', 'g') AS result FROM documents"),
    "sanitize_error": (_texts(text.sanitize_error), """SELECT doc_id, CASE WHEN length(r) > 600 THEN substr(r, 1, 597) || '...' ELSE r END AS result FROM (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(COALESCE(text, ''), '(?i)\\b(bearer)\\s+[A-Za-z0-9._-]+', 'Bearer <redacted>', 'g'), '\\bsk-[A-Za-z0-9._-]{6,}', 'sk-<redacted>', 'g'),
    '(?i)\\b(api[-_]?key|authorization|token|secret|password|cookie)\\b\\s*[:=]\\s*["'']?([^\\s"'',;)]+)', '\\1=<redacted>', 'g') AS r FROM documents)"""),
}

QUERIES["production_gaps"] = (
    lambda s, d: gapping.query(s, d, _statistics(*[table(s, d, n) for n in _ALL]), _novelty(s, d)),
    gapping.sql(_STATS + "SELECT * FROM scored", *[QUERIES[name][1] for name in ("query_novelty", "query_rediscovery")]),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in {**QUERIES, **intake.QUERIES, **upkeep.QUERIES, **objectives.QUERIES, **rules.QUERIES, **boxes.QUERIES, **decisions.QUERIES, **records.QUERIES, **selection.QUERIES, **acquiring.QUERIES}.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, (_, sql) in {**QUERIES, **intake.QUERIES, **upkeep.QUERIES, **objectives.QUERIES, **rules.QUERIES, **boxes.QUERIES, **decisions.QUERIES, **records.QUERIES, **selection.QUERIES, **acquiring.QUERIES}.items() if sql}
