"""Registered queries of objectives and plans with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, duplicates, objectives
from ..sources.adapters import STAGES
from ..sources.adapters import library as table
from .decisions import FAMILY_SQL as _FAMILY

_PHRASES = ["heat pump", "inside dryer", "drying equipment", "factory line", "finished product", "drying process", "farm"]
_PHRASE_SQL = "CASE part_no % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " END"


def _queries(spark, sf_dir):
    """Query texts made of part names."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), (F.col("p_partkey") % 7).cast("int"))
    text = F.when(F.col("p_partkey") % 10 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", phrase))
    return part.select(F.col("p_partkey").alias("part_no"), F.col("p_name").alias("material"), text.alias("query"), F.col("p_retailprice").alias("score"), (F.col("p_size") % 5).alias("objective"))


_Q = f"q AS (SELECT p_partkey AS part_no, p_name AS material, CASE WHEN p_partkey % 10 = 0 THEN p_name ELSE p_name || ' ' || {_PHRASE_SQL.replace('part_no', 'p_partkey')} END AS query, p_retailprice AS score, p_size % 5 AS objective FROM part)"
_STAGE_ROWS = ", ".join(f"('{s}')" for s in STAGES)
_COUNTS = f"""c0 AS (SELECT CASE WHEN trim(category) = '' THEN '(legacy)' ELSE category END AS category, CASE WHEN trim(stage) = '' THEN 'other' ELSE stage END AS stage, count(*) AS total FROM clips GROUP BY 1, 2),
c AS (SELECT category, stage, COALESCE(total, 0) AS total FROM (SELECT DISTINCT category FROM c0) x CROSS JOIN (VALUES {_STAGE_ROWS}) s(stage) LEFT JOIN c0 USING (category, stage)),
k AS (SELECT category, stage, 400 - total AS missing FROM c WHERE total < 400)"""


def _tasks(spark, sf_dir):
    return table(spark, sf_dir, "sources").select((F.col("task_id") % 40).alias("plan_id"), "task_id")


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", (F.col("user_id") % 50).alias("plan_id"), F.concat(F.lit("q"), F.col("event_id") % 31).alias("query"))


def _posts(spark, sf_dir):
    return objectives.relevance(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["License", "password", "the"])


def _counts(spark, sf_dir):
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("clips", "sources", "ai_runs", "yields")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _content_keys(spark, sf_dir):
    c = table(spark, sf_dir, "clips")
    return c.select("clip_id", duplicates.content_key(F.col("category"), F.concat(F.lit("  "), F.replace("description", F.lit(" "), F.lit("  "))), F.col("duration")).alias("content_key"))


def _by_key(spark, sf_dir):
    """The second half of the clips against the first, by content key of category, event type and whole seconds."""
    c = table(spark, sf_dir, "clips")
    keyed = c.select("clip_id", duplicates.content_key(F.col("category"), F.regexp_extract("description", "of (.*) no", 1), F.floor("duration").cast("double")).alias("key"))
    return duplicates.by_content_key(keyed.filter("clip_id % 2 = 1"), keyed.filter("clip_id % 2 = 0"))


def _detail(spark, sf_dir):
    c, s = table(spark, sf_dir, "clips"), table(spark, sf_dir, "sources")
    n = c.groupBy("source_id").agg(F.count("*").alias("n_clips"))
    return c.select("clip_id", "source_id").join(s.select("source_id", "author", "url"), "source_id", "left").join(n, "source_id")


QUERIES = {
    "prioritize_queries": (lambda s, d: objectives.prioritized(_queries(s, d).select("material", "query").distinct()).select("material", "query", "place"), f"WITH {_Q} SELECT material, query, CAST(row_number() OVER (PARTITION BY material ORDER BY len(string_split(query, ' ')) - len(string_split(material, ' ')) DESC, length(query) DESC, query) AS INT) AS place FROM (SELECT DISTINCT material, query FROM q)"),
    "family_pick": (
        lambda s, d: objectives.best_per_family(table(s, d, "searches").select(F.col("reference").alias("objective"), "query", "clips")),
        f"SELECT reference AS objective, {_FAMILY} AS family, query, clips FROM searches QUALIFY row_number() OVER (PARTITION BY 1, 2 ORDER BY clips DESC, query) = 1".replace("PARTITION BY 1, 2", f"PARTITION BY reference, {_FAMILY}"),
    ),
    "keyword_relevance": (_posts, "SELECT * FROM (SELECT doc_id, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'password') AS INT) + CAST(contains(lower(text), 'the') AS INT) AS hits FROM documents) WHERE hits > 0"),
    "plan_linkage": (lambda s, d: objectives.linkage(_tasks(s, d), table(s, d, "sources"), table(s, d, "clips")), "WITH m AS (SELECT source_id, count(*) AS n FROM clips GROUP BY 1) SELECT task_id % 40 AS plan_id, count(DISTINCT task_id) AS tasks, count(*) AS sources, CAST(COALESCE(sum(n), 0) AS BIGINT) AS clips FROM sources LEFT JOIN m USING (source_id) GROUP BY 1"),
    "plan_timeline": (lambda s, d: objectives.timeline(_events(s, d)), "WITH e AS (SELECT event_id, user_id % 50 AS plan_id, concat('q', event_id % 31) AS query FROM events) SELECT event_id, plan_id, query, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY event_id) AS INT) AS place, row_number() OVER (PARTITION BY plan_id, query ORDER BY event_id) > 1 AS again FROM e"),
    "funnel_metrics": (lambda s, d: objectives.funnel(*[table(s, d, n) for n in ("yields", "sources", "clips", "ai_runs")]), "SELECT (SELECT CAST(sum(candidates) AS BIGINT) FROM yields) AS candidates, (SELECT CAST(sum(uniques) AS BIGINT) FROM yields) AS uniques, (SELECT CAST(sum(downloads) AS BIGINT) FROM yields) AS downloads, (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM sources WHERE status = 'rejected_preview') AS preview_rejected, (SELECT count(*) FROM clips) AS clips, (SELECT count(*) FROM clips WHERE review_status = 'approved') AS approved, (SELECT count(*) FROM ai_runs) AS calls, (SELECT CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) FROM ai_runs) AS tokens, (SELECT count(*) FROM (SELECT query FROM yields GROUP BY query HAVING sum(clips) = 0)) AS zero_yield_queries"),
    "table_counts": (_counts, "SELECT 'clips' AS name, count(*) AS n FROM clips UNION ALL SELECT 'sources', count(*) FROM sources UNION ALL SELECT 'ai_runs', count(*) FROM ai_runs UNION ALL SELECT 'yields', count(*) FROM yields"),
    "content_key": (_content_keys, "SELECT clip_id, substr(sha256(category || '|' || description || '|' || printf('%.1f', duration)), 1, 16) AS content_key FROM clips"),
    "dup_content_key": (_by_key, "SELECT a.clip_id, min(b.clip_id) AS match_id FROM clips a JOIN clips b ON a.category = b.category AND regexp_extract(a.description, 'of (.*) no', 1) = regexp_extract(b.description, 'of (.*) no', 1) AND floor(a.duration) = floor(b.duration) WHERE a.clip_id % 2 = 1 AND b.clip_id % 2 = 0 GROUP BY 1"),
    "source_detail": (_detail, "SELECT source_id, clip_id, author, url, count(*) OVER (PARTITION BY source_id) AS n_clips FROM clips LEFT JOIN sources USING (source_id)"),
}
