"""Registered queries of rule cascades and table rewrites with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..sources.adapters import library as table


def _tags(clips):
    return clips.select("clip_id", F.explode(F.array_distinct(F.split("roles", ","))).alias("tag"))


_TAG_SQL = "t AS (SELECT clip_id, unnest(list_distinct(string_split(roles, ','))) AS tag FROM clips)"


def _retagged(spark, sf_dir):
    c = table(spark, sf_dir, "clips")
    return rules.retagged(_tags(c), c.filter("clip_id % 3 = 0").select("clip_id", F.lit("new").alias("tag")))


def _removed(spark, sf_dir):
    c = table(spark, sf_dir, "clips")
    return rules.removed(_tags(c), c.filter("clip_id % 4 <> 0"))


def _linked(spark, sf_dir):
    r = table(spark, sf_dir, "ai_runs").select("run_id", "source_id", F.when(F.col("run_id") % 2 == 0, F.col("run_id")).alias("clip_id"))
    return rules.linked(r, table(spark, sf_dir, "clips"))


def _misses(spark, sf_dir):
    c = table(spark, sf_dir, "clips")
    return rules.cache_misses(c.select("clip_id", F.col("sha").alias("cache_key")), c.filter("clip_id % 50 = 7").select(F.col("sha").alias("cache_key"))).select("clip_id", "cache_key")


def _effect(spark, sf_dir):
    y = table(spark, sf_dir, "yields")
    return rules.effectiveness(y.select((F.col("task_id") % 50).alias("plan_id"), "clips", F.least("clips", F.col("accepted") % 3).alias("qualifying"), "downloads", (F.col("candidates") * 100).alias("tokens")))


def _titles(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", rules.unrelated_title(F.col("p_name"), F.get(F.array(F.lit("ring"), F.lit("qz"), F.lit("xy")), (F.col("p_partkey") % 3).cast("int")), ["red", "small", "blue"]).alias("unrelated"))


QUERIES = {
    "title_irrelevant": (_titles, "WITH m AS (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'qz' ELSE 'xy' END AS material FROM part) SELECT p_partkey, (contains(p_name, 'red') OR contains(p_name, 'small') OR contains(p_name, 'blue')) AND NOT list_bool_or(list_transform(string_split(material, ''), lambda c: contains(p_name, c))) AS unrelated FROM m"),
    "retag_clips": (_retagged, f"WITH {_TAG_SQL} SELECT clip_id, tag FROM t WHERE clip_id % 3 <> 0 UNION ALL SELECT clip_id, 'new' FROM clips WHERE clip_id % 3 = 0"),
    "remove_clips": (_removed, f"WITH {_TAG_SQL} SELECT clip_id, tag FROM t WHERE clip_id % 4 <> 0"),
    "link_runs": (_linked, "WITH f AS (SELECT source_id, min(clip_id) AS c FROM clips GROUP BY 1) SELECT run_id, source_id, CASE WHEN run_id % 2 = 0 THEN run_id ELSE c END AS clip_id FROM ai_runs LEFT JOIN f USING (source_id)"),
    "cache_misses": (_misses, "SELECT clip_id, sha AS cache_key FROM clips WHERE sha NOT IN (SELECT sha FROM clips WHERE clip_id % 50 = 7)"),
    "task_history": (lambda s, d: rules.task_history(table(s, d, "sources"), table(s, d, "clips")), "WITH m AS (SELECT source_id, count(*) AS n, list(DISTINCT category) AS c FROM clips GROUP BY 1) SELECT task_id, count(*) AS sources, CAST(COALESCE(sum(n), 0) AS BIGINT) AS clips, COALESCE(array_to_string(list_sort(list_distinct(flatten(list(c) FILTER (WHERE c IS NOT NULL)))), '|'), '') AS categories FROM sources LEFT JOIN m USING (source_id) GROUP BY 1"),
    "plan_effectiveness": (_effect, "WITH p AS (SELECT task_id % 50 AS plan_id, CAST(sum(clips) AS BIGINT) AS clips, CAST(sum(least(clips, accepted % 3)) AS BIGINT) AS qualifying, sum(downloads) AS d, sum(candidates * 100) AS t FROM yields GROUP BY 1) SELECT plan_id, clips, qualifying, CASE WHEN clips > 0 THEN round_even(qualifying::DOUBLE / clips, 3) END AS hit_rate, clips - qualifying AS off_target, CASE WHEN qualifying > 0 THEN round_even(t::DOUBLE / qualifying, 3) END AS tokens_per_clip, CASE WHEN qualifying > 0 THEN round_even(d::DOUBLE / qualifying, 3) END AS downloads_per_clip FROM p"),
}
