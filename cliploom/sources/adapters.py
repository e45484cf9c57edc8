"""The driver's tables in the shapes of a material library, as SQL that Spark and DuckDB both run.

Every value is plain arithmetic on the keys of the given tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def pick(key: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST({key} AS BIGINT) % {len(values)} {cases} END"


CATEGORIES = ["apple dry", "banana dry", "mango slice", "pepper dry", "mushroom", ""]
STAGES = [
    "raw_material", "preparation", "washing", "cutting", "loading", "tray_arrangement", "before_drying", "drying",
    "inside_dryer", "unloading", "finished_product", "packaging", "equipment", "factory", "other",
]
STATES = ["fresh", "prepared", "semi_dried", "drying", "dried", "finished", ""]
SHOTS = ["wide", "medium", "close_up", "macro", "detail", ""]
REVIEWS = ["unreviewed", "approved", "rejected", "needs_work", ""]
ROLES = ["hook", "intro", "raw_material", "process", "detail", "equipment", "transition", "result", "ending"]
SUBTITLES = [
    "none", "bottom_simple", "top_simple", "single_region", "multi_region", "colored_block", "complex", "unknown",
    "watermark_only", "large_center_text", "promotional_overlay", "dense_text",
]
STATUSES = ["discovered", "rejected_preview", "failed", "downloading", "completed", "analyzed", "no_usable_segment", "duplicate"]
REASONS = ["", "subtitle_too_complex", "low_quality", "duplicate_source", "duration_unresolved", "no_material"]
MATERIALS = ["苹果干", "香蕉", "芒果片", "辣椒干", "香菇", "枸杞", "苹果"]
PHRASES = ["烘干过程", "热泵烘干", "烘干机内部", "", "成品", "车间", "烘干设备", "烘房烘干", "价格"]

#: name -> (tables it reads, SQL)
ADAPTERS: dict[str, tuple[tuple[str, ...], str]] = {
    "clips": (("events",), f"""
        SELECT event_id AS clip_id, CAST(floor(event_id / 3e0) AS BIGINT) AS source_id, event_id % 97 AS task_id,
          {pick('event_id % 1009', CATEGORIES)} AS category, {pick('floor(event_id % 1013 / 2e0)', STAGES)} AS stage,
          {pick('event_id % 1019', STATES)} AS state, {pick('event_id % 1021', SHOTS)} AS shot,
          {pick('event_id % 1031', REVIEWS)} AS review_status, event_id % 11 = 0 AS favorite,
          CASE WHEN event_id % 5 < 3 THEN 'remote' ELSE 'local_test' END AS provenance,
          concat({pick('event_id % 1033', ROLES)}, ',', {pick('floor(event_id % 1039 / 3e0)', ROLES)}) AS roles,
          {pick('event_id % 1049', SUBTITLES)} AS subtitle_type, (event_id * 31 % 1001) / 1e3 AS subtitle_score,
          (event_id * 7919 % 1001) / 1e3 AS overall, (event_id * 104729 % 1001) / 1e3 AS material_score,
          (event_id * 1299709 % 1001) / 1e3 AS visual, (event_id * 611953 % 1001) / 1e3 AS cleanliness, (event_id * 350377 % 1001) / 1e3 AS stability,
          (event_id * 179424673 % 1001) / 1e3 AS composition, 2 + (event_id * 17 % 200) / 1e1 AS duration,
          concat('clip of ', event_type, ' no ', CAST(event_id % 499 AS VARCHAR(20))) AS description, ts AS created_at,
          concat(substr(md5(CAST(event_id % 330 AS VARCHAR(20))), 1, 15), substr('0123456789abcdef', CAST(event_id % 16 AS INT) + 1, 1)) AS phash,
          md5(CAST(event_id % 743 AS VARCHAR(20))) AS sha
        FROM {{events}}"""),
    "sources": (("orders",), f"""
        SELECT o_orderkey AS source_id, o_custkey AS task_id, {pick('floor(o_totalprice)', STATUSES)} AS status,
          {pick('floor(o_totalprice / 7e0)', REASONS)} AS reject_reason, o_orderdate AS created_at,
          concat('author', CAST(o_custkey % 50 AS VARCHAR(20))) AS author, 1 + (o_orderkey % 900) / 1e1 AS duration,
          concat('https://v.example.com/video/', CAST(100000000000 + o_orderkey AS VARCHAR(20))) AS url,
          concat('q', CAST(o_orderkey % 61 AS VARCHAR(20)), CASE WHEN o_orderkey % 3 = 0 THEN concat('|q', CAST(o_orderkey % 53 AS VARCHAR(20))) ELSE '' END) AS matched
        FROM {{orders}}"""),
    "ai_runs": (("lineitem",), """
        SELECT l_orderkey AS source_id, l_orderkey * 8 + l_linenumber AS run_id,
          CASE l_returnflag WHEN 'A' THEN 'preview' WHEN 'N' THEN 'tagging' ELSE 'expansion' END AS operation,
          CASE l_linestatus WHEN 'F' THEN 'ok' ELSE 'error' END AS status, CASE WHEN l_suppkey % 2 = 0 THEN 'p1' ELSE 'p2' END AS provider,
          concat('m', CAST(l_suppkey % 3 AS VARCHAR(20))) AS model, CAST(l_quantity * 100 AS BIGINT) AS prompt_tokens,
          CAST(l_quantity * 10 AS BIGINT) AS completion_tokens, CAST(l_quantity * 7 AS BIGINT) AS latency_ms,
          CAST(l_linenumber AS BIGINT) AS frames, CASE WHEN l_partkey % 10 < 8 THEN 'pipeline' ELSE 'retag' END AS origin, l_shipdate AS created_at
        FROM {lineitem}"""),
    "yields": (("lineitem",), """
        SELECT l_orderkey * 8 + l_linenumber AS yield_id, l_suppkey AS task_id, concat('q', CAST(l_partkey % 61 AS VARCHAR(20))) AS query,
          CAST(l_quantity AS BIGINT) AS candidates, CAST(floor(l_quantity / 2e0) AS BIGINT) AS uniques,
          CAST(floor(l_quantity / 5e0) AS BIGINT) AS accepted, CAST(floor(l_quantity / 9e0) AS BIGINT) AS downloads,
          CASE WHEN l_partkey % 61 % 7 = 0 THEN 0 ELSE CAST(floor(l_quantity / 12e0) AS BIGINT) END AS clips,
          CASE WHEN l_partkey % 61 % 5 = 0 THEN 0 ELSE CAST(floor(l_quantity / 4e0) AS BIGINT) END AS fresh,
          CAST(floor(l_quantity / 3e0) AS BIGINT) AS known, l_shipdate AS created_at
        FROM {lineitem}"""),
    "sampled": (("events",), """
        SELECT clip_id, frame FROM (SELECT DISTINCT CAST(floor(event_id / 12e0) AS BIGINT) AS clip_id FROM {events}) c, (SELECT 0 AS frame UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) f"""),
    "searches": (("lineitem",), f"""
        SELECT query, min(reference) AS reference, CAST(sum(clips) AS BIGINT) AS clips, CAST(CAST(sum(clips) AS BIGINT) AS DOUBLE) / CAST(sum(n) AS BIGINT) AS score,
          CAST(min(known) AS DOUBLE) / 1e1 AS rediscovery
        FROM (SELECT concat({pick('l_partkey % 61', MATERIALS)}, {pick('floor(l_partkey % 61 / 7e0)', PHRASES)}) AS query, {pick('l_partkey % 61 * 3', MATERIALS)} AS reference,
            CAST(l_quantity AS BIGINT) AS n, l_partkey % 10 AS known, CASE WHEN l_partkey % 61 % 8 = 0 THEN 0 ELSE CAST(floor(l_quantity / 12e0) AS BIGINT) END AS clips FROM {{lineitem}}) x
        GROUP BY query"""),
    "wanted": (("part",), f"""
        SELECT DISTINCT {pick('p_partkey', MATERIALS)} AS category FROM {{part}}"""),
    "regions": (("events",), """
        SELECT CAST(floor(event_id / 12e0) AS BIGINT) AS clip_id, CAST(floor(event_id % 12 / 3e0) AS BIGINT) AS frame,
          (event_id * 37 % 82) / 1e2 AS x1, (event_id * 53 % 88) / 1e2 AS y1,
          (event_id * 37 % 82) / 1e2 + (1 + event_id * 11 % CASE WHEN event_id % 9 = 0 THEN 80 ELSE 18 END) / 1e2 AS x2, (event_id * 53 % 88) / 1e2 + (1 + event_id * 13 % 11) / 1e2 AS y2,
          CASE WHEN event_id % 14 = 0 THEN '厂家优惠' ELSE 'text' END AS words
        FROM {events} WHERE event_id % 5 <> 0 AND floor(event_id / 12e0) % 10 <> 3"""),
}


def library(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapted table; columns that a query does not use are never read."""
    tables, sql = ADAPTERS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def oracle(sql: str) -> str:
    """DuckDB SQL that sees the adapted tables it names."""
    used = [n for n in ADAPTERS if n in sql]
    parts = [f"{n} AS ({ADAPTERS[n][1].format(**{t: t for t in ADAPTERS[n][0]})})" for n in used]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"
