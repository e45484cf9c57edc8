"""Registered queries of intake, text boxes and time ranges; SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import coverage, duplicates, geometry, ingest, library, payloads, segments, tables
from ..sources.adapters import library as table


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made of the stored sources: five shapes, broken texts, and lists with an entry that is none."""
    s, n = table(spark, sf_dir, "sources"), F.col("source_id")
    stream = lambda url, rate, mark, many: F.struct((F.array(url) if many else url).alias("urls" if many else "url"), rate.alias("bitrate"), mark.alias("watermark"))
    media = F.struct(stream(F.concat(F.lit("https://a/"), n), n % 7, n % 2 == 0, False).alias("video"), F.array(stream(F.concat(F.lit("https://b/"), n), n % 5, n % 3 == 0, True), stream(F.lit("ftp://c"), F.lit(99).cast("long"), F.lit(False), True)).alias("streams"))
    item = F.struct(
        F.when((n % 4 != 0) & (n % 11 != 0), n.cast("string")).alias("content_id"), F.when((n % 4 == 0) & (n % 11 != 0), n).alias("aweme_id"), F.concat(F.lit("about "), "url").alias("description"),
        F.when(n % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("title "), "author")).alias("title"), F.struct(F.col("author").alias("nickname")).alias("author"), F.when(n % 3 != 0, F.col("duration") * 1000).alias("duration_ms"),
        F.when(n % 6 == 0, "soon").alias("duration"), media.alias("media"), F.array(F.lit("t1"), F.lit("t2")).alias("tags"),
    )
    text, bare = F.to_json(item), F.to_json(F.array(item))
    shapes = [text, F.concat(F.lit('{"items": '), bare, F.lit("}")), bare, F.concat(F.lit('{"data": {"items": '), bare, F.lit("}}")), F.concat(F.lit('{"posts": '), bare, F.lit("}")), F.substring(text, 1, 30), F.concat(F.lit("["), text, F.lit(', "x"]'))]
    shape = F.get(F.array(*shapes), (n % 7).cast("int"))
    return s.select("source_id", shape.alias("payload"))


def _candidates(spark, sf_dir):
    return payloads.normalize(payloads.unwrap(_payloads(spark, sf_dir)))


def _normalized(spark, sf_dir):
    rows = _candidates(spark, sf_dir).filter("reason IS NULL")
    return rows.select("source_id", "seq", F.col("platform_video_id").alias("video_id"), "title", "author", "duration", "no_video", F.size("tags").alias("n_tags"), "media_url", F.array_join("issues", "|").alias("issues"))


def _hits(spark, sf_dir):
    s = table(spark, sf_dir, "sources")
    video = (F.col("source_id") % 977).cast("string")
    return s.select((F.col("task_id") % 7).alias("task_id"), video.alias("video_id"), F.concat(F.lit("u"), F.col("source_id") % 977 % 311).alias("url"), F.col("source_id").alias("seq"), F.concat(F.lit("q"), F.col("source_id") % 13).alias("query"))


def _collapsed(spark, sf_dir):
    c = ingest.collapse(_hits(spark, sf_dir))
    return c.select("url", "video_id", "seq", F.array_join("queries", ",").alias("queries"))


def _probe(spark, sf_dir):
    s = table(spark, sf_dir, "sources")
    stream = F.struct(F.lit("video").alias("codec_type"), F.lit(1080).alias("width"), F.lit(1920).alias("height"), (F.col("source_id") % 900 + 1).cast("string").alias("nb_frames"), F.when(F.col("source_id") % 9 == 0, "0/0").otherwise("30/1").alias("r_frame_rate"))
    fmt = F.struct(F.when(F.col("source_id") % 3 == 0, F.col("duration").cast("string")).alias("duration"))
    reports = s.select("source_id", F.to_json(F.struct(fmt.alias("format"), F.array(stream).alias("streams"))).alias("report"))
    p = ingest.probe(reports)
    return p.select("source_id", F.bround("seconds", 4).alias("seconds"), "width", "height", "fps", "has_audio")


def _batch(spark, sf_dir):
    """All clips as one batch into an empty library."""
    clips = table(spark, sf_dir, "clips").select("clip_id", "category", "sha", "phash")
    return duplicates.in_order(clips, clips.limit(0), tables.saver(spark, "batch"))


def _segments(spark, sf_dir):
    c = table(spark, sf_dir, "clips")
    start = (F.col("clip_id") % 3) * 20.0 + F.col("overall")
    return c.select(F.col("source_id").alias("video_id"), start.alias("start"), (start + F.col("duration") * 2).alias("end"))


def _boundaries(spark, sf_dir):
    c = table(spark, sf_dir, "clips")
    return c.select(F.col("source_id").alias("video_id"), F.explode(F.array((F.col("clip_id") % 3) * 20.0, (F.col("clip_id") % 3) * 20.0 + F.col("visual") * 30)).alias("t"))


def _snapped(spark, sf_dir):
    s = segments.snap(_segments(spark, sf_dir), _boundaries(spark, sf_dir))
    return s.select("video_id", F.bround("start", 4).alias("start"), F.bround("end", 4).alias("end"), "refined")


def _tag_counts(clips):
    tags = F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("shot:"), "shot"), F.concat(F.lit("stage:"), "stage")), F.transform(F.split("roles", ","), lambda r: F.concat(F.lit("role:"), r)))))
    return clips.select("clip_id", tags.alias("tag"))


def _delta(spark, sf_dir):
    """Two snapshots; one lacks a category, the other one has fewer clips and stages."""
    c = table(spark, sf_dir, "clips")
    count = lambda cond: c.filter(cond).groupBy("category", "stage").agg(F.count("*").alias("total"))
    return coverage.delta(count("category <> 'mushroom' AND clip_id % 5 < 2"), count("clip_id % 7 < 4 AND stage <> 'other'"))


def _hamming(spark, sf_dir):
    c = table(spark, sf_dir, "clips").select("clip_id", "phash")
    other = c.select((F.col("clip_id") + 1).alias("clip_id"), F.col("phash").alias("before"))
    return c.join(other, "clip_id").select("clip_id", duplicates.hamming(F.col("phash"), F.col("before")).alias("distance"))


def _times(spark, sf_dir):
    s = table(spark, sf_dir, "sources")
    raw = F.when(F.col("source_id") % 2 == 0, F.unix_timestamp("created_at").cast("string")).otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    return s.select("source_id", text.parse_time(raw).alias("at"))


def _on(name):
    return lambda f: lambda spark, sf_dir: f(table(spark, sf_dir, name))


_BITS = "bit_count(xor(('0x' || substr({0}, 1, 8))::BIGINT, ('0x' || substr({1}, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr({0}, 9, 8))::BIGINT, ('0x' || substr({1}, 9, 8))::BIGINT))"
_TAGS = "(SELECT DISTINCT clip_id, unnest(list_concat(['shot:' || shot, 'stage:' || stage], list_transform(string_split(roles, ','), lambda r: 'role:' || r))) AS tag FROM clips)"

_READ = "source_id % 11 <> 0 AND source_id % 7 <> 5"
#: The rule by rounds over all pairs: out if an earlier match stays, in if all earlier matches are out.
_IN_ORDER = f"""WITH RECURSIVE pairs AS (SELECT a.clip_id AS a, b.clip_id AS b FROM clips a JOIN clips b ON a.clip_id < b.clip_id AND a.sha = b.sha
  UNION SELECT a.clip_id, b.clip_id FROM clips a JOIN clips b ON a.clip_id < b.clip_id AND a.category = b.category WHERE {_BITS.format('a.phash', 'b.phash')} <= 6),
rounds AS (SELECT clip_id AS id, -1 AS kept, 0 AS turn FROM clips
  UNION ALL SELECT s.id, CASE WHEN s.kept >= 0 THEN s.kept WHEN e.hit = 1 THEN 0 WHEN COALESCE(e.waits, 0) = 0 THEN 1 ELSE -1 END, s.turn + 1 FROM rounds s
    LEFT JOIN (SELECT p.b, max(k.kept) AS hit, count(*) FILTER (WHERE k.kept = -1) AS waits FROM pairs p JOIN rounds k ON k.id = p.a GROUP BY p.b) e ON e.b = s.id WHERE EXISTS (SELECT 1 FROM rounds WHERE kept = -1))
SELECT id, kept = 1 AS kept FROM rounds WHERE turn = (SELECT max(turn) FROM rounds)"""

#: key -> (query, SQL or None)
QUERIES: dict[str, tuple[Callable, str | None]] = {
    "normalize_candidates": (_normalized, f"""SELECT source_id, CAST(0 AS INT) AS seq, CAST(source_id AS VARCHAR) AS video_id, CASE WHEN source_id % 5 = 0 THEN substr('about ' || url, 1, 60) ELSE 'title ' || author END AS title, author,
      CASE WHEN source_id % 3 <> 0 THEN round_even(duration * 1000 / 1000.0::DOUBLE, 3) END AS duration, false AS no_video, CAST(2 AS INT) AS n_tags, CASE WHEN source_id % 6 = 0 THEN 'duration' ELSE '' END AS issues,
      CASE WHEN (source_id % 2 <> 0) = (source_id % 3 <> 0) THEN CASE WHEN source_id % 7 >= source_id % 5 THEN 'https://a/' ELSE 'https://b/' END WHEN source_id % 2 <> 0 THEN 'https://a/' ELSE 'https://b/' END || source_id AS media_url FROM sources WHERE {_READ}"""),
    "unwrap_pages": (
        lambda s, d: _candidates(s, d).groupBy(F.coalesce("reason", F.lit("read")).alias("outcome")).agg(F.count("*").alias("n")),
        f"""SELECT CASE WHEN {_READ} THEN 'read' WHEN source_id % 7 = 5 THEN 'not_json' WHEN source_id % 7 = 0 THEN 'unknown_shape' ELSE 'no_id' END AS outcome, count(*) AS n FROM sources GROUP BY 1
      UNION ALL SELECT 'not_an_object', count(*) FROM sources WHERE source_id % 7 = 6""",
    ),
    "probe_parse": (_probe, """SELECT source_id, round_even(CASE WHEN source_id % 3 = 0 THEN duration WHEN source_id % 9 = 0 THEN NULL ELSE (source_id % 900 + 1) / 30.0::DOUBLE END, 4) AS seconds, CAST(1080 AS INT) AS width, CAST(1920 AS INT) AS height,
      CASE WHEN source_id % 9 <> 0 THEN 30.0::DOUBLE END AS fps, false AS has_audio FROM sources"""),
    "in_run_duplicates": (lambda s, d: ingest.in_run_duplicates(_hits(s, d)).select("seq", "duplicate"), "SELECT source_id AS seq, row_number() OVER (PARTITION BY task_id % 7, source_id % 977 ORDER BY source_id) > 1 AS duplicate FROM sources"),
    "collect_candidates": (_collapsed, """WITH h AS (SELECT CAST(source_id % 977 AS VARCHAR) AS video_id, 'u' || (source_id % 977 % 311) AS url, source_id AS seq, 'q' || (source_id % 13) AS query FROM sources),
      i AS (SELECT video_id, url, min(seq) AS seq FROM h GROUP BY 1, 2), f AS (SELECT url, arg_min(video_id, seq) AS video_id, min(seq) AS seq FROM i GROUP BY url),
      q AS (SELECT h.url, query, min(i.seq) AS s1, min(h.seq) AS s2 FROM h JOIN i USING (video_id) GROUP BY h.url, h.video_id, query), o AS (SELECT url, query, min((s1, s2)) AS k FROM q GROUP BY 1, 2)
      SELECT f.url, f.video_id, f.seq, (SELECT string_agg(query, ',' ORDER BY k) FROM o WHERE o.url = f.url) AS queries FROM f"""),
    "dedup_batch": (_batch, _IN_ORDER),
    "hamming": (_hamming, f"SELECT a.clip_id, CAST({_BITS.format('a.phash', 'b.phash')} AS INT) AS distance FROM clips a JOIN clips b ON a.clip_id = b.clip_id + 1"),
    "parse_time": (_times, "SELECT source_id, created_at AS at FROM sources"),
    "video_id": (_on("sources")(lambda s: s.select("source_id", text.video_id(F.col("url")).alias("video_id"))), "SELECT source_id, regexp_extract(url, '/video/([0-9]{6,})', 1) AS video_id FROM sources"),
    "tag_counts": (lambda s, d: _tag_counts(table(s, d, "clips")).groupBy("tag").agg(F.count("*").alias("n")), f"SELECT tag, count(*) AS n FROM {_TAGS} GROUP BY 1"),
    "coverage_delta": (_delta, """SELECT category, stage, count(*) FILTER (WHERE clip_id % 7 < 4 AND stage <> 'other') - count(*) FILTER (WHERE clip_id % 5 < 2) AS change FROM clips WHERE category <> 'mushroom' GROUP BY 1, 2 HAVING change <> 0"""),
    "segment_boundary_snap": (_snapped, """WITH s AS (SELECT clip_id, source_id AS video_id, (clip_id % 3) * 20.0::DOUBLE + overall AS a, (clip_id % 3) * 20.0::DOUBLE + overall + duration * 2 AS b FROM clips),
      t AS (SELECT DISTINCT source_id AS video_id, unnest([(clip_id % 3) * 20.0::DOUBLE, (clip_id % 3) * 20.0::DOUBLE + visual * 30]) AS t FROM clips),
      j AS (SELECT clip_id, s.video_id, a, b, max(CASE WHEN t <= a AND a - t <= 1.5::DOUBLE THEN t END) AS ta, min(CASE WHEN t >= b AND t - b <= 1.5::DOUBLE THEN t END) AS tb FROM s LEFT JOIN t USING (video_id) GROUP BY 1, 2, 3, 4)
      SELECT video_id, round_even(COALESCE(ta, a), 4) AS "start", round_even(COALESCE(tb, b), 4) AS "end", COALESCE(ta, a) <> a OR COALESCE(tb, b) <> b AS refined FROM j"""),
}
