"""Mixing sources to target weights: repetition rates per source, then whole and random copies.

Null text has size 0, a null source is a source of its own (the last one). Rows with equal
``doc_id`` draw the same random number, so reruns and repeated rows agree; rows without an
id draw one number together. An empty table gives an empty mix. Texts of any length only add
their number of words. Sources of equal weight that reach the cap together stop together. Further columns, whatever their names, are carried along unchanged.

Rates meet the documents in a plain join on the source: Spark sends the rates to every
executor where their written size allows it, and otherwise splits a source that holds a
large part of all rows (AQE skew join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = "mix-1"


def size_of(text: Column) -> Column:
    """The number of words of a whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(scratch: common.Scratch, sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source of ``sizes`` (source, size): ``source, source_size, weight, target, rate``.

    Sources in code point order, null last, take ``weights`` in turn and share ``share``
    times all sizes. No target exceeds ``most`` times its source's size; what is above is
    shared again by weight. With sources by ascending cap/weight the first one below its
    cap fixes the level ``target = level * weight`` of all that follow.
    """
    totals = scratch.save(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "totals").withColumn("one", F.lit(1))
    placed = common.running(scratch, totals, "by_source", [F.col("source")], {"one": "place"})
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = placed.select("source", "source_size", F.get(turn, F.col("place") % len(weights)).alias("weight"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = F.col("cap") / F.col("weight")
    levels = common.running(scratch, weighed, "by_ratio", [ratio, F.col("source")], {"cap": "capped", "weight": "used"})
    levels = scratch.save(levels, "levels")
    whole = levels.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(share) * (whole["size"] or 0)) - F.col("capped")) / (F.lit(whole["weight"] or 1.0) - F.col("used"))
    free = levels.filter(ratio > level).agg(F.min(F.struct(ratio.alias("ratio"), level.alias("level"))).alias("m")).first().m
    target = F.least(F.col("cap"), F.lit(free.level) * F.col("weight")) if free else F.col("cap")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    return scratch.save(levels.select("source", "source_size", "weight", target.alias("target")).withColumn("rate", rate), "rates")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _counted(spark: SparkSession, docs: DataFrame, carried: Column, seed: str, **how) -> DataFrame:
    """``row`` (whatever is carried), ``doc_id, size, source_size, target, rate, copies``."""
    scratch = common.Scratch(spark, "mix")
    own = docs.select(carried.alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"))
    rates = targets(scratch, own.select("source", "size"), **how).select(F.col("source").alias("of"), "source_size", "target", "rate")
    whole = F.floor("rate")
    by_chance = (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return own.join(rates, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("copies", (whole + by_chance).cast("long"))


def copies(spark: SparkSession, docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """``doc_id, size, source_size, target, rate, copies``: floor(rate) copies plus one by chance."""
    return _counted(spark, docs, F.lit(None).cast("int"), seed, **how).drop("row", "source")


def mix(spark: SparkSession, docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as its copies, same columns."""
    counted = _counted(spark, docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), seed, **how).filter("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copies(spark, common.documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * SUM(source_size) OVER () - COALESCE(SUM(cap) OVER before, 0)) / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER before, 0)) AS level
  FROM ranked WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, cap / weight) AS free FROM levels WHERE cap / weight > level),
targets AS (SELECT source, source_size, COALESCE(least(cap, free * weight), cap) AS target FROM levels, chosen),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate,
         CAST(('0x' || substr(md5('{SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
