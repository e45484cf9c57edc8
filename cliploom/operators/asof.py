"""As-of joins: the nearest point before or after each row's time, within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a slice of time, in tolerances.
SLICE = 64


def nearest(rows: DataFrame, points: DataFrame, by: str, at: Column, point: str, name: str, tolerance: float, forward: bool = False) -> DataFrame:
    """``rows`` with ``name``: the last ``point`` of the same ``by`` at or before ``at`` (first at or after it, if ``forward``).

    Rows and points are put in one line per slice of time and sorted once; the last point seen
    goes along with the rows, so nothing is compared pairwise and no points are collected. A point
    less than ``tolerance`` from a slice's border is in the neighbouring slice too, so a ``by``
    with very many rows or points is dealt out by time. Points farther than ``tolerance`` count as
    none; rows without ``by`` or ``at`` find none, and repeated rows each find theirs.
    """
    length = SLICE * tolerance
    slot = lambda t: F.floor(t / length)
    marks = points.select(F.col(by).alias("_by"), F.col(point).cast("double").alias("_t")).filter("_by IS NOT NULL AND _t IS NOT NULL AND NOT isnan(_t)").distinct()
    around = F.sequence(slot(F.col("_t") - tolerance), slot(F.col("_t") + tolerance))
    marks = marks.select("_by", F.explode(around).alias("_slot"), "_t", F.col("_t").alias("_point"), F.lit(None).cast(rows.schema).alias("_row"))
    time = at.cast("double")
    lined = rows.select(F.col(by).alias("_by"), slot(time).alias("_slot"), time.alias("_t"), F.lit(None).cast("double").alias("_point"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    order = Window.partitionBy("_by", "_slot").orderBy(F.desc("_t") if forward else F.asc("_t"), F.col("_row").isNotNull())
    found = marks.unionByName(lined).withColumn("_point", F.last("_point", ignorenulls=True).over(order)).filter("_row IS NOT NULL")
    near = F.when(F.abs(F.col("_point") - F.col("_t")) <= tolerance, F.col("_point"))
    return found.select("_row.*", near.alias(name))
