"""Written tables that cut lineage, and row numbers over whole tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Writes a table under a name and reads it again.
Save = Callable[[DataFrame, str], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a new temporary folder for a local session without one; a cluster is refused."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def unique(what: str) -> str:
    """A name that no other run uses."""
    return f"{what}-{uuid.uuid4().hex[:12]}"


def saver(spark: SparkSession, what: str = "tables") -> Save:
    """Writes tables to a new part of the shared folder and reads them."""
    root = f"{shared_folder(spark)}/{unique(what)}"

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return save


def numbered(rows: DataFrame, order: list[Column], number: str, save: Save, name: str = "ranged") -> DataFrame:
    """``rows`` with ``number``, from 1 in ``order``, which should tell all rows apart.

    Rows are dealt to ranges of the order and numbered inside them; only the ranges' counts, one
    row each, are put in one line. So no task sorts more than a range, however many rows there are.
    """
    ranged = save(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    line = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return own.join(before, "_range").select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_own")).alias(number))
