"""Health of a library's files: a parallel listing, rows whose file is not there or outside the root, files no row names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Save

# ---- fixed values ----
MEDIA, THUMBNAILS = (".mp4", ".mov", ".m4v"), (".jpg", ".jpeg", ".png", ".webp")
# ---- end of fixed values ----
#: First-level folders that are listed in one go.
FOLDERS = 256


def canonical(path: Column) -> Column:
    """A path without scheme, empty and ``.`` parts, ``..`` resolved; null for a blank one."""
    plain = F.regexp_replace(F.trim(path), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(part)))
    parts = F.aggregate(F.split(plain, "/"), F.array().cast("array<string>"), step)
    whole = F.concat(F.when(plain.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(F.coalesce(F.trim(path), F.lit("")) != "", whole)


def inside(path: Column, root: str) -> Column:
    return path.startswith(root.rstrip("/") + "/")


def listing(spark: SparkSession, root: str, save: Save, suffixes: tuple[str, ...] = MEDIA + THUMBNAILS, folders: int = FOLDERS) -> DataFrame:
    """``path, bytes`` of the files below ``root`` with one of the suffixes, in any case of letters; contents are never read.

    Spark lists folders in parallel but keeps what it found on the driver, so the folders below the root are
    listed some at a time, each part written before the next.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    entries = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    below = sorted(e.getPath().toString() for e in entries if e.isDirectory())
    reader = lambda deep: spark.read.format("binaryFile").option("recursiveFileLookup", deep)
    wanted = lambda df: df.select(canonical(F.col("path")).alias("path"), F.col("length").alias("bytes")).filter(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    parts = [wanted(reader(False).load([e.getPath().toString() for e in entries if e.isFile()]))] if any(e.isFile() for e in entries) else []
    parts += [wanted(reader(True).load(below[i : i + folders])) for i in range(0, len(below), folders)]
    found = spark.createDataFrame([], "path string, bytes long")
    for i, part in enumerate(parts):
        found = found.union(save(part, f"listing{i}"))
    return found


def problems(clips: DataFrame, cleanups: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``kind, clip_id, path, reason``: videos, thumbnails and cleanup outputs that a row names and that are not there.

    Videos and thumbnails outside the root count as such whether or not they exist; cleanup outputs may lie anywhere.
    A clip without a thumbnail path has no problem, one without a video path has. ``files`` is a listing.
    """
    named = lambda df, kind, c, own: df.select(F.lit(kind).alias("kind"), "clip_id", canonical(F.col(c)).alias("path"), F.lit(own).alias("own"))
    rows = named(clips, "video", "file_path", True).union(named(clips, "thumbnail", "thumbnail_path", True).filter("path IS NOT NULL")).union(named(cleanups, "cleanup", "output_path", False).filter("path IS NOT NULL"))
    there = files.select("path").distinct().withColumn("there", F.lit(True))
    reason = F.when(F.col("own") & ~F.coalesce(inside(F.col("path"), root), F.lit(False)), "outside_root").when(F.col("there").isNull(), "missing_file")
    return rows.join(there, "path", "left").select("kind", "clip_id", "path", reason.alias("reason")).filter("reason IS NOT NULL")


def orphans(clips: DataFrame, cleanups: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``path, kind``: media below the root that no clip and no cleanup output names, thumbnails that no clip names."""
    ends = lambda suffixes: F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    kind = F.when(ends(MEDIA), "media").when(ends(THUMBNAILS), "thumbnail")
    own = files.filter(inside(F.col("path"), root)).select("path", kind.alias("kind")).filter("kind IS NOT NULL")
    named = lambda df, c, what: df.select(canonical(F.col(c)).alias("path"), F.lit(what).alias("kind"))
    used = named(clips, "file_path", "media").union(named(clips, "thumbnail_path", "thumbnail")).union(named(cleanups, "output_path", "media")).distinct()
    return own.join(used, ["path", "kind"], "left_anti")
