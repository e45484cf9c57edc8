"""Incremental keyed merges: batches of changes into a snapshot, idempotent by batch, with an audit of old and new values."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .vocabulary import BOOKKEEPING_REASONS, SETTLED_STATUSES

#: When a change happened and what breaks ties; the last applied ones stay in the row.
ORDER = ("changed_at", "seq")
STAMPS = "created_at timestamp, updated_at timestamp, updated_seq long, batch_id long"


@dataclass(frozen=True)
class Keyed:
    """How the columns of a table merge.

    ``overwrite``: the last change, blanks too. ``fill``: the last change that is not null.
    ``verdict`` (status, reason): the last change, but a settled status stays against changes that
    only carry a bookkeeping reason. ``attempts`` (count, time): changes whose ``touch`` is true are
    counted, and the last one's time is kept.
    """

    name: str
    keys: dict[str, str]
    overwrite: dict[str, str] = field(default_factory=dict)
    fill: dict[str, str] = field(default_factory=dict)
    verdict: tuple[str, str] | None = None
    attempts: tuple[str, str] | None = None

    @property
    def values(self) -> dict[str, str]:
        own = {**self.overwrite, **self.fill}
        own |= dict.fromkeys(self.verdict or (), "string")
        return own | (dict(zip(self.attempts, ("long", "timestamp"), strict=True)) if self.attempts else {})

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} {kind}" for c, kind in {**self.keys, **self.values}.items()) + ", " + STAMPS


SOURCES = Keyed(
    "sources", {"platform": "string", "platform_video_id": "string"},
    overwrite=dict.fromkeys(("source_url", "title", "author"), "string"),
    fill={
        "task_id": "long", **dict.fromkeys(("author_id", "cover_url", "publish_time", "source_stats_json", "matched_queries", "media_url"), "string"),
        **dict.fromkeys(("duration", "preview_material_score", "preview_subtitle_score", "preview_quality_score"), "double"),
    },
    verdict=("status", "reject_reason"), attempts=("attempt_count", "last_attempt_at"),
)
CLEANUPS = Keyed(
    "cleanups", {"clip_id": "long", "version": "string"},
    overwrite={
        **dict.fromkeys(("status", "engine", "source_analysis_version", "output_path", "skip_reason", "regions_json", "before_metrics_json", "after_metrics_json", "settings_json", "quality_json", "reduction_json"), "string"),
        **dict.fromkeys(("review_status", "review_note", "review_failure_class", "provider", "input_kind", "input_vid", "run_id", "cloud_status", "cloud_error_class", "cloud_output_vid", "cloud_output_file_name", "error"), "string"),
        "eligible": "boolean", "processing_ms": "long", **dict.fromkeys(("reviewed_at", "submitted_at", "completed_at"), "timestamp"),
    },
)


def _same(a: str, b: str, keys) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys])


def fresh(snapshot: DataFrame, changes: DataFrame, table: Keyed, batch_id: int) -> DataFrame:
    """The changes with ``late``: true where the row has this or a later batch, or a change that is as new."""
    keys = list(table.keys)
    held = snapshot.select(*keys, F.struct(F.col("updated_at").alias(ORDER[0]), F.col("updated_seq").alias(ORDER[1])).alias("_at"), F.col("batch_id").alias("_batch"))
    late = F.coalesce((F.col("_batch") >= batch_id) | (F.struct(*ORDER) <= F.col("_at")), F.lit(False))
    complete = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in [*keys, *ORDER]])
    return changes.filter(complete).join(held, keys, "left").withColumn("late", late).drop("_at", "_batch")


def merged(snapshot: DataFrame, changes: DataFrame, table: Keyed, batch_id: int) -> DataFrame:
    """The new snapshot, with each row's old one as ``before`` (null if it is new) and ``late``, the number of changes that came too late.

    The changes of a key act as if applied one by one in order of ``changed_at`` and ``seq``, yet
    they are never gathered: every column is a partial aggregate (last, last not null, count). For
    the verdict the last change with more than a bookkeeping reason counts, and behind it the
    first bookkeeping change with a settled status, or else the last one, unless what
    they meet is settled. So one key may have any share of the changes. Changes without a
    key or a time are not applied.
    """
    keys, order = list(table.keys), F.struct(*ORDER)
    new = fresh(snapshot, changes, table, batch_id)
    good = new.filter("NOT late")
    columns = [F.max_by(c, order).alias(c) for c in table.overwrite]
    columns += [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in table.fill]
    columns += [F.max(order).alias("_last"), F.min("changed_at").alias("_first")]
    if table.attempts:
        columns += [F.count_if(F.coalesce("touch", F.lit(False))).alias("_tries"), F.max_by("changed_at", F.when(F.col("touch"), order)).alias("_tried")]
    if table.verdict:
        status, reason = table.verdict
        minor = F.coalesce(F.col(reason).isin(*BOOKKEEPING_REASONS), F.lit(False))
        columns += [F.max_by(F.struct(status, reason), F.when(~minor, order)).alias("_said"), F.max(F.when(~minor, order)).alias("_said_at")]
    last = good.groupBy(*keys).agg(*columns)
    if table.verdict:
        behind = good.filter(minor).join(last.select(*keys, "_said_at"), keys).filter(F.col("_said_at").isNull() | (order > F.col("_said_at")))
        settled = F.col(status).isin(*SETTLED_STATUSES)
        noted = behind.groupBy(*keys).agg(F.coalesce(F.min_by(F.struct(status, reason), F.when(settled, order)), F.max_by(F.struct(status, reason), order)).alias("_noted"))
        last = last.join(noted, keys, "left")
    late = new.filter("late").groupBy(*keys).agg(F.count("*").alias("late"))
    before = snapshot.select(*keys, F.struct(*[c for c in snapshot.columns if c not in keys]).alias("before"))
    both = before.join(last, keys, "full").join(late, keys, "left")
    touched, old = F.col("_last").isNotNull(), lambda c: F.col(f"before.{c}")
    out = {c: F.when(touched, F.col(c)).otherwise(old(c)) for c in table.overwrite}
    out |= {c: F.coalesce(F.col(c), old(c)) for c in table.fill}
    if table.verdict:
        base = F.coalesce("_said", F.when(F.col("before").isNotNull(), F.struct(old(status).alias(status), old(reason).alias(reason))))
        kept = F.when(F.coalesce(base[status].isin(*SETTLED_STATUSES), F.lit(False)), base).otherwise(F.coalesce("_noted", base))
        out |= {status: kept[status], reason: kept[reason]}
    if table.attempts:
        count, time = table.attempts
        out |= {count: F.coalesce(old(count), F.lit(0)) + F.coalesce("_tries", F.lit(0)), time: F.coalesce("_tried", old(time))}
    stamps = [F.coalesce(old("created_at"), F.col("_first")).alias("created_at"), F.coalesce(F.col("_last.changed_at"), old("updated_at")).alias("updated_at"), F.coalesce(F.col("_last.seq"), old("updated_seq")).alias("updated_seq")]
    stamps.append(F.when(touched, F.lit(batch_id).cast("long")).otherwise(old("batch_id")).alias("batch_id"))
    return both.select(*keys, *[out[c].cast(kind).alias(c) for c, kind in table.values.items()], *stamps, "before", F.coalesce("late", F.lit(0)).alias("late"))


def audit(rows: DataFrame, table: Keyed, batch_id: int) -> DataFrame:
    """``merged`` rows as what happened: one row per column with its old and new value, and one per key with late changes."""
    keys = list(table.keys)
    said = lambda c: F.col(c).cast("string")
    kind = F.when(F.col("before").isNull(), "insert").otherwise("update")
    entry = lambda kind, c, old, new: F.struct(kind.alias("action"), F.lit(c).alias("field"), old.alias("old_value"), new.alias("new_value"))
    moved = [F.when(~said(c).eqNullSafe(said(f"before.{c}")), entry(kind, c, said(f"before.{c}"), said(c))) for c in table.values]
    none = F.lit(None).cast("string")
    moved.append(F.when(F.col("late") > 0, entry(F.lit("late"), "", none, said("late"))))
    rows = rows.select(*keys, F.explode(F.array_compact(F.array(*moved))).alias("e"), F.lit(batch_id).cast("long").alias("batch_id"))
    return rows.select(*keys, "batch_id", "e.action", "e.field", "e.old_value", "e.new_value")


class Store:
    """A keyed table in a folder, merged batch by batch; ``apply`` fits ``foreachBatch``.

    Rows lie in buckets of the key's hash. A batch writes new versions of the buckets it touches,
    its audit, and then its mark; only marked batches are read. A batch that runs again, after a
    failure or as a repeat, starts from the versions before it, so it gives the same and
    changes nothing once it is marked. Old versions stay until ``forget``.
    """

    def __init__(self, spark: SparkSession, folder: str, table: Keyed, buckets: int = 64):
        self.spark, self.folder, self.table, self.buckets = spark, folder.rstrip("/"), table, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, folder: str) -> list[int]:
        path = self._path(folder)
        names = [f.getPath().getName() for f in self._files.listStatus(path)] if self._files.exists(path) else []
        return sorted(int(n.rsplit("=", 1)[-1]) for n in names if n.rsplit("=", 1)[-1].isdigit())

    def batches(self) -> list[int]:
        """The batches that are done."""
        return self._numbers(f"{self.folder}/done")

    def _versions(self, before: int | None = None) -> dict[int, int]:
        """The newest finished version of each bucket, among batches below ``before``."""
        done = {b for b in self.batches() if before is None or b < before}
        found = {}
        for batch in self._numbers(f"{self.folder}/rows"):
            if batch in done:
                for bucket in self._numbers(f"{self.folder}/rows/batch={batch}"):
                    found[bucket] = max(batch, found.get(bucket, batch))
        return found

    def current(self, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The table as of the last batch that is done."""
        schema = StructType.fromDDL(self.table.schema)
        paths = [f"{self.folder}/rows/batch={batch}/bucket={bucket}" for bucket, batch in self._versions(before).items() if only is None or bucket in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def audit(self) -> DataFrame:
        """What all batches changed."""
        paths = [f"{self.folder}/audit/batch={b}" for b in self.batches()]
        return self.spark.read.parquet(*paths)

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        done = self.batches()
        if batch_id in done:
            return
        if done and batch_id < done[-1]:
            raise ValueError(f"batch {batch_id} comes after {done[-1]}")
        bucket = F.pmod(F.xxhash64(*self.table.keys), F.lit(self.buckets)).cast("int")
        touched = {r.b for r in changes.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets`` rows
        rows = merged(self.current(batch_id, touched), changes, self.table, batch_id)
        work = f"{self.folder}/work/batch={batch_id}"
        rows.write.mode("overwrite").parquet(work)
        rows = self.spark.read.parquet(work)
        audit(rows, self.table, batch_id).write.mode("overwrite").parquet(f"{self.folder}/audit/batch={batch_id}")
        rows.drop("before", "late").repartition(bucket).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/batch={batch_id}")
        self._files.delete(self._path(work), True)
        self._files.create(self._path(f"{self.folder}/done/{batch_id}"), True).close()

    def forget(self) -> None:
        """Deletes versions that a later batch replaced."""
        newest = self._versions()
        for batch in self._numbers(f"{self.folder}/rows"):
            for bucket in self._numbers(f"{self.folder}/rows/batch={batch}"):
                if batch < newest.get(bucket, -1):
                    self._files.delete(self._path(f"{self.folder}/rows/batch={batch}/bucket={bucket}"), True)
