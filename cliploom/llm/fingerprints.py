"""Document fingerprints: bottom-k sketches of 48-bit hashes of five-word shingles.

A fingerprint is the base64 of the ``K`` smallest hashes in ascending order, six bytes each,
so equal texts have equal fingerprints and a text with fewer shingles keeps its whole set.
Fingerprints of parts merge into that of the whole. Words are ``[^\\x20\\x09-\\x0D]+`` as they
stand; a text of one to four words has its whole sequence as its only shingle, and one
without words (null included) has the empty fingerprint. Two empty ones are alike (1), an
empty and another are not (0). Rows that repeat an id stand next to each other by their text, so one may be the
other's next document. Long texts are taken whole, one at a time beside a few of the next. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 128
SHINGLE = 5
_TOP = float(1 << 48)


def sketches(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """The ``k`` smallest distinct shingle hashes of each text, ascending."""
    value, row = common.Words(texts).shingles(SHINGLE)
    value, row = common.distinct_by_row(value >> np.uint64(16), row)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    return [value[a : min(b, a + k)] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes() and sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], 1).copy().view(">u8").reshape(-1).astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated shared part of the union of the two shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), both).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * _TOP / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of the shingles of ``a`` that ``b`` has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """``range, is_head, doc_id, text``, sorted so that every row's next document follows it.

    Documents are dealt to ranges of ``doc_id``; a range also gets a copy of the largest
    document of the range below (the lowest range: that of the highest), marked
    ``is_head``, so that each text is moved once and no order over all rows is needed.
    Rows with one id are ordered by text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    share = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", share, 10_000).alias("b")).first().b if share else []
    splits = [float("-inf"), *(sorted({float(b) for b in bounds or []}) or [0.0]), float("inf")]
    deal = Bucketizer(splits=splits, inputCol="id_value", outputCol="range", handleInvalid="keep")
    dealt = deal.transform(docs.withColumn("id_value", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))).withColumn("range", F.col("range").cast("int")).drop("id_value")
    # one row per range
    order = Window.orderBy("range")
    heads = dealt.groupBy("range").agg(F.max("doc_id").alias("head"))
    heads = heads.select("head", F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy())).alias("to"))
    marked = dealt.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct("range", F.lit(False).alias("is_head"))
    copy = F.struct(F.col("to").alias("range"), F.lit(True).alias("is_head"))
    placed = marked.select("doc_id", "text", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("p")).select("p.range", "p.is_head", "doc_id", "text")
    return placed.repartition(ranges, "range").sortWithinPartitions("range", "is_head", F.col("doc_id").desc_nulls_last(), "text")


def fingerprinted(docs: DataFrame, ranges: int) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness."""

    def run(batches):
        held = None
        for batch in batches:
            for part in common.pieces(batch, "text"):
                table = pa.Table.from_batches([x for x in (held, part) if x is not None]).combine_chunks()
                held = table.slice(table.num_rows - 1).to_batches()[0]
                texts, ids = table.column("text").to_pylist(), table.column("doc_id").to_pylist()
                own = sketches(table.column("text").combine_chunks())
                rows = [i for i, head in enumerate(table.column("is_head").to_pylist()[:-1]) if not head]
                changed = [edited(texts[i], texts[i + 1]) for i in rows]
                theirs = sketches(pa.array(changed, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in rows], pa.int64()),
                        pa.array([len(texts[i]) for i in rows], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                        pa.array([to_text(own[i]) for i in rows], pa.string()),
                        pa.array([to_text(x) for x in theirs], pa.string()),
                        pa.array([resemblance(own[i], x) for i, x in zip(rows, theirs, strict=True)], pa.float64()),
                        pa.array([resemblance(own[i], own[i + 1]) for i in rows], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return with_next(docs, ranges).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fingerprinted(common.documents(spark, sf_dir), ranges)
