"""Shared parts of the corpus operators: shared-folder tables and vectorised words."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Regular expression of a word: a run of anything but space and 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that are looked at in one go inside a task.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


class Scratch:
    """Tables written under ``spark.checkpoint.dir``, which all executors share.

    Writing a table cuts the lineage: a lost executor loses no finished step. Without a
    named folder a local session gets a temporary one; a cluster is refused, since its
    executors would write to their own disks.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("spark.checkpoint.dir", root)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Writes ``df`` and returns the written table."""
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of finished steps, which nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def running(scratch: Scratch, df: DataFrame, name: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with the sum of all rows before each one in ``order`` (distinct): ``sums`` maps columns to new names.

    Rows are dealt to ranges of the order, every range is summed on its own, and only the
    ranges' totals, one row each, are put in one line.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = df.select("*", *[o.alias(k) for o, k in zip(order, keys, strict=True)])
    ranged = keyed.repartitionByRange(*[F.asc_nulls_last(k) for k in keys]).withColumn("_range", F.spark_partition_id())
    ranged = scratch.save(ranged, name)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{new}") for c, new in sums.items()])
    line = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{new}").over(line), F.lit(0)).alias(f"_{new}") for new in sums.values()])
    inside = Window.partitionBy("_range").orderBy(*[F.asc_nulls_last(k) for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(new) for c, new in sums.items()])
    return own.join(totals, "_range").select(*df.columns, *[(F.col(new) + F.col(f"_{new}")).alias(new) for new in sums.values()])


# ---- bytes and words of Arrow batches ---------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1024)
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]), dtype=np.uint64)
    return _POWERS


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text; a longer row stands alone."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of some texts: ``start``, ``end`` in ``data``, ``row``, ``code`` into the ``distinct`` ones, ``hash`` and ``check``.

    ``hash`` is XXH3 and ``check`` the older XXH64, 64 bits each, of whole words: no sums or polynomials
    of bytes, and two functions that share no structure, so what one confuses the other tells apart.
    All four are made when asked for.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        data, offsets = utf8(column)
        if lower:
            data = _LOWER[data]
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        solid = ~_SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
        after = np.concatenate([solid[1:], [False]]) if len(data) else solid
        self.start = np.flatnonzero(solid & (~before | first[:-1]))
        self.end = np.flatnonzero(solid & (~after | first[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        #: number of words of each row, and where a row's words begin
        self.count = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self._solid, self._found = solid, None

    @property
    def code(self) -> np.ndarray:
        return self._distinct()[0]

    @property
    def distinct(self) -> list[bytes]:
        return self._distinct()[1]

    @cached_property
    def hash(self) -> np.ndarray:
        return self._hashed(xxhash.xxh3_64_intdigest)

    @property
    def check(self) -> np.ndarray:
        return self._hashed(xxhash.xxh64_intdigest)

    def _hashed(self, digest) -> np.ndarray:
        return np.fromiter(map(digest, self.distinct), np.uint64, len(self.distinct))[self.code]

    def _distinct(self) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word among the distinct ones, and these; told apart by their bytes."""
        if self._found is None:
            flat = np.ascontiguousarray(self.data[self._solid])
            offsets = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            coded = words.dictionary_encode()
            self._found = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        return self._found

    def shingles(self, n: int, check: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (of ``check`` if asked for) and rows of the runs of ``n`` words; a row with 1 to n-1 words has its whole sequence as one."""
        word = self.check if check else self.hash
        total = len(word)
        out = np.zeros(0, np.uint64)
        row = np.zeros(0, np.int64)
        if total >= n:
            size = total - n + 1
            value = np.zeros(size, np.uint64)
            for j in range(n):
                value += word[j : j + size] * _powers(n + 1)[j + 1]
            whole = self.row[:size] == self.row[n - 1 :]
            out, row = mix(value[whole] ^ np.uint64(n)), self.row[:size][whole]
        short = np.flatnonzero((self.count > 0) & (self.count < n))
        if len(short):
            extra = []
            for r in short:
                h = word[self.first[r] : self.first[r + 1]]
                extra.append((h * _powers(n + 1)[1 : 1 + len(h)]).sum(dtype=np.uint64) ^ np.uint64(len(h) + (1 << 32)))
            out = np.concatenate([out, mix(np.array(extra, np.uint64))])
            row = np.concatenate([row, short])
            order = np.argsort(row, kind="stable")
            out, row = out[order], row[order]
        return out, row


def distinct_places(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where the distinct values of each row stand, ascending by row, then value."""
    order = np.lexsort((value, row))
    if not len(order):
        return order
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return order[keep]


def distinct_by_row(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ascending by row, then value."""
    at = distinct_places(value, row)
    return value[at], row[at]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(flat: np.ndarray, count: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def blobs(flat: np.ndarray, count: np.ndarray) -> pa.Array:
    """A binary column: row i holds the next ``count[i]`` items of ``flat``."""
    raw = np.ascontiguousarray(flat)
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int64) * raw.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
