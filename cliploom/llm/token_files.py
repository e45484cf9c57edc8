"""Token-id files: documents in ascending order as blocks of a static range asymmetric numeral system.

A file set is a Parquet table of blocks, so that any store Spark writes to can hold it and
Spark's committer makes it whole or absent. A row is one block: the documents it holds with
their numbers of ids, the coded payload, checkpoints and checksums. ``table`` beside it
holds the frequency table that all blocks share.

Null text has the end id only; equal ids stand next to each other, shorter first, then by
their bytes; rows that repeat are documents of their own. Long texts are encoded whole and may go over many blocks.
An empty table gives an empty file set. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, rans, tokens

#: A block is closed once it holds this many ids; it holds whole documents.
BLOCK_IDS = 1 << 18
BLOCKS = "part long, block long, doc_ids array<long>, counts array<long>, n_ids long, payload binary, states binary, places array<long>, ids_crc long, payload_crc long"


def count_ids(table: DataFrame) -> np.ndarray:
    """How often each id occurs in all of ``ids``; as long as the vocabulary, so small."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(common.utf8(batch.column("ids"))[0].tobytes(), "<u2")
            found = np.bincount(ids, minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = table.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int) -> tuple[DataFrame, np.ndarray]:
    """Encodes ``docs`` into a new file set in the shared folder; returns its blocks and the frequency table.

    The texts are tokenised once into a table of 16-bit ids; counting and encoding read it.
    """
    scratch = common.Scratch(spark, "rans")

    def narrow(batches):
        for part, flat, count in tokens.token_batches(batches, vocabulary, end_id, keep=True):
            if len(flat) and int(flat.max()) >= 1 << 16:
                raise ValueError("ids of 16 bits hold vocabularies of up to 65,536 entries")
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), common.blobs(flat.astype("<u2"), count)], ["doc_id", "ids"])

    table = scratch.save(docs.select("doc_id", "text").mapInArrow(narrow, "doc_id long, ids binary"), "ids")
    freq = rans.frequencies(count_ids(table))
    shared = spark.sparkContext.broadcast(freq)  # one number per id of the vocabulary

    def encode(batches):
        coder, part, block = rans.Table(shared.value), TaskContext.get().partitionId(), 0
        held: list = []

        def close(rows):
            ids = np.concatenate([r[1] for r in rows])
            coded = coder.encode(ids)
            row = {"part": part, "block": block, "doc_ids": [r[0] for r in rows], "counts": [len(r[1]) for r in rows]} | coded
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_TYPE)

        size = 0
        for batch in batches:
            raw, offsets = common.utf8(batch.column("ids"))
            ids = np.frombuffer(raw.tobytes(), "<u2")
            for doc, (a, b) in zip(batch.column("doc_id").to_pylist(), pairwise((offsets // 2).tolist()), strict=True):
                held.append((doc, ids[a:b]))
                size += b - a
                if size >= BLOCK_IDS:
                    yield close(held)
                    held, size, block = [], 0, block + 1
        if held:
            yield close(held)

    blocks = table.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("ids"), "ids").mapInArrow(encode, BLOCKS)
    return scratch.save(blocks, "blocks", codec="none"), freq


_BLOCK_TYPE = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary()), ("states", pa.binary()), ("places", pa.list_(pa.int64())), ("ids_crc", pa.int64()), ("payload_crc", pa.int64())])


def read(spark: SparkSession, blocks: DataFrame, freq: np.ndarray, with_ids: bool = True) -> DataFrame:
    """Decodes a file set: ``part, block, doc_id, within, n_tokens, ids_crc32`` and, if wanted, ``ids``.

    ``within`` is the number of ids of the same block before the document. Any block decodes alone.
    """
    shared = spark.sparkContext.broadcast(freq)

    def decode(batches):
        coder = rans.Table(shared.value)
        for batch in batches:
            for block in batch.to_pylist():
                ids = coder.decode(block).astype("<u4")
                counts = np.array(block["counts"], np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(counts)
                columns = [pa.array(np.full(n, block["part"])), pa.array(np.full(n, block["block"])), pa.array(block["doc_ids"], pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                names = ["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, common.blobs(ids, counts)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.mapInArrow(decode, "part long, block long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def starts(blocks: DataFrame) -> DataFrame:
    """``part, block, before``: ids of all blocks before each one, summed by part first."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(upto(Window.orderBy("part"))), F.lit(0)).alias("part_before"))
    inside = F.coalesce(F.sum("n_ids").over(upto(Window.partitionBy("part").orderBy("block"))), F.lit(0))
    return blocks.select("part", "block", inside.alias("inside")).join(parts, "part").select("part", "block", (F.col("inside") + F.col("part_before")).alias("before"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.documents(spark, sf_dir)
    blocks, freq = write(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    rows = read(spark, blocks, freq, with_ids=False).join(starts(blocks), ["part", "block"])
    return rows.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
