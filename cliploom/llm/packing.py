"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

Lengths lie between 1 and the sequence length, so the corpus enters the search as one count
per length, however many documents there are. The fullest combination for the longest
length left is found by a bitset subset-sum over the available lengths and is removed as
often as the counts allow; every round uses up a length, so there are at most as many
combinations as lengths. Pieces then find their place by their rank among equal lengths,
without being moved.

Null text is empty (its end id alone), repeated rows are packed one by one, an empty table
packs to nothing. Long texts are encoded whole and cut into pieces of the sequence length. Pieces of equal length
are placed in the order of their ranges and rows; which one of a tie comes first changes no length. Only
``doc_id`` and ``text`` are read, so columns of any other name are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

SEQUENCE = 2048
PIECES = "doc_id long, piece int, start long, length long, ids binary, part long, rank long"


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths from ``counts`` (length: how many) with the largest sum up to ``room``."""
    bits, steps = 1, []
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            take = min(chunk, left)
            steps.append((bits, length, take))
            bits |= (bits << (length * take)) & mask
            left, chunk = left - take, chunk * 2
        if bits & goal:
            break
    at, found = bits.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            found += [length] * take
            at -= length * take
    return found


def combinations(counts: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[dict[int, int], int]]:
    """Pairs of a combination (length: times) and the number of sequences made of it."""
    left, found = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        made: dict[int, int] = {longest: 1}
        for length in rest:
            made[length] = made.get(length, 0) + 1
        times = min(left[k] // v for k, v in made.items())
        for k, v in made.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
        found.append((made, times))
    return found


def slots(found: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, low, high, per, base, place``: ranks low..high-1 of a length fill ``per`` places of each sequence from ``base`` on."""
    rows, used, base = [], {}, 0
    for made, times in found:
        place = 0
        for length, per in sorted(made.items(), reverse=True):
            low = used.get(length, 0)
            used[length] = low + per * times
            rows.append((length, low, used[length], per, base, place))
            place += length * per
        base += times
    return rows


def most_places(capacity: int = SEQUENCE) -> int:
    """The bound of the table that is broadcast, whatever the corpus: 129,024 rows of six longs for 2048.

    Every combination uses up a length, so there are ``capacity`` of them at most, and d
    distinct lengths in one combination sum to d (d + 1) / 2 or more.
    """
    return capacity * ((math.isqrt(8 * capacity + 1) - 1) // 2)


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = SEQUENCE) -> DataFrame:
    """Pieces of at most ``capacity`` ids with their rank among equal lengths of the same task."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, flat, count in tokens.token_batches(batches, vocabulary, end_id):
            number = -(-count // capacity)
            row = np.repeat(np.arange(len(count)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            lead = count - (number - 1) * capacity
            length = np.where(piece == 0, lead[row], capacity)
            start = np.where(piece == 0, 0, lead[row] + (piece - 1) * capacity)
            order = np.argsort(length, kind="stable")
            sorted_length = length[order]
            first = np.searchsorted(sorted_length, sorted_length)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - first + seen[sorted_length]
            seen += np.bincount(length, minlength=capacity + 1)
            ids = common.blobs(flat.astype("<u4"), length)
            columns = [batch.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), ids, pa.array(np.full(len(row), part)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "part", "rank"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def assign(spark: SparkSession, table: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces."""
    by_part = table.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    rows = slots(combinations(counts, capacity))
    places = spark.createDataFrame(rows, "slot_length long, low long, high long, per long, base long, place long")
    ranked = table.join(offsets, ["part", "length"]).withColumn("place_rank", F.col("rank") + F.col("earlier"))
    inside = (F.col("length") == F.col("slot_length")) & (F.col("place_rank") >= F.col("low")) & (F.col("place_rank") < F.col("high"))
    nth = F.col("place_rank") - F.col("low")
    return (
        ranked.join(F.broadcast(places), inside)  # bounded, see most_places
        .withColumn("sequence_id", F.col("base") + F.floor(nth / F.col("per")).cast("long"))
        .withColumn("offset", F.col("place") + (nth % F.col("per")) * F.col("length"))
        .drop("part", "rank", "place_rank", "earlier", "slot_length", "low", "high", "per", "base", "place")
    )


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int, capacity: int = SEQUENCE) -> tuple[DataFrame, DataFrame]:
    """The pieces with their ids, and the place of every piece (``ids_crc32`` instead of the ids)."""
    scratch = common.Scratch(spark, "pack")
    table = scratch.save(pieces(docs, vocabulary, end_id, capacity), "pieces")
    light = scratch.save(table.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "light")
    return table, assign(spark, light, capacity)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    _, placed = pack(spark, common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
