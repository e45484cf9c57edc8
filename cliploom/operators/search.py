"""Finding clips in large libraries: free text by an index of three-letter pieces, pages by ranges of the sort key."""

from __future__ import annotations

import re

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Save

#: Letters of a piece, and ranges of a sort key that are counted.
PIECE, RANGES = 3, 256


# ---- free text ------------------------------------------------------------------------


def _pieces(text: Column) -> Column:
    """All runs of ``PIECE`` characters of a text in lower case, each once."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= PIECE, F.sequence(F.lit(1), F.length(low) - PIECE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, PIECE)))


def text_index(rows: DataFrame, columns: list[str], save: Save, name: str = "postings", key: str = "clip_id") -> DataFrame:
    """``piece, key``: which rows hold a piece in one of the columns; written in ranges of the piece, so a lookup reads few of them."""
    every = F.flatten(F.array(*[_pieces(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
    postings = rows.select(key, F.explode(F.array_distinct(every)).alias("piece"))
    return save(postings.repartitionByRange("piece", key).sortWithinPartitions("piece", key), name)


def wanted_pieces(text: str) -> list[str]:
    """The pieces that a match of ``text`` must hold; ``%`` and ``_`` stand for anything."""
    parts = re.split(r"[%_]+", text.lower())
    return sorted({p[i : i + PIECE] for p in parts for i in range(len(p) - PIECE + 1)})


def hits(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows with ``text`` in a column, case aside; ``%`` and ``_`` are wildcards. Reads every row."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return rows.filter(found)


def free_text(rows: DataFrame, index: DataFrame, columns: list[str], text: str, key: str = "clip_id") -> DataFrame:
    """The same by the index: rows that hold every piece of ``text``, then looked at themselves.

    A text without a run of three fixed characters has no pieces, and every row is looked at.
    """
    pieces = wanted_pieces(text)
    if not pieces:
        return hits(rows, columns, text)
    held = index.filter(F.col("piece").isin(*pieces)).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(pieces)).select(key)
    return hits(rows.join(held, key, "left_semi"), columns, text)


# ---- pages ------------------------------------------------------------------------------


def _ranged(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_range``, the place of ``key`` among ``RANGES`` of about as many rows each; null keys have one of their own."""
    share = [i / RANGES for i in range(1, RANGES)]
    value = F.col(key).cast("double")
    edges = rows.agg(F.percentile_approx(value, share, 10_000).alias("e")).first().e or []
    splits = [float("-inf"), *sorted({float(e) for e in edges}), float("inf")]
    deal = Bucketizer(splits=splits if len(splits) > 2 else [float("-inf"), 0.0, float("inf")], inputCol="_value", outputCol="_range", handleInvalid="keep")
    return deal.transform(rows.withColumn("_value", value)).withColumn("_range", F.coalesce("_range", F.lit(-1.0))).drop("_value")


def _cut(rows: DataFrame, key: str, descending: bool, first: int, size: int) -> tuple[DataFrame, int, int, int]:
    """The rows of the ranges that hold places ``first`` to ``first + size`` of the order by ``key``, how many stand before them, how many they are, and 1 if they have one value only."""
    ranged = _ranged(rows, key)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n"), (F.min(key) == F.max(key)).alias("one")).collect()  # one row per range
    null = lambda r: r._range < 0
    # nulls come last in a descending order and first in an ascending one, as the sort has them
    counts.sort(key=lambda r: (null(r), -r._range) if descending else (not null(r), r._range))
    before, chosen, taken, single = 0, [], 0, 0
    for r in counts:
        if before + taken + r.n <= first and not chosen:
            before += r.n
        elif before + taken < first + size:
            chosen.append(r._range)
            taken += r.n
            single += 1 if r.one or null(r) else 2
    return ranged.filter(F.col("_range").isin(*chosen)).drop("_range"), before, taken, single


def page(rows: DataFrame, order: str, size: int, number: int, descending: bool = True, key: str = "clip_id") -> DataFrame:
    """One page by ``order`` (a number or a time), ties from the largest ``key`` on; a page past the end is the last one.

    Rows are counted by ranges of the sort key; only the ranges that the page lies in are sorted. Where
    these hold a single value, however often, its rows are cut by ranges of ``key`` in the same way. So a deep
    page costs two counts and the sort of some ranges, not of all rows before it.
    """
    total = rows.count()
    first = min(number, max(0, (total - 1) // size)) * size
    found, before, taken, single = _cut(rows, order, descending, first, size)
    if single == 1 and taken > size:
        found, more, _, _ = _cut(found, key, True, first - before, size)
        before += more
    return found.orderBy(F.desc(order) if descending else F.asc(order), F.desc(key)).offset(first - before).limit(size)
