"""A Merkle manifest of a dataset, built level by level with lag and lead windows.

A leaf is the SHA-256 of a row's fields, each written as its byte count, a colon and its value, or
as ``-`` where it is null. Leaves of a group (``source``) ascend by ``doc_id``. On every level 16
consecutive nodes are a run; fixed-offset lag and lead columns over the run, masked by the slot and
the run's length, give each node what stands left and right of it, and the run's first row hashes
the parent from itself and its leads. Groups with one node left pass it on unchanged. The nodes that
remain, the subroots, make a second tree in the order of the groups.

Texts are hashed where they are read and never move. Positions come from ranges of (group, id) with
prefix sums of the ranges' counts, so a group with a third of all rows lies in many tasks. Windows and
joins are keyed by (group, run), 16 rows at most. Siblings are kept on the levels above the leaves
only, a sixteenth of the rows, and reach the leaves by one join.

Null fields are ``-``, so a null and an empty text differ. Rows without an id come last in their group;
rows that repeat an id are ordered by their leaf, and equal rows are leaves of their own with equal
digests. Rows without a source are a group, the first one. An empty table gives an empty manifest.
Long texts are hashed whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Nodes of a run, and the bits of their slot.
RUN, BITS = 16, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings put together; null ones add nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """A field as a leaf holds it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def fold(path: Column, start: Column) -> Column:
    """The root that ``start`` and the siblings of ``path`` give."""
    return F.aggregate(path, start, lambda node, level: digest(level["left"], node, level["right"]))


def proof(path: Column) -> Column:
    """All siblings of ``path``, level by level, left to right, in one string."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "")


def placed(scratch: common.Scratch, nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` (``g`` and others) with ``i``, their place in the group by ``order``, and ``n``, the group's nodes."""
    by = [F.asc_nulls_last(c) for c in order]
    ranged = scratch.save(nodes.repartitionByRange("g", *by).withColumn("_range", F.spark_partition_id()), name)
    inside = Window.partitionBy("_range", "g").orderBy(*by)
    group = Window.partitionBy("g")
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range", "g").agg(F.count("*").alias("_here"))
    counts = counts.select("_range", "g", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"), F.sum("_here").over(group).alias("n"))
    numbered = ranged.withColumn("_at", F.row_number().over(inside) - 1).join(counts, ["_range", "g"])
    return numbered.select("g", (F.col("_before") + F.col("_at")).alias("i"), "n", *[c for c in nodes.columns if c != "g"])


def _siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``g, i, n, digest``) with their ``run``, and the digests ``left`` and ``right`` of them in it."""
    nodes = nodes.withColumn("run", F.shiftright("i", BITS)).withColumn("_slot", F.col("i").bitwiseAND(RUN - 1))
    nodes = nodes.withColumn("_size", F.least(F.lit(RUN), F.col("n") - F.shiftleft("run", BITS)))
    run = Window.partitionBy("g", "run").orderBy("i")
    slot, size = F.col("_slot"), F.col("_size")
    lags = [F.when(slot >= k, F.lag("digest", k).over(run)) for k in range(RUN - 1, 0, -1)]
    leads = [F.when(slot + k < size, F.lead("digest", k).over(run)) for k in range(1, RUN)]
    return nodes.withColumns({"left": F.concat_ws("", *lags), "right": F.concat_ws("", *leads)}).drop("_slot", "_size")


def _parents(level: DataFrame) -> DataFrame:
    """The next level: first rows of runs, hashed with their leads. A group's only node stays as it is."""
    whole = F.when(F.col("n") > 1, digest(F.col("digest"), F.col("right"))).otherwise(F.col("digest"))
    first = level.filter(F.col("i").bitwiseAND(RUN - 1) == 0)
    return first.select("g", F.col("run").alias("i"), F.shiftright(F.col("n") + RUN - 1, BITS).alias("n"), whole.alias("digest"))


class Tree:
    """The levels above ``leaves`` (``g, i, n, digest``), written one after another."""

    def __init__(self, scratch: common.Scratch, leaves: DataFrame, name: str):
        self.leaves, self.levels = leaves, []
        most = leaves.agg(F.max("n").alias("n")).first().n or 1
        nodes = scratch.save(_parents(_siblings(leaves.select("g", "i", "n", "digest"))), f"{name}1")
        while (most := -(-most // RUN)) > 1:
            self.levels.append(scratch.save(_siblings(nodes), f"{name}{len(self.levels) + 1}siblings"))
            nodes = scratch.save(_parents(self.levels[-1]), f"{name}{len(self.levels) + 1}")
        #: one row per group: ``g``, ``digest``
        self.tops = nodes.select("g", "digest")

    def paths(self, above: DataFrame) -> DataFrame:
        """The leaves with their ``path`` of siblings up to the top, then that of ``above`` (``g, path`` and what goes along)."""
        carried = [c for c in above.columns if c not in ("g", "path")]
        up = above.withColumn("run", F.lit(0).cast("long"))
        for level in [*reversed(self.levels), _siblings(self.leaves)]:
            own = F.when(F.col("n") > 1, F.array(F.struct("left", "right"))).otherwise(F.array().cast("array<struct<left:string,right:string>>"))
            joined = level.join(up, ["g", "run"]).withColumn("path", F.concat(own, "path"))
            up = joined.select("g", F.col("i").alias("run"), "path", *carried)
        return joined.drop("left", "right", "run")


def manifest(spark: SparkSession, docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", seen: Column | None = None) -> DataFrame:
    """Each row's ``order`` column, ``place`` in its group, ``leaf``, ``path`` of siblings, ``subroot`` and ``root``.

    ``seen`` is the leaf of the row as somebody else holds it, to be folded along the path; by default its own.
    """
    scratch = common.Scratch(spark, "merkle")
    own = leaf([F.col(f) for f in fields])
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = scratch.save(docs.select(key.alias("g"), F.col(order).alias("id"), own.alias("digest"), (own if seen is None else seen).alias("seen")), "leaves")
    leaves = scratch.save(placed(scratch, rows, ["id", "digest", "seen"], "ranges"), "placed")
    scratch.drop("leaves")
    scratch.drop("ranges")
    inner = Tree(scratch, leaves, "level")
    groups = inner.tops.select(F.lit("").alias("g"), F.col("g").alias("key"), "digest")
    outer = Tree(scratch, scratch.save(placed(scratch, groups, ["key"], "groups"), "subroots"), "upper")
    empty = F.array().cast("array<struct<left:string,right:string>>")
    above = outer.paths(outer.tops.select("g", empty.alias("path"), F.col("digest").alias("root")))
    above = above.select(F.col("key").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    found = inner.paths(scratch.save(above, "above"))
    return found.select(F.col("id").alias(order), F.col("i").alias("place"), F.col("digest").alias("leaf"), "seen", "path", "subroot", "root")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = [F.when(hit, text).otherwise(F.col("text")) if f == "text" else F.col(f) for f in FIELDS]
    found = manifest(spark, common.documents(spark, sf_dir), seen=leaf(tampered))
    folded = found.withColumn("folded_root", fold(F.col("path"), F.col("seen")))
    return folded.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _levels(name: str, nodes: str, count: int) -> str:
    """SQL of ``count`` levels above the table ``nodes`` (g, i, n, h): siblings of each, tables name0 to name{count}."""
    sql = f"{name}0 AS (SELECT g, i, n, h FROM {nodes})"
    for k in range(count):
        sql += f""",
{name}{k}s AS (SELECT g, i, n, h,
  COALESCE(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  COALESCE(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k}),
{name}{k + 1} AS (SELECT g, i // 16 AS i, any_value((n + 15) // 16) AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
  FROM {name}{k} GROUP BY g, i // 16)"""
    return sql


def _folds(start: str, name: str, count: int, label: str) -> str:
    """SQL that folds the table ``start`` (doc, g, i, cur, proof) through the levels of ``name``."""
    sql, source = "", start
    for k in range(count):
        sql += f""",
{label}{k} AS (SELECT p.row, p.g, p.i // 16 AS i, CASE WHEN s.n > 1 THEN sha256(s.l || p.cur || s.r) ELSE p.cur END AS cur,
  CASE WHEN s.n > 1 THEN p.proof || s.l || s.r ELSE p.proof END AS proof
  FROM {source} p JOIN {name}{k}s s ON p.g = s.g AND p.i = s.i)"""
        source = f"{label}{k}"
    return sql


_FIELD = "COALESCE(strlen({0})::VARCHAR || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f"({f}::VARCHAR)") for f in FIELDS[:-1]) + " || " + _FIELD.format("{0}") + ")"
#: Enough for 16^5 documents of a source and 16^3 sources.
OP13_SQL = f"""WITH crc AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS c FROM range(256) x(b))),
rows AS (SELECT row_number() OVER () AS row, doc_id, COALESCE('=' || source, '') AS g, {_LEAF.format("text")} AS leaf, {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lower,
  xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) AS crc
  FROM documents, crc),
leaves AS (SELECT row, doc_id, g, leaf AS h, CASE WHEN crc % 5 = 0 THEN lower ELSE leaf END AS seen,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM rows),
{_levels("a", "leaves", 5)},
subs AS (SELECT '' AS g, g AS source, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM a5),
{_levels("b", "subs", 3)},
start AS (SELECT row, g, i, seen AS cur, '' AS proof FROM leaves){_folds("start", "a", 5, "p")},
middle AS (SELECT p.row, '' AS g, s.i, p.cur, p.proof FROM p4 p JOIN subs s ON p.g = s.source){_folds("middle", "b", 3, "q")}
SELECT l.doc_id, l.h AS leaf, a5.h AS subroot, b3.h AS root, sha256(q.proof) AS proof_sha256, q.cur AS folded_root, q.cur = b3.h AS verified
FROM leaves l JOIN q2 q ON l.row = q.row JOIN a5 ON l.g = a5.g CROSS JOIN b3"""
