"""Near copies by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of ``shingle`` words (A-Z in lower case; a shorter
text has its whole sequence as the only one). Equal sets are merged first, so a group of copies costs
one row. A sketch has 128 coordinates: in round i every shingle is placed in a hashed bin
with a value between i and i+1, in later rounds in bin i-128, so every coordinate is filled
and the first rounds decide nearly all. Bands of four coordinates bring documents together;
two of similarity 0.8 share none of the 32 bands with a chance of 5e-8.

Within a band the members are compared with one centre, then with a second one. What then
lies in different components is compared completely: pair by pair in small bands, blocks of
queries against blocks of members in large ones. Every link is confirmed on the full sets, whose
hashes come from a second function: texts that one function confuses are told apart by the other.
Sets count as equal where their sizes and sums of mixed hashes by both functions agree.
Components come from repeated hooking to the smallest neighbour and pointer jumping.

Full sets are made for the documents that share a band: texts and wanted ids meet in one
shuffle by id at every size of the corpus.

Texts without words and null texts have an empty set and are linked with nothing. Rows that
repeat a ``doc_id`` are one document; rows without one are never linked and stay. Equal texts
are linked, and the smallest id of a tie stands for its group. An empty table gives an empty
result. Long texts are taken whole: a worker holds one text's words at a time, and blocks are
bounded by the hashes they hold, or one text where that alone is longer. Extra columns are
ignored, and kept by ``keep_first``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZE, BAND = 128, 4
#: Words of a shingle unless a caller says otherwise, and the limit of resemblance.
SHINGLE, PERCENT = 5, 80
#: Pairs whose 8-bit sketches agree in fewer coordinates are not verified: at a similarity
#: of 0.8 fewer than 74 of 128 agree with a chance below 1e-8.
LEAST_EQUAL = 74
#: Bands of up to FEW members are compared pair by pair, larger ones in blocks of members and
#: queries; a block is split by its documents and by its shingles.
FEW, BLOCK, QUERIES = 64, 512, 1024
BLOCK_SHINGLES, COLUMNS = 1 << 18, 1024
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def fast_sketches(value: np.ndarray, row: np.ndarray, rows: int, size: int = SIZE) -> np.ndarray:
    """rows x size coordinates; those of rows without shingles stay at the largest number."""
    table = np.full(rows * size, _NONE)
    for i in range(2 * size):
        if not len(value):
            break
        h = common.mix(value + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = (h % np.uint64(size)).astype(np.int64) if i < size else np.full(len(h), i - size)
        np.minimum.at(table, row * size + place, (np.uint64(i) << np.uint64(56)) | (h >> np.uint64(8)))
        open_rows = (table.reshape(rows, size) == _NONE).any(1)
        more = open_rows[row]
        value, row = value[more], row[more]
    return table.reshape(rows, size)


def _sums(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    ends = np.concatenate([[0], np.cumsum(count)])
    return total[ends[1:]] - total[ends[:-1]]


def sketched(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles``, two 64-bit keys of the set, ``bands`` and the 8-bit sketch ``small``."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text"):
                words = common.Words(part.column("text"), lower=True)
                value, row = words.shingles(shingle)
                at = common.distinct_places(value, row)
                value, row, other = value[at], row[at], words.shingles(shingle, check=True)[0][at]
                count = np.bincount(row, minlength=words.rows)
                table = fast_sketches(value, row, len(count))
                bands = np.zeros((len(count), SIZE // BAND), np.uint64)
                for j in range(BAND):
                    bands = (bands + table[:, j::BAND]) * common._BASE
                bands = common.mix(bands + np.arange(SIZE // BAND, dtype=np.uint64))
                full = count > 0
                size = np.where(full, SIZE // BAND, 0)
                small = (common.mix(table) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(count.astype(np.int64)),
                        pa.array(common.signed(_sums(common.mix(value), count))),
                        pa.array(common.signed(_sums(common.mix(other), count))),
                        common.lists(common.signed(bands[full].reshape(-1)), size, pa.int64()),
                        common.blobs(small[full].reshape(-1), np.where(full, SIZE, 0)),
                    ],
                    ["doc_id", "n_shingles", "key_a", "key_b", "bands", "small"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, small binary")


def full_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``id`` and ``shingles``, all hashes of the set, by a function that the sketches do not use."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text"):
                words = common.Words(part.column("text"), lower=True)
                value, row = common.distinct_by_row(*words.shingles(shingle, check=True))
                count = np.bincount(row, minlength=words.rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), common.lists(common.signed(value), count, pa.int64())], ["id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, shingles array<long>")


def _close(pairs: DataFrame) -> DataFrame:
    """Pairs whose set sizes and 8-bit sketches allow a link."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(common.utf8(batch.column(c))[0].tobytes(), np.uint8).reshape(-1, SIZE) for c in ("small_a", "small_b"))
            keep = pa.array((a == b).sum(1) >= LEAST_EQUAL)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    fits = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return pairs.filter(fits & (F.col("a") != F.col("b"))).select("a", "b", "small_a", "small_b").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""
    left = sets.withColumnsRenamed({"id": "a", "shingles": "set_a"})
    right = sets.withColumnsRenamed({"id": "b", "shingles": "set_b"})
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= PERCENT * union).select("a", "b").distinct()


def _links(key, members: pa.Table, queries: pa.Table) -> pa.Table:
    """Links of a block of queries to a block of members, one per pair of components at least.

    Intersections are counted by products of 0/1 matrices over the shingles both sides have.
    """
    sides = []
    for side in (members, queries):
        shingles = side.column("shingles").combine_chunks()
        sides.append((side.column("id").to_numpy(), side.column("comp").to_numpy(), np.diff(shingles.offsets.to_numpy()), shingles.flatten().to_numpy()))
    (ids_m, comp_m, n_m, flat_m), (ids_q, comp_q, n_q, flat_q) = sides
    column = np.intersect1d(flat_m, flat_q)
    both = np.zeros((len(ids_q), len(ids_m)), np.float32)
    cells = []  # of each side, ascending by column: which rows hold which shared shingle
    for flat, n in ((flat_m, n_m), (flat_q, n_q)):
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        at = np.minimum(np.searchsorted(column, flat), max(0, len(column) - 1))
        shared = column[at] == flat if len(column) else np.zeros(len(flat), bool)
        at, row = at[shared].astype(np.int32), row[shared]
        order = np.argsort(at, kind="stable")
        cells.append((at[order], row[order], len(n)))
    for a in range(0, len(column), COLUMNS):
        part = []
        for at, row, n in cells:
            low, high = np.searchsorted(at, [a, a + COLUMNS])
            dense = np.zeros((n, COLUMNS), np.float32)
            dense[row[low:high], at[low:high] - a] = 1
            part.append(dense)
        both += part[1] @ part[0].T
    union = n_q[:, None] + n_m[None, :] - both
    q, m = np.nonzero((100 * both >= PERCENT * union) & (comp_q[:, None] != comp_m[None, :]))
    pair = np.stack([np.minimum(comp_q[q], comp_m[m]), np.maximum(comp_q[q], comp_m[m])])
    _, first = np.unique(pair, axis=1, return_index=True)
    a, b = ids_q[q[first]], ids_m[m[first]]
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _in_blocks(scratch: common.Scratch, left: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components inside large bands, without making their pairs.

    A band's family is its largest component. Whoever shares such a band without belonging
    to the family is a query; queries meet all members of the family, and one another, block
    by block. Both sides of a block are bounded, however large the band.
    """
    sizes = left.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("family"))
    belongs = scratch.save(left.join(sizes, "band").select("family", "id", "comp", "n").distinct(), "families")
    stranger = F.col("comp") != F.col("family")
    part_of = lambda most, n, total: F.greatest(F.ceil(n / most), F.ceil(total / BLOCK_SHINGLES))
    many = belongs.groupBy("family").agg(
        part_of(BLOCK, F.count("*"), F.sum("n")).alias("blocks"),
        part_of(QUERIES, F.count_if(stranger), F.sum(F.when(stranger, F.col("n")).otherwise(0))).alias("turns"),
    )
    dealt = belongs.drop("n").join(many, "family").join(sets, "id")
    last = lambda c: F.sequence(F.lit(0), F.col(c).cast("int") - 1)
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    columns = ["family", "block", "turn", "id", "comp", "shingles"]
    members = dealt.withColumn("block", part("blocks")).withColumn("turn", F.explode(last("turns"))).select(*columns)
    queries = dealt.filter("comp != family").withColumn("turn", part("turns")).withColumn("block", F.explode(last("blocks"))).select(*[F.col(c).alias(f"{c}_q") for c in columns]).toDF(*columns)
    cell = ["family", "block", "turn"]
    return members.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(_links, "a long, b long")


class Components:
    """``table`` (id, comp): the smallest id reachable over the links added so far."""

    def __init__(self, scratch: common.Scratch, ids: DataFrame):
        self.scratch, self.step = scratch, 0
        self.table, self.name = self._save(ids.select("id", F.col("id").alias("comp")))

    def _save(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.step += 1
        name = f"component{self.step}"
        return self.scratch.save(df, name), name

    def mapped(self, pairs: DataFrame) -> DataFrame:
        """Pairs of components that pairs of ids connect."""
        a = self.table.withColumnsRenamed({"id": "a", "comp": "comp_a"})
        b = self.table.withColumnsRenamed({"id": "b", "comp": "comp_b"})
        return pairs.join(a, "a").join(b, "b").filter("comp_a != comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct()

    def add(self, links: DataFrame) -> None:
        """Adds pairs of ids; every table of a round is written, so that no plan grows with the rounds."""
        edges, old = self._save(self.mapped(links))
        used, total = [old], None
        while not edges.isEmpty():
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            up, old = self._save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("up")))
            used.append(old)
            while True:  # every id jumps to where its target points
                higher = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
                jumped, old = self._save(up.join(higher, "up", "left").select("id", F.coalesce("top", "up").alias("next"), "up"))
                used.append(old)
                settled = jumped.filter("next != up").isEmpty()
                up = jumped.select("id", F.col("next").alias("up"))
                if settled:
                    break
            a, b = up.withColumnsRenamed({"id": "a", "up": "up_a"}), up.withColumnsRenamed({"id": "b", "up": "up_b"})
            linked = edges.join(a, "a").join(b, "b").filter("up_a != up_b")
            edges, old = self._save(linked.select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct())
            used.append(old)
            if total is not None:
                higher = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
                up, old = self._save(total.join(higher, "up", "left").select("id", F.coalesce("top", "up").alias("up")))
                used.append(old)
            total = up
        if total is not None:
            joined = self.table.join(total.select(F.col("id").alias("comp"), F.col("up").alias("top")), "comp", "left")
            table, name = self._save(joined.select("id", F.coalesce("top", "comp").alias("comp")))
            used.append(self.name)
            self.table, self.name = table, name
        for name in used:
            self.scratch.drop(name)


def components(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``."""
    scratch = common.Scratch(spark, "near")
    light = scratch.save(sketched(docs, shingle), "sketches")
    keyed = ["key_a", "key_b", "n_shingles"]
    own = light.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    distinct = own.groupBy(*keyed).agg(F.min(F.struct("doc_id", "bands", "small")).alias("m"))
    distinct = scratch.save(distinct.select(*keyed, F.col("m.doc_id").alias("id"), "m.bands", "m.small"), "distinct")

    spread = distinct.select("id", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    member = spread.join(shared, "band")
    about = distinct.select("id", F.col("n_shingles").alias("n"), "small")
    buckets = scratch.save(member.join(about, "id"), "buckets")

    ids = buckets.select("id").distinct()
    found = Components(scratch, ids)
    # the ids are the side that is hashed, so texts are shuffled once and not sorted
    wanted = ids.withColumnRenamed("id", "doc_id").hint("shuffle_hash")
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    sets = scratch.save(full_sets(texts, shingle), "sets")

    def to_centre(order) -> DataFrame:
        """Members of a band against its first one in ``order``, where components differ."""
        here = buckets.join(found.table, "id")
        centre = here.groupBy("band").agg(F.min(F.struct(order.alias("o"), "id", "n", "small", "comp")).alias("c"))
        pairs = here.join(centre, "band").filter("comp != c.comp")
        return pairs.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b"), F.col("n").alias("n_a"), F.col("c.n").alias("n_b"), F.col("small").alias("small_a"), F.col("c.small").alias("small_b"))

    for turn, order in enumerate((F.col("id"), F.xxhash64("id"))):
        close = scratch.save(_close(to_centre(order)), f"close{turn}")
        found.add(verified(close, sets))
        scratch.drop(f"close{turn}")
    # what is left: members of one band in different components
    here = buckets.join(found.table, "id")
    mixed = here.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")).filter("low != high")
    left = scratch.save(here.join(mixed.select("band", "members"), "band"), "left")
    scratch.drop("buckets")
    few = left.filter(F.col("members") <= FEW)
    other = few.select("band", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "small", "comp")])
    rest = few.join(other, "band").filter((F.col("id") < F.col("id_b")) & (F.col("comp") != F.col("comp_b")))
    rest = rest.select(F.col("id").alias("a"), F.col("id_b").alias("b"), F.col("n").alias("n_a"), "n_b", F.col("small").alias("small_a"), F.col("small_b"))
    close = scratch.save(_close(rest), "close")
    found.add(verified(close, sets).union(_in_blocks(scratch, left.filter(F.col("members") > FEW), sets)))
    for name in ("left", "families", "close", "sets"):
        scratch.drop(name)

    placed = distinct.select(*keyed, "id").join(found.table, "id", "left").select(*keyed, F.coalesce("comp", "id").alias("comp"))
    labelled = light.select("doc_id", *keyed).join(placed, keyed, "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("comp")).otherwise(F.col("doc_id"))
    return labelled.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that a near copy with a smaller id stands for."""
    dropped = components(spark, docs, shingle).filter(~F.col("kept")).select("doc_id").hint("shuffle_hash")
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, common.documents(spark, sf_dir), shingle=2)
