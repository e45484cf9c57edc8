"""Ranked lexical search: exact inner products over sparse ball trees.

A document is a sparse vector of term impacts, an item one of term weights, its score their inner product.
Items are taken in blocks of about ``ITEM_BYTES`` of text, so that a block's vocabulary and weights have a
bound and can go to every task. For a block every document becomes its vector over the block's vocabulary,
once, in a written table; document frequencies are counted from there.

A task gathers vectors into blocks and builds a ball tree over each: nodes are split at the median along
the line between two far members, and keep their centroid and radius. A node's members score at most the
product of the item with the centroid plus the item's norm times the radius; radii and bounds are raised by
more than the rounding of doubles can take away. Each item visits nodes best first and stops below its
``top``-th score so far; leaves are scored exactly in 64-bit integers. Vectors are scaled by the square
root of the weight on both sides, which leaves products as they are. Thresholds start at the ``top``-th
score over a 64th of the documents, below which nothing can rank, so a task sends few rows however many
tasks there are.

Every document with a term counts for the statistics, repeated rows too, and every row is ranked; equal
scores go by ascending ``doc_id``, rows without an id last. Of rows that repeat an ``item_id`` the smallest
text is taken. Null and empty texts have no terms; an item without terms or matches has no rows. Empty
tables give an empty result. Long texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOP = 20
#: Text of the items that are searched together.
ITEM_BYTES = 1 << 20
#: Documents and entries of a tree, members of a leaf, and numbers in all centroids of a tree.
BLOCK, ENTRIES, LEAF, CELLS = 4096, 1 << 20, 64, 1 << 22
#: One document of so many is searched first, for a threshold.
SEED = 64
#: Bounds are raised by this part of themselves.
SAFE = 1e-9

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Terms:
    """The terms of some texts: ``row`` and ``code`` into ``distinct``; told apart by their bytes."""

    def __init__(self, column: pa.Array):
        data, offsets = common.utf8(column)
        solid = _TERM[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        opens = solid & (first[:-1] | ~np.append(False, solid[:-1])[: len(solid)])
        start = np.flatnonzero(opens)
        self.rows = len(offsets) - 1
        self.row = np.searchsorted(offsets, start, side="right") - 1
        flat = np.ascontiguousarray(common._LOWER[data[solid]])
        cuts = np.append(np.cumsum(solid)[start] - 1, len(flat)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
        coded = words.dictionary_encode()
        self.code, self.distinct = coded.indices.to_numpy(), coded.dictionary


class Items:
    """A block of items: ``ids``, the vocabulary, and each item's terms with their number in it."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("item_id").to_pylist()
        terms = Terms(table.column("text").combine_chunks())
        self.vocabulary = terms.distinct
        size = max(1, len(terms.distinct))
        key, self.times = np.unique(terms.row.astype(np.int64) * size + terms.code, return_counts=True)
        self.term = key % size
        self.first = np.searchsorted(key // size, np.arange(len(self.ids) + 1))
        self.weight = np.zeros(len(terms.distinct), np.int64)
        self.documents = self.terms = 0

    def weigh(self, documents: int, terms: int, frequency: np.ndarray) -> None:
        self.documents, self.terms = documents, terms
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)


def vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """``doc_id, n`` (terms with repeats), and ``ids``, ``tfs`` of the vocabulary's terms; documents with a term only."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for batch in batches:
            for part in common.pieces(batch, "text"):
                terms = Terms(part.column("text"))
                place = pc.fill_null(pc.index_in(terms.distinct, value_set=known), -1).to_numpy()[terms.code] if len(terms.code) else np.zeros(0, np.int32)
                n = np.bincount(terms.row, minlength=terms.rows)
                hit = place >= 0
                size = max(1, len(known))
                key, tf = np.unique(terms.row[hit].astype(np.int64) * size + place[hit], return_counts=True)
                length = np.bincount(key // size, minlength=terms.rows)
                some = pa.array(n > 0)
                ids, tfs = (common.lists(x.astype(np.int32), length, pa.int32()) for x in (key % size, tf))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), ids, tfs], ["doc_id", "n", "ids", "tfs"]).filter(some)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>")


def frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the vocabulary's ``size`` terms."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("ids").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "df"])

    rows = found.select("ids").mapInArrow(run, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("id").to_numpy()] = rows.column("df").to_numpy()
    return out


def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the given spans, and the span each is from."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which], which


class BallTree:
    """A balanced tree over sparse vectors, level by level; level 0 is the root."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int):
        cells = max(1, columns)
        depth = max(0, min(math.ceil(math.log2(max(1, rows / LEAF))), int(math.log2(max(1, CELLS / cells))) - 1))
        norm = np.bincount(row, value * value, rows)
        node = np.zeros(rows, np.int64)
        self.centroids, self.radii = [], []
        for level in range(depth + 1):
            nodes = 1 << level
            size = np.bincount(node, minlength=nodes)
            centroid = np.bincount(node[row] * cells + column, value, nodes * cells).reshape(nodes, cells) / np.maximum(size, 1)[:, None]
            apart = self._apart(row, column, value, norm, node, centroid)
            radius = np.zeros(nodes)
            np.maximum.at(radius, node, apart)
            # the distance comes from a difference of squares, whose rounding is a part of the squares
            largest = np.zeros(nodes)
            np.maximum.at(largest, node, norm)
            slack = (len(value) + 64) * 2.0**-52 * (largest + (centroid**2).sum(1))
            self.centroids.append(centroid)
            self.radii.append(np.sqrt(radius + slack) * (1 + SAFE))
            if level == depth:
                break
            far = self._members(row, column, value, node, apart, nodes, cells)
            other = self._members(row, column, value, node, self._apart(row, column, value, norm, node, far), nodes, cells)
            along = np.bincount(row, value * (far - other)[node[row], column], rows)
            order = np.lexsort((along, node))
            place = np.empty(rows, np.int64)
            place[order] = np.arange(rows)
            half = (place - (np.cumsum(size) - size)[node]) * 2 >= size[node]
            node = node * 2 + half
        self.leaf, self.depth = node, depth

    @staticmethod
    def _apart(row, column, value, norm, node, points) -> np.ndarray:
        """Squared distance of each row to its node's point."""
        square = (points**2).sum(1)
        return np.maximum(0, norm - 2 * np.bincount(row, value * points[node[row], column], len(norm)) + square[node])

    @staticmethod
    def _members(row, column, value, node, apart, nodes, cells) -> np.ndarray:
        """The vector of each node's farthest row."""
        order = np.lexsort((apart, node))
        last = np.searchsorted(node[order], np.arange(nodes), side="right") - 1
        chosen = np.zeros(len(node), bool)
        chosen[order[last[last >= 0]]] = True
        points = np.zeros((nodes, cells))
        mine = chosen[row]
        points[node[row[mine]], column[mine]] = value[mine]
        return points


class Search:
    """The best documents of each item over the blocks of vectors it is given."""

    def __init__(self, items: Items, floor: dict, top: int):
        self.items, self.top = items, top
        n = len(items.ids)
        #: scores that a document must reach to rank
        self.least = np.array([floor.get(i, 1) for i in items.ids], np.int64)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in range(n)]
        self.half = np.sqrt(items.weight)
        self.visited = self.leaves = 0

    def add(self, doc: np.ndarray, null: np.ndarray, n: np.ndarray, length: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        items = self.items
        m = 75 + (25 * n * items.documents) // items.terms
        row = np.repeat(np.arange(len(doc)), length)
        tf = tf.astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
        known, column = np.unique(term, return_inverse=True)
        tree = BallTree(row, column, impact * self.half[term], len(doc), len(known))
        # the items' terms that occur in the block
        at = np.minimum(np.searchsorted(known, items.term), max(0, len(known) - 1))
        here = known[at] == items.term if len(known) else np.zeros(len(items.term), bool)
        pair = np.flatnonzero(here)
        of = np.searchsorted(items.first, pair, side="right") - 1
        column_of, times = at[pair], items.times[pair]
        weight = times * items.weight[items.term[pair]]
        side = times * self.half[items.term[pair]]
        active, starts = np.unique(of, return_index=True)
        if not len(active):
            return
        ends = np.append(starts[1:], len(of))
        norm = np.sqrt(np.add.reduceat(side * side, starts))
        bounds = []
        for centroid, radius in zip(tree.centroids, tree.radii, strict=True):
            inner = np.add.reduceat(centroid[:, column_of] * side, starts, axis=1)
            bounds.append((inner + radius[:, None] * norm) * (1 + SAFE) + 1)
        # entries by leaf and column, to be found by the item's terms
        key = tree.leaf[row] * len(known) + column
        order = np.argsort(key, kind="stable")
        key, entry_row, entry_impact = key[order], row[order], impact[order]
        by_leaf = np.argsort(tree.leaf, kind="stable")
        local = np.empty(len(doc), np.int64)
        leaf_first = np.searchsorted(tree.leaf[by_leaf], np.arange((1 << tree.depth) + 1))
        local[by_leaf] = np.arange(len(doc)) - leaf_first[tree.leaf[by_leaf]]
        self.leaves += len(active) << tree.depth
        for k, item in enumerate(active.tolist()):
            terms = column_of[starts[k] : ends[k]]
            weights = weight[starts[k] : ends[k]]
            heap = [(-bounds[0][0, k], 0, 0)]
            while heap and -heap[0][0] >= self.least[item]:
                _, level, node = heapq.heappop(heap)
                if level < tree.depth:
                    for child in (2 * node, 2 * node + 1):
                        heapq.heappush(heap, (-bounds[level + 1][child, k], level + 1, child))
                    continue
                self.visited += 1
                members = by_leaf[leaf_first[node] : leaf_first[node + 1]]
                wanted = node * len(known) + terms
                place, which = _spans(np.searchsorted(key, wanted), np.searchsorted(key, wanted, side="right"))
                score = np.zeros(len(members), np.int64)
                np.add.at(score, local[entry_row[place]], entry_impact[place] * weights[which])
                good = score >= self.least[item]
                if good.any():
                    self._keep(item, score[good], null[members[good]], doc[members[good]])

    def _keep(self, item: int, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        score, null, doc = (np.concatenate([a, b]) for a, b in zip(self.best[item], (score, null, doc), strict=True))
        order = np.lexsort((doc, null, -score))[: self.top]
        self.best[item] = score[order], null[order], doc[order]
        if len(order) == self.top:
            self.least[item] = max(self.least[item], self.best[item][0][-1])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for item, (score, null, doc) in enumerate(self.best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item, np.int32)), pa.array(doc, mask=null), pa.array(score)], ["item", "doc_id", "score"])


def _searched(found: DataFrame, items: Items, floor: dict, top: int) -> DataFrame:
    """``item, doc_id, score``: each task's best documents."""
    shared = found.sparkSession.sparkContext.broadcast((items, floor))

    def run(batches):
        items, floor = shared.value
        search = Search(items, floor, top)
        held, rows, entries = [], 0, 0

        def block() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            null = table.column("doc_id").is_null().to_numpy()
            doc = pc.fill_null(table.column("doc_id"), 0).to_numpy()
            ids, tfs = (table.column(c).combine_chunks() for c in ("ids", "tfs"))
            length = pc.list_value_length(ids).to_numpy()
            search.add(doc, null, table.column("n").to_numpy(), length, ids.flatten().to_numpy(), tfs.flatten().to_numpy())

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK // 4):
                part = batch.slice(at, BLOCK // 4)
                held.append(part)
                rows, entries = rows + part.num_rows, entries + len(part.column("ids").flatten())
                if rows >= BLOCK or entries >= ENTRIES:
                    block()
                    held, rows, entries = [], 0, 0
        if held:
            block()
        yield from search.rows()

    return found.filter(F.size("ids") > 0).select("doc_id", "n", "ids", "tfs").mapInArrow(run, "item int, doc_id long, score long")


def _best(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item of ``items`` (``item_id, text``)."""
    scratch = common.Scratch(spark, "ranked")
    one = items.groupBy("item_id").agg(F.min("text").alias("text")).filter("text IS NOT NULL")
    size = one.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    blocks = -(-size // ITEM_BYTES)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        block = Items(one.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").toArrow())
        if not len(block.vocabulary):
            continue
        found = scratch.save(vectors(docs, block.vocabulary), f"vectors{b}")
        about = found.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        if not about.documents:
            break
        block.weigh(about.documents, about.terms, frequencies(found, len(block.vocabulary)))
        seeds = found.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED)) == 0)
        first = _best(_searched(seeds, block, {}, top), top).filter(F.col("rank") == top).select("item", "score").collect()  # one row per item
        floor = {block.ids[r.item]: r.score for r in first}
        names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
        best = scratch.save(_best(_searched(found, block, floor, top), top).join(names, "item").select("item_id", "rank", "doc_id", "score"), f"best{b}")
        scratch.drop(f"vectors{b}")
        out = out.union(best)
    return out


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP11_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM (SELECT row, doc_id, {_TERMS} AS term FROM docs) GROUP BY ALL),
lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, total),
scored AS (SELECT item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (row), total GROUP BY item_id, row, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""
