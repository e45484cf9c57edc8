"""Substring dedup over a log-structured fingerprint index.

Every window of 20 words has a fingerprint: the smallest hash of its 15 six-word grams. Equal
windows have equal fingerprints, and neighbouring windows mostly share one, so a document
adds about one fingerprint per eight words. The index keeps immutable runs of fingerprints
with the document each was first seen in, as tables bucketed and sorted by fingerprint: a new
batch is shuffled to the same buckets and merge-joined with every run, which itself is not
moved. Fingerprints not met before form a new run; more than ``MOST_RUNS`` runs are compacted
into one. Documents that share a fingerprint with another one, and the
document in which it was first seen, are to be examined; their windows are made once, however
many batches asked for it, meet by hash in a streaming merge with the runs of windows examined
earlier, and yield the places to remove.

Windows are told apart by 95 bits: 64 made of the words' XXH3 hashes and 31 of their XXH64 hashes, two
functions without a common structure. The words themselves are not carried along to be compared. Of equal windows that meet in
one slice of a task all but the first are repeats whatever the rest holds; only the first goes
on, so a passage that stands in a third of all documents is a few rows of a merge.

``doc_id`` orders the documents and names them: rows that repeat an id repeat the document.
Rows without an id are returned whole. Null text has no words. Texts below 20 words keep all.
Equal texts keep their words in the smallest id only. An empty table gives an empty result.
Long texts are taken whole. Extra columns are ignored. Merges stream over sorted rows and hold
one row, so the size of a group of equal windows does not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 20, 6
MOST_RUNS = 3
#: Batches that the query adds one after another.
BATCHES = 5
NEW, KNOWN = 0, 2
_STATE = "fp long, doc_id long, old long, fresh boolean, again boolean"


def _sum_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words of hashes ``h``, across rows too."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out += h[j : j + size] * common._powers(n + 1)[j + 1]
    return common.mix(out)


class Windows:
    """Places (index of the first word) of all whole windows of some texts, and their fingerprints."""

    def __init__(self, words: common.Words):
        n = len(words.start)
        self.hash = words.hash
        self.grams = _sum_of(self.hash, GRAM)
        if n < WINDOW:
            self.place, self.print = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            self.low = self.print
            return
        low = self.grams
        for step in (1, 2, 4, WINDOW - GRAM + 1 - 8):
            low = np.minimum(low[:-step], low[step:])
        self.low = low
        self.whole = words.row[: n - WINDOW + 1] == words.row[WINDOW - 1 :]
        self.place = np.flatnonzero(self.whole)
        self.print = low[self.place]

    def chosen(self) -> np.ndarray:
        """Gram places that are the smallest of some whole window."""
        if not len(self.place):
            return self.place
        span = WINDOW - GRAM + 1
        high = np.where(self.whole, self.low, np.uint64(0))
        high = np.concatenate([np.zeros(span - 1, np.uint64), high, np.zeros(span - 1, np.uint64)])
        for step in (1, 2, 4, span - 8):
            high = np.maximum(high[:-step], high[step:])
        return np.flatnonzero(self.grams == high)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``fp, doc_id, n``: fingerprints of each document and how often its gram is chosen (2: more than once)."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text"):
                words = common.Words(part.column("text"))
                windows = Windows(words)
                at = windows.chosen()
                fp, row = windows.grams[at], words.row[at]
                order = np.lexsort((fp, row))
                fp, row = fp[order], row[order]
                first = np.ones(len(fp), bool)
                first[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
                place = np.flatnonzero(first)
                n = np.minimum(2, np.diff(np.append(place, len(fp))))
                doc = part.column("doc_id").cast(pa.int64()).take(pa.array(row[place]))
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(fp[place])), doc, pa.array(n, pa.int32())], ["fp", "doc_id", "n"])

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "fp long, doc_id long, n int")


def _removals(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Starts of windows to remove: rows without ``wh``."""
    return pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int64()), pa.array(doc), pa.array(place)], ["wh", "doc_id", "place"])


def windows_of(texts: DataFrame) -> DataFrame:
    """``wh, doc_id, place`` of the windows whose fingerprint is in ``fps``.

    ``place`` holds 31 check bits below. Rows without ``wh`` are repeats within a slice, by their start alone.
    """

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text"):
                words = common.Words(part.column("text"))
                windows = Windows(words)
                wanted = part.column("fps")
                count = np.diff(wanted.offsets.to_numpy())
                fps, row = wanted.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(words.rows), count)
                mine = np.isin(common.mix(windows.print) + words.row[windows.place].astype(np.uint64), common.mix(fps) + row.astype(np.uint64))
                at = windows.place[mine]
                wh = common.signed(_sum_of(windows.hash, WINDOW)[at])
                check = (_sum_of(words.check, WINDOW)[at] >> np.uint64(33)).astype(np.int64)
                place = (at - words.first[words.row[at]]) << 32 | check
                doc = part.column("doc_id").cast(pa.int64()).to_numpy()[words.row[at]]
                order = np.lexsort((place, doc, check, wh))
                wh, check, doc, place = wh[order], check[order], doc[order], place[order]
                first = np.append(True, (wh[1:] != wh[:-1]) | (check[1:] != check[:-1]))[: len(wh)]
                yield pa.RecordBatch.from_arrays([pa.array(wh[first]), pa.array(doc[first]), pa.array(place[first])], ["wh", "doc_id", "place"])
                # a repeated row is no repeat of the same place
                group = np.cumsum(first) - 1
                again = ~first & ((doc != doc[first][group]) | (place != place[first][group])) if len(wh) else first
                if again.any():
                    yield _removals(doc[again], place[again] >> 32)

    return texts.select("doc_id", "text", "fps").mapInArrow(run, "wh long, doc_id long, place long")


def _repeats(rows: DataFrame, keep_run: bool) -> DataFrame:
    """Merges sorted windows: places to remove and the rows of a new run."""

    def run(batches):
        first = None
        for batch in batches:
            done = batch.column("wh").is_null()
            if pc.any(done).as_py():
                yield batch.filter(done).select(["wh", "doc_id", "place"])
                batch = batch.filter(pc.invert(done))
            if not batch.num_rows:
                continue
            wh, doc, place, state = (batch.column(c).to_numpy() for c in ("wh", "doc_id", "place", "state"))
            opens = np.ones(len(wh), bool)
            opens[1:] = wh[1:] != wh[:-1]
            if first is not None and wh[0] == first[0]:
                opens[0] = False
            starts = np.flatnonzero(opens)
            group = np.cumsum(opens) - 1
            _, doc_before, place_before = first or (0, 0, 0)  # opens the group that the last batch left open
            doc_0 = np.append(doc_before, doc[starts])[group + 1]
            place_0 = np.append(place_before, place[starts])[group + 1]
            again = ~opens & (state == NEW) & ((place ^ place_0) & 0xFFFFFFFF == 0) & ((doc != doc_0) | (place != place_0))
            if len(starts):
                i = starts[-1]
                first = (wh[i], doc[i], place[i])
            found = np.flatnonzero(again)
            if keep_run:
                fresh = starts[state[starts] != KNOWN]
                yield pa.RecordBatch.from_arrays([pa.array(wh[fresh]), pa.array(doc[fresh]), pa.array(place[fresh])], ["wh", "doc_id", "place"])
            yield _removals(doc[found], place[found] >> 32)

    spread = F.coalesce("wh", F.xxhash64("doc_id"))
    ordered = rows.repartition(spread).sortWithinPartitions("wh", F.col("state").desc(), "doc_id", "place")
    return ordered.mapInArrow(run, "wh long, doc_id long, place long")


class SubstringIndex:
    """Fingerprints of all documents added so far, and windows of those examined, as runs in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.scratch = spark, common.Scratch(spark, "substrings")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prints: list[str] = []
        self.windows: list[str] = []
        self.pending: list[DataFrame] = []
        self.step = self.compactions = 0

    def _path(self, name: str) -> str:
        return f"{self.scratch.root}/{name}"

    def _write(self, df: DataFrame, key: str, kind: str) -> str:
        """A table of ``buckets`` buckets, each sorted by ``key``; its name.

        ``df`` comes from a shuffle by ``key``, so every bucket is written by one task.
        """
        self.step += 1
        name = f"{self.scratch.root.rsplit('/', 1)[1]}_{kind}{self.step}".replace("-", "_")
        df.write.bucketBy(self.buckets, key).sortBy(key).option("path", self._path(name)).option("compression", "zstd").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def _runs(self, names: list[str], kind: str) -> list[DataFrame]:
        return [self.spark.table(n).filter("fresh").drop("fresh") for n in names] if kind == "prints" else [self.spark.table(n) for n in names]

    def add(self, docs: DataFrame) -> None:
        """Indexes ``docs`` as the next batch; what they repeat is told by ``resolve``."""
        name = f"batch{self.step}"
        rows = self.scratch.save(fingerprints(docs), name)
        state = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n"))
        olds = []
        for i, run in enumerate(self._runs(self.prints, "prints")):
            state = state.join(run.select("fp", F.col("doc_id").alias(f"old{i}")), "fp", "left")
            olds.append(F.col(f"old{i}"))
        old = F.least(*olds) if len(olds) > 1 else olds[0] if olds else F.lit(None).cast("long")
        table = self._write(state.select("fp", "doc_id", old.alias("old"), old.isNull().alias("fresh"), (F.col("n") > 1).alias("again")), "fp", "prints")
        # read without its buckets, so that a fingerprint of very many documents can be split
        met = self.spark.read.schema(_STATE).parquet(self._path(table)).filter("NOT fresh OR again").select("fp", "old")
        examine = rows.select("doc_id", "fp").join(met.select("fp"), "fp").select("doc_id", "fp")
        examine = examine.union(met.filter("old IS NOT NULL").select(F.col("old").alias("doc_id"), "fp"))
        self.pending.append(self.scratch.save(examine, f"examine{self.step}"))
        self.scratch.drop(name)
        self.prints.append(table)
        if len(self.prints) > MOST_RUNS:
            self.compact()
        del rows, state, met, examine
        self.scratch.release()

    def resolve(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """``doc_id, places``: starts of the windows that stand earlier, of all documents added since the last call.

        ``docs`` holds every document added so far; each text is read once. Without ``keep``
        nothing can be added afterwards, and no run of windows is left.
        """
        self.step += 1
        step, wanted = self.step, None
        for rows in self.pending:
            wanted = rows if wanted is None else wanted.union(rows)
        if wanted is None:
            return self.spark.createDataFrame([], "doc_id long, places array<long>")
        if not keep:
            while self.prints:
                self._drop(self.prints.pop())
        lists = wanted.groupBy("doc_id").agg(F.collect_set("fp").alias("fps")).hint("shuffle_hash")
        found = windows_of(docs.select("doc_id", "text").join(lists, "doc_id")).withColumn("state", F.lit(NEW))
        for run in self._runs(self.windows, "windows"):
            found = found.union(run.select("wh", "doc_id", "place", F.lit(KNOWN)))
        repeats = self.scratch.save(_repeats(found, keep_run=keep), f"repeats{step}")
        self.pending = []
        if keep:
            fresh = repeats.filter("wh IS NOT NULL").select("wh", "doc_id", "place")
            self.windows.append(self._write(fresh.repartition(self.buckets, "wh"), "wh", "windows"))
            if len(self.windows) > MOST_RUNS:
                self.compact()
        del found, lists, wanted
        self.scratch.release()
        return repeats.filter("wh IS NULL").groupBy("doc_id").agg(F.collect_list("place").alias("places"))

    def close(self) -> None:
        """Deletes the runs; what ``resolve`` returned stays readable."""
        for name in [*self.prints, *self.windows]:
            self._drop(name)
        self.prints, self.windows = [], []

    def compact(self) -> None:
        """Merges the runs of a kind that has too many into one."""
        self.compactions += 1
        if len(self.prints) > MOST_RUNS:
            every = self._runs(self.prints, "prints")
            one = every[0].select("fp", "doc_id")
            for run in every[1:]:  # runs share no fingerprint
                one = one.union(run.select("fp", "doc_id"))
            one = one.select("fp", "doc_id", F.lit(None).cast("long").alias("old"), F.lit(True).alias("fresh"), F.lit(False).alias("again"))
            self.prints = self._replaced(self.prints, one.repartition(self.buckets, "fp"), "fp", "prints")
        if len(self.windows) > MOST_RUNS:
            every = self._runs(self.windows, "windows")
            one = every[0]
            for run in every[1:]:
                one = one.union(run)
            first = one.groupBy("wh").agg(F.min(F.struct("doc_id", "place")).alias("m")).select("wh", "m.doc_id", "m.place")
            self.windows = self._replaced(self.windows, first, "wh", "windows")

    def _replaced(self, names: list[str], one: DataFrame, key: str, kind: str) -> list[str]:
        table = self._write(one, key, kind)
        for name in names:
            self._drop(name)
        return [table]


def without(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256``: texts without the words of the given windows."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text"):
                words = common.Words(part.column("text"))
                n = len(words.start)
                change = np.zeros(n + 1, np.int64)
                places = pc.fill_null(part.column("places"), pa.scalar([], pa.list_(pa.int64())))
                row = np.repeat(np.arange(words.rows), pc.list_value_length(places).to_numpy())
                at = places.flatten().to_numpy()
                inside = at + WINDOW <= words.count[row]
                at = words.first[row[inside]] + at[inside]
                change += np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + WINDOW, minlength=n + 1)[: n + 1]
                gone = np.cumsum(change)[:n] > 0
                removed = np.bincount(words.row[gone], minlength=words.rows)
                start, end, row = words.start[~gone], words.end[~gone], words.row[~gone]
                span = np.zeros(len(words.data) + 1, np.int64)
                blank = end < words.offsets[row + 1]  # the byte after a word that does not close its text
                span[start] += 1
                np.add.at(span, end + blank, -1)
                mask = np.cumsum(span)[:-1] > 0
                data = words.data.copy()
                data[end[blank]] = 0x20
                cuts = np.concatenate([[0], np.cumsum(mask)])[words.offsets]
                flat = data[mask].tobytes()
                kept = [flat[a:b].removesuffix(b" ") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(words.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([k.decode() for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    texts = docs.select("doc_id", "text").join(places, "doc_id", "left")
    return texts.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def deduplicated(spark: SparkSession, docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """All of ``docs``, added to an index in ``batches`` ranges of ascending ids."""
    index, cuts = SubstringIndex(spark), []
    if batches > 1:
        share = [i / batches for i in range(1, batches)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", share, 10_000).alias("c")).first().c or []))
    at = F.col("doc_id")
    for i in range(len(cuts) + 1):
        index.add(docs.filter((at > cuts[i - 1]) if i else F.lit(True)).filter((at <= cuts[i]) if i < len(cuts) else F.lit(True)))
    places = index.resolve(docs, keep=False)
    index.close()
    index.scratch.release()  # once more: the end of the last step has been reported by now
    return without(docs, places)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark, common.documents(spark, sf_dir)).drop("kept")
