"""Quality rules: plain base counts, and bands of n-gram perplexity per language.

The model is an interpolated modified Kneser-Ney model of order 4 over characters (A-Z in lower case,
runs of white space as one space), one per language. Spark counts the n-grams of all texts: tasks send
distinct n-grams with counts, the lower orders' continuation counts, discounts and probabilities are
groupings and joins of the counted tables, from which no n-gram is left out. Characters keep the model
small however large the corpus. Up to ``ENTRIES`` distinct n-grams of the highest order, all of it is
broadcast, at most ``ENTRIES`` * 2 * ``ORDER`` * 12 bytes, 50 MB. Beyond that the most frequent ones are,
at most ``ENTRIES`` for all languages together, and tasks send on the others of each text, which are
joined with the table of all probabilities: the model and its results are the same, whatever is in
memory. N-grams in memory lie in arrays sorted by a 64-bit hash, which is a bijection of the packed n-gram.

A text's perplexity is per character. Bands are fences around the quartiles of the logarithm over all
documents of the language that pass the base rules: texts below the lower fence repeat what others
say, those above the upper one are no prose of the language. A language with fewer than ``LEAST_BAND``
such documents, or the width of whose quartiles says nothing, gets the least width ``LEAST_WIDTH``.

``lang`` is taken from the documents. The ``LANGS`` languages with most documents (ties by name) have a
model each; all others and rows without a language share one. Null and empty texts have no words and
fail. Rows that repeat an id are documents of their own. Long texts are read whole, some megabytes of
others beside them. An empty table gives an empty result. Extra columns are ignored by ``judged``
and stay in ``filtered``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 4
#: N-grams of each order that are held in memory, for all models together, and languages with a model of their own.
ENTRIES, LANGS = 1 << 19, 64
#: Distinct n-grams that a task holds before it sends them on.
HELD = 1 << 21
#: Words, and percent of words in repeated three-word windows, of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Fences: so many interquartile ranges below and above the quartiles, that range being at least LEAST_WIDTH.
BELOW, ABOVE, LEAST_WIDTH, LEAST_BAND = 6.0, 6.0, 0.05, 20
#: Symbols of rule-based quality counts.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: Stands before the first character of a text.
_START = 2
_BITS = np.uint64(16)


# ---- base counts --------------------------------------------------------------------


def _paired(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """One number per pair (a, b), equal for equal pairs; ``b`` is below ``most``."""
    if len(a) and int(a.max()) >= (1 << 62) // most:
        a = np.unique(a, return_inverse=True)[1]
    return a.astype(np.int64) * most + b


def repeated_words(words: common.Words) -> np.ndarray:
    """Words of each row that lie in three-word windows found twice or more in the row."""
    n, code, most = len(words.code), words.code.astype(np.int64), len(words.distinct) + 1
    if n < 3:
        return np.zeros(words.rows, np.int64)
    whole = words.row[:-2] == words.row[2:]
    window = _paired(_paired(code[:-2], code[1:-1], most), code[2:], most)[whole]
    window = _paired(window, words.row[:-2][whole], words.rows)
    _, inverse, times = np.unique(window, return_inverse=True, return_counts=True)
    at = np.flatnonzero(whole)[times[inverse] > 1]
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[at + j] = True
    return np.bincount(words.row[covered], minlength=words.rows)


def repeated_lines(words: common.Words) -> np.ndarray:
    """Lines of each row that hold a word and equal an earlier line of the row."""
    data, rows = words.data, words.rows
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(words.offsets, breaks, side="right") - 1
    # every row has one line more than breaks: a line ends at a break or at its row's end
    ends = np.concatenate([breaks, words.offsets[1:]])
    of = np.concatenate([row, np.arange(rows)])
    order = np.lexsort((ends, of))
    ends, of = ends[order], of[order]
    first = np.append(True, of[1:] != of[:-1])[: len(of)]
    starts = np.where(first, words.offsets[of], np.append(0, ends[:-1] + 1)[: len(ends)])
    filled = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    lengths = ends - starts
    flat = np.ascontiguousarray(data[data != 10])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    code = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode().indices.to_numpy().astype(np.int64)
    code, of = code[filled], of[filled]
    distinct = np.unique(code * rows + of) % max(rows, 1)
    return np.bincount(of, minlength=rows) - np.bincount(distinct, minlength=rows)


def base_counts(words: common.Words) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each row."""

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[words.offsets[1:]] - total[words.offsets[:-1]]

    opens = (words.data & 0xC0) != 0x80
    return {
        "n_words": words.count,
        "word_chars": per_row(opens & ~common._SPACE[words.data]),
        "n_symbols": per_row(_SYMBOL[words.data]),
        "n_dup_lines": repeated_lines(words),
        "n_repeat_words": repeated_words(words),
    }


# ---- n-grams -------------------------------------------------------------------------


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams of order ``ORDER`` that end at each character of the texts, and their rows.

    A character has 16 bits; those beyond are folded into the private area. The last one stands lowest.
    """
    data, offsets = common.utf8(column)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    code = np.where(code > 0xFFFF, 0xE000 + (code & 0xFFF), code).astype(np.uint64)
    code[(code >= 65) & (code <= 90)] += np.uint64(32)
    blank = (code == 32) | ((code >= 9) & (code <= 13))
    code[blank] = 32
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    if len(code):
        again = blank & np.append(False, blank[:-1])
        again[1:] &= row[1:] == row[:-1]
        code, row = code[~again], row[~again]
    value = code.copy()
    for j in range(1, ORDER):
        before = np.full(len(code), _START, np.uint64)
        same = row[j:] == row[:-j]
        before[j:][same] = code[:-j][same]
        value |= before << (_BITS * np.uint64(j))
    return value, row


def _by_language(part: pa.RecordBatch, langs: list[str]) -> np.ndarray:
    """The model of each row: its place in ``langs``, or behind them."""
    place = {x: i for i, x in enumerate(langs)}
    return np.array([place.get(x, len(langs)) for x in part.column("lang").to_pylist()], np.int64)


def counted(docs: DataFrame, langs: list[str]) -> DataFrame:
    """``m, gram, c``: n-grams of all texts by model, counted."""

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        gram, place = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
        return gram, np.bincount(place, weights=np.concatenate([c for _, c in held])).astype(np.int64)

    def batch(m: int, gram: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), m, np.int32)), pa.array(common.signed(gram)), pa.array(c)], ["m", "gram", "c"])

    def run(batches):
        held: dict[int, list] = {}
        for one in batches:
            for part in common.pieces(one, "text"):
                gram, row = grams(part.column("text"))
                model = _by_language(part, langs)[row]
                for m in np.unique(model).tolist():
                    found = held.setdefault(m, [])
                    found.append(np.unique(gram[model == m], return_counts=True))
                    if len(found) > 16:
                        held[m] = [merged(found)]
                if sum(len(g) for x in held.values() for g, _ in x) > HELD:
                    for m, found in held.items():
                        yield batch(m, *merged(found))
                    held = {}
        for m, found in held.items():
            yield batch(m, *merged(found))

    rows = docs.filter("text IS NOT NULL").select("text", "lang").mapInArrow(run, "m int, gram long, c long")
    return rows.groupBy("m", "gram").agg(F.sum("c").alias("c"))


class Model:
    """Probabilities of n-grams and backoff weights of contexts, per model and order, sorted by hash.

    A model that is not ``whole`` holds the most frequent n-grams of the highest order only; ``table``
    (``m, gram, value``) has all of these, and stays with the driver's plan when tasks get the model.
    """

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.whole = True
        self.table: DataFrame | None = None
        self.tables: dict[tuple[int, int, str], tuple[np.ndarray, np.ndarray]] = {}
        #: logarithm of the probability of a character that was never seen
        self.unseen: dict[int, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def put(self, m: int, order: int, kind: str, keys: np.ndarray, values: np.ndarray) -> None:
        hashes = common.mix(keys.astype(np.uint64))
        order_by = np.argsort(hashes)
        self.tables[m, order, kind] = hashes[order_by], values[order_by].astype(np.float32)

    def _find(self, m: int, order: int, kind: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values (0 where not)."""
        known, values = self.tables.get((m, order, kind), (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        hashes = common.mix(keys)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[at] == hashes
        return hit, np.where(hit, values[at], 0.0)

    def logs(self, m: int, gram: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each packed n-gram after the others; NaN where ``table`` must be asked."""
        if not self.whole:
            hit, value = self._find(m, ORDER, "gram", gram)
            return np.where(hit, value, np.nan)
        out = np.zeros(len(gram))
        left = np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            keys = gram[left] & np.uint64((1 << 16 * order) - 1)
            hit, value = self._find(m, order, "gram", keys)
            out[left[hit]] += value[hit]
            left, keys = left[~hit], keys[~hit]
            if order > 1:
                out[left] += self._find(m, order, "context", keys >> _BITS)[1]
        out[left] += self.unseen.get(m, 0.0)
        return out


def least_held(level: DataFrame, most: int) -> tuple[int | None, bool]:
    """The least count from which on at most ``most`` n-grams have one so high, and whether these are all; null if none are."""
    step = F.floor(F.log2("c") * 16).alias("step")  # a thousand steps at most
    least, whole = None, True
    for row in level.groupBy(step).agg(F.min("c").alias("c"), F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if row.n > most:
            return least, False
        least, most = row.c, most - row.n
    return least, whole


def fitted(scratch: common.Scratch, counts: DataFrame, langs: list[str]) -> Model:
    """The modified Kneser-Ney model of the counts; all of it by groupings and joins but for the last sort."""
    model = Model(langs)
    levels = {ORDER: scratch.save(counts, f"order{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << 16 * order) - 1)
        levels[order] = scratch.save(levels[order + 1].groupBy("m", shorter.alias("gram")).agg(F.count("*").alias("c")), f"order{order}")
    least, model.whole = least_held(levels[ORDER], ENTRIES)  # the highest order has most n-grams
    lower = None
    for order in range(1, ORDER + 1):
        level = levels[order].withColumn("context", F.shiftrightunsigned("gram", 16))
        n = [F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5)]
        about = level.groupBy("m").agg(*n, F.count("*").alias("different"))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        d = [F.greatest(F.lit(0.0), F.least(F.lit(k - 0.05), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(k / 2)))) for k in (1, 2, 3)]
        about = F.broadcast(about.select("m", "different", *[x.alias(f"d{k}") for k, x in enumerate(d, 1)]))  # one row per model
        sums = level.groupBy("m", "context").agg(F.sum("c").alias("all"))
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = level.join(about, "m").join(sums, ["m", "context"]).withColumn("own", (F.col("c") - off) / F.col("all"))
        own = scratch.save(own.select("m", "gram", "c", "context", "own", "different"), f"weights{order}")
        rest = own.groupBy("m", "context").agg(F.greatest(F.lit(1e-9), 1 - F.sum("own")).alias("rest"), F.max("different").alias("different"))
        if order == 1:
            below = F.lit(1.0) / (F.col("different") + 1)
            found = own.drop("different").join(rest, ["m", "context"]).withColumn("p", F.col("own") + F.col("rest") * below)
            for row in rest.select("m", F.log(F.col("rest") * below).alias("p")).collect():
                model.unseen[row.m] = row.p
        else:
            shorter = F.col("gram").bitwiseAND((1 << 16 * (order - 1)) - 1)
            found = own.withColumn("shorter", shorter).join(rest.drop("different"), ["m", "context"])
            found = found.join(lower.select("m", F.col("gram").alias("shorter"), F.col("p").alias("below")), ["m", "shorter"])
            found = found.withColumn("p", F.col("own") + F.col("rest") * F.col("below"))
            if model.whole:
                _collect(model, rest.select("m", F.col("context").alias("key"), F.log("rest").alias("value")), order, "context")
        lower = scratch.save(found.select("m", "gram", "c", "p"), f"p{order}")
        held = lower.select("m", F.col("gram").alias("key"), F.log("p").alias("value"))
        if model.whole:
            _collect(model, held, order, "gram")
        elif order == ORDER:
            model.table = lower.select("m", "gram", F.log("p").cast("float").alias("value"))
            _collect(model, held.filter(F.lit(False) if least is None else lower["c"] >= least), order, "gram")
    return model


def _collect(model: Model, rows: DataFrame, order: int, kind: str) -> None:
    """Takes at most ``ENTRIES`` rows to the driver."""
    table = rows.toArrow()
    m, keys, values = (table.column(c).to_numpy() for c in ("m", "key", "value"))
    for one in np.unique(m).tolist():
        mine = m == one
        model.put(one, order, kind, np.ascontiguousarray(keys[mine]).view(np.uint64), values[mine])


def _asked(logs: np.ndarray, gram: np.ndarray, row: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """Each row's distinct n-grams without a probability, and how often the row has them."""
    miss = np.isnan(logs)
    gram, row = gram[miss], row[miss]
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    opens = np.ones(len(gram), bool)
    opens[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(opens)
    count = np.bincount(row[at], minlength=rows)
    return common.lists(common.signed(gram[at]), count, pa.int64()), common.lists(np.diff(np.append(at, len(gram))), count, pa.int64())


def described(scratch: common.Scratch, docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, m``, the base counts and ``log_perplexity`` (null for texts without characters) of texts that ``model`` counted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        model = shared.value
        for one in batches:
            for part in common.pieces(one, "text"):
                found = base_counts(common.Words(part.column("text")))
                gram, row = grams(part.column("text"))
                models = _by_language(part, model.langs)
                logs = np.zeros(len(gram))
                for m in np.unique(models).tolist():
                    mine = models[row] == m
                    logs[mine] = model.logs(m, gram[mine])
                found["n_chars"] = np.bincount(row, minlength=part.num_rows)
                held = np.bincount(row, weights=np.nan_to_num(logs, nan=0.0), minlength=part.num_rows)
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(models.astype(np.int32)), *[pa.array(found[x].astype(np.int64)) for x in (*names, "n_chars")], pa.array(held), *_asked(logs, gram, row, part.num_rows)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "m", *names, "n_chars", "held", "asked", "times"])

    schema = "doc_id long, m int, " + ", ".join(f"{x} long" for x in (*names, "n_chars")) + ", held double, asked array<long>, times array<long>"
    rows, logs = docs.select("doc_id", "text", "lang").mapInArrow(run, schema), F.col("held")
    if not model.whole:
        rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "held")
        asked = rows.select("row", "m", F.inline(F.arrays_zip(F.col("asked").alias("gram"), F.col("times").alias("times"))))
        # whole numbers, so that sums do not depend on the order of rows
        share = F.sum(F.round(F.col("value").cast("double") * (1 << 32)).cast("long") * F.col("times")) / (1 << 32)
        rows = rows.join(asked.join(model.table, ["m", "gram"]).groupBy("row").agg(share.alias("joined")), "row", "left")
        logs = logs + F.coalesce("joined", F.lit(0.0))
    return rows.select("doc_id", "m", *names, F.when(F.col("n_chars") > 0, -logs / F.col("n_chars")).alias("log_perplexity"))


def languages(docs: DataFrame) -> list[str]:
    """The languages with a model of their own."""
    rows = docs.filter("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    return sorted(r.lang for r in rows)


def judged(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every document's base counts, ``base_failed``, ``perplexity``, its language's band ``lower`` to ``upper``, and ``kept``."""
    scratch = common.Scratch(spark, "perplexity")
    langs = languages(docs)
    model = fitted(scratch, counted(docs, langs), langs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = scratch.save(described(scratch, docs, model).withColumn("base_failed", failed), "described")
    quarter = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    bands = rows.filter("NOT base_failed").groupBy("m").agg(quarter.alias("q"), F.count("*").alias("n"))
    width = F.when(F.col("n") < LEAST_BAND, F.lit(LEAST_WIDTH)).otherwise(F.greatest(F.lit(LEAST_WIDTH), F.col("q")[1] - F.col("q")[0]))
    bands = bands.select("m", (F.col("q")[0] - BELOW * width).alias("low"), (F.col("q")[1] + ABOVE * width).alias("high"))
    within = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    found = rows.join(F.broadcast(bands), "m", "left")  # one row per model
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(False))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.exp("log_perplexity").alias("perplexity"), F.exp("low").alias("lower"), F.exp("high").alias("upper"))


def filtered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject; rows without an id are judged by none and go."""
    kept = judged(spark, docs).filter("kept").select("doc_id").distinct().hint("shuffle_hash")
    return docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op12_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, common.documents(spark, sf_dir))
