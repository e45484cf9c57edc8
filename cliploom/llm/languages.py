"""Language identification by word-first backoff.

A word is a run of ASCII letters and bytes above 127, with A-Z in lower case. A known word
scores its log frequency in each language; an unseen word scores the mean log frequency of
its longest character n-grams of which at least one is known, down to single characters.
Words and n-grams that occur less than ``LEAST`` times in a language's sample count as
unseen there; all others are in the model.

The predicted language has the largest mean score over a text's words, and ``score`` is the
softmax of these means: near 1 where the words of a text speak for one language, near 1 over
the number of languages where they say nothing, whatever the length of the text.

``und`` with score 0 is predicted for null, for texts without a letter, and when nothing
could be learned. Ties go to the first language in code point order. Rows without ``lang``
teach nothing; a repeated row teaches as often as it stands. An empty table teaches nothing
and gives an empty result. Long texts are taken whole. Further columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import common

#: Bounds of the labelled sample of each language: documents and characters. A language with
#: fewer has all of its documents in the sample, however large the others are.
TRAIN_DOCS, TRAIN_CHARS = 2_000, 6_000_000
#: Occurrences in the sample below which a word or n-gram is unseen, and the longest n-gram.
LEAST, LONGEST = 2, 5
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class _LetterWords(common.Words):
    """Words of letters only: every other byte is taken as a blank."""

    def __init__(self, column: pa.Array):
        data, offsets = common.utf8(column)
        blanked = np.where(_LETTER[data], common._LOWER[data], 0x20).astype(np.uint8)
        plain = pa.Array.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(blanked.tobytes())]
        )
        super().__init__(plain)


def _texts(words: common.Words, index: np.ndarray) -> list[bytes]:
    raw = words.data.tobytes()
    return [raw[a:b] for a, b in zip(words.start[index].tolist(), words.end[index].tolist(), strict=True)]


def _grams(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of words between boundary marks, and the word each is from."""
    joined = b"".join(b"\x02" + w + b"\x03" for w in words).decode("utf-8", "replace")
    code = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.cumsum(code == 2) - 1
    size = max(0, len(code) - n + 1)
    value = np.zeros(size, np.uint64)
    for j in range(n):
        value = value * common._BASE + code[j : j + size]
    whole = word[:size] == word[n - 1 : n - 1 + size]
    if n == 1:
        whole &= (code[:size] != 2) & (code[:size] != 3)
    return common.mix(value[whole] + np.uint64(n)), word[:size][whole]


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def sample(docs: DataFrame, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> DataFrame:
    """Labelled rows that are not held out, of each language about ``most`` and ``chars`` characters at most, by a hash of the id."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()  # one row per language
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    for r in sizes:
        share = min(1.0, most / r.n, chars / max(1, r.chars))
        if share < 1:
            labelled = labelled.filter((F.col("lang") != r.lang) | (part < int((1 << 30) * share)))
    return labelled


def train(spark: SparkSession, docs: DataFrame, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS, least: int = LEAST) -> dict:
    """The model as plain arrays: for each size (0: words) the known keys and their log frequencies by language."""

    def count(batches):
        for batch in batches:
            for part in common.pieces(batch, "text"):
                words = _LetterWords(part.column("text"))
                lang = part.column("lang").dictionary_encode()
                names = lang.dictionary.to_pylist()
                code = lang.indices.to_numpy()[words.row].astype(np.uint64)
                _, index, n = np.unique(common.mix(words.hash + code), return_index=True, return_counts=True)
                texts = [w.decode("utf-8", "replace") for w in _texts(words, index)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in code[index].astype(int)], pa.string()), pa.array(texts, pa.string()), pa.array(n.astype(np.int64))],
                    ["lang", "word", "n"],
                )

    def count_grams(batches):
        for batch in batches:
            words = [w.encode() for w in batch.column("word").to_pylist()]
            weight, lang = batch.column("n").to_numpy(), batch.column("lang").dictionary_encode()
            names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy()
            for size in range(LONGEST + 1):
                if size:
                    value, word = _grams(words, size)
                else:
                    value, word = common.Words(pa.array(words, pa.binary())).hash, np.arange(len(words))
                order = np.lexsort((code[word], value))
                value, owner, n = value[order], code[word][order], weight[word][order]
                first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[: len(value)])
                total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in owner[first]], pa.string()), pa.array(np.full(len(first), size)), pa.array(common.signed(value[first])), pa.array(total)],
                    ["lang", "size", "key", "n"],
                )

    scratch = common.Scratch(spark, "lang")
    counted = sample(docs, most, chars).mapInArrow(count, "lang string, word string, n long")
    words = scratch.save(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    grams = words.mapInArrow(count_grams, "lang string, size long, key long, n long")
    kept = grams.groupBy("lang", "size", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    table = kept.toArrow()  # bounded by the characters of the sample
    lang = table.column("lang").combine_chunks()
    langs = sorted(x for x in set(lang.unique().to_pylist()))
    owner = np.array([langs.index(x) for x in lang.dictionary_encode().dictionary.to_pylist()], np.int64)
    owner = owner[lang.dictionary_encode().indices.to_numpy()] if len(lang) else owner
    sizes, keys, counts = (table.column(c).to_numpy() for c in ("size", "key", "n"))
    model: dict = {"langs": langs}
    for size in range(LONGEST + 1):
        own = sizes == size
        known, inverse = np.unique(keys[own].view(np.uint64), return_inverse=True)
        n = np.zeros((len(known), len(langs)))
        np.add.at(n, (inverse, owner[own]), counts[own])
        model[size] = known, (np.log(n + 0.5) - np.log(n.sum(0) + 0.5 * max(1, len(known)))).astype(np.float32)
    return model


def _find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows of ``keys`` in a model table, -1 where unknown."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def word_scores(model: dict, keys: np.ndarray, texts) -> np.ndarray:
    """Scores of distinct words; ``texts(index)`` gives the spelling of unseen ones."""
    at = _find(model[0][0], keys)
    scores = np.zeros((len(keys), len(model["langs"])))
    scores[at >= 0] = model[0][1][at[at >= 0]]
    unseen = np.flatnonzero(at < 0)
    for size in range(LONGEST, 0, -1):
        if not len(unseen):
            break
        value, word = _grams(texts(unseen), size)
        row = _find(model[size][0], value)
        value, word, row = value[row >= 0], word[row >= 0], row[row >= 0]
        n = np.bincount(word, minlength=len(unseen))
        for k in range(scores.shape[1]):
            total = np.bincount(word, weights=model[size][1][row, k], minlength=len(unseen))
            scores[unseen, k] = total / np.maximum(1, n)
        unseen = unseen[n == 0]
    return scores


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def _judged(model: dict, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The predicted language and score of each text."""
    words, langs = _LetterWords(column), model["langs"]
    pred, score = [UNKNOWN] * words.rows, np.zeros(words.rows)
    if not langs or not len(words.hash):
        return pred, score
    letters = words.count > 0
    for r in np.flatnonzero(letters):  # bytes above 127 need a closer look where no ASCII letter stands
        own = words.data[words.offsets[r] : words.offsets[r + 1]]
        if not ((own > 96) & (own < 123)).any():
            letters[r] = _has_letter(own.tobytes())
    uniq, index, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    each = word_scores(model, uniq, lambda i: _texts(words, index[i]))
    total = np.stack([np.bincount(words.row, weights=each[inverse, k], minlength=words.rows) for k in range(len(langs))], 1)
    mean = total / np.maximum(1, words.count)[:, None]
    best = mean.argmax(1)
    share = 1 / np.exp(mean - mean.max(1, keepdims=True)).sum(1)
    for r in np.flatnonzero(letters):
        pred[r], score[r] = langs[best[r]], share[r]
    return pred, score


def predict(spark: SparkSession, docs: DataFrame, model: dict, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` and two columns more, called ``names``; reads nothing but ``text``.

    Columns that ``docs`` has under one of the names stay beside it; pick other names then.
    """
    shared = spark.sparkContext.broadcast(model)  # bounded by the characters of the sample
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, f"c{at}"):
                pred, score = _judged(shared.value, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], [*part.schema.names, "pred", "score"])

    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = StructType([*plain.schema.fields, StructField("pred", StringType()), StructField("score", DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*docs.columns, *names)


def keep(spark: SparkSession, docs: DataFrame, least: float) -> DataFrame:
    """The rows of ``docs`` with a language of a score of ``least`` at least."""
    own = [f"column {i}" for i in range(len(docs.columns))]
    found = predict(spark, docs, train(spark, docs))
    found = found.toDF(*own, "pred", "score").filter((F.col("pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*own).toDF(*docs.columns)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(spark, docs)
    found = predict(spark, docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
