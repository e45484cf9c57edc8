"""The corpus pipeline: language, near copies, personal data, mixture, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``, and further columns unchanged whatever their names. No stage fails
on nulls in any column, repeated rows or an empty table, and all take texts whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliploom.llm import common, languages, mixing, near_copies, packing, personal

#: Documents for whose words less than half of the likelihood goes to one language are
#: rejected. On held-out labels every rightly told document lies above it.
LEAST_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters (null and empty texts too), or a score below ``LEAST_SCORE``.

    Equal texts are judged alike, so repeated rows stay or go together. Where no row has a
    ``lang`` nothing can be learned, no document has a language, and none stays.
    """
    return languages.keep(spark, docs, LEAST_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    A resemblance of five-word shingles of 0.8 or more links two documents, and links chain.
    Texts without words and rows without an id stay; rows that repeat an id are one document
    and stay or go together.
    """
    return near_copies.keep_first(spark, docs)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; ``n_chars`` follows the new text.

    Null and empty texts and texts without personal data are returned as they are.
    """
    return personal.redact(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources asks for.

    A null source is a source of its own; null texts have no words, so a source of nothing
    but such rows is left out. Rows with one id draw the same number.
    """
    return mixing.mix(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens.

    A null text is its end token alone; repeated rows are packed one by one; a long text is
    cut into pieces of whole sequences.
    """
    import public_tokenizers

    _, placed = packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", keep_languages),
    ("near copies", drop_near_copies),
    ("personal data", redact_personal),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: Sketches, tokenizers and the language model have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
