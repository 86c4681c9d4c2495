"""From raw documents to token ids: language, near-duplicates, repeated passages, benchmark leaks, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and sees all that the stage before it kept; its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.

Defined cases: an empty table passes through all stages as an empty table. What each stage does with null and
empty texts is said by its operator; extra columns of ``docs`` are dropped, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import decontamination, language_id, queries, sentence_pieces, simhash_dedup, substring_dedup
from tidewarden.llm.common import documents, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the languages learned from the labelled ones; ``und`` goes."""
    plain = docs.select(*COLUMNS)
    trees = language_id.learn(plain, F.lit(True))
    found = language_id.predict(plain, trees)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints."""
    return simhash_dedup.keep_one(docs.select(*COLUMNS))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 20-word windows that occur earlier.

    A text that loses nothing keeps its white space; else the words left are joined by one space. A null text stays null.
    """
    return substring_dedup.without_repeats(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is, or nearly is, a benchmark item."""
    return decontamination.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the ids with the end id, and whether they decode to the text."""
    whole = docs.select("doc_id", "lang", "source", "text")
    return sentence_pieces.encode_checked(whole, queries.piece_model())


STAGES = [
    ("language ID", keep_known_language),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Language models, components and id sequences have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
