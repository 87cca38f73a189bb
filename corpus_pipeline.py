"""The corpus pipeline: language ID, near-duplicates, secrets, packing, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspark.llm import langid, packing, secrets, simhash
from fernspark.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without (null, empty or letterless text) go. Profiles are learned from the labels among ``docs``; without any, every text with a letter stays.

    Whole texts are judged, a slice at a time. Equal distances go to the label that sorts first; repeated rows and null ids stay, all columns
    go through as they are, and an empty table gives an empty table.
    """
    return langid.keep_identified(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, see :func:`fernspark.llm.simhash.keep_first`.

    That with the smallest id; ties by a hash of all columns; of rows equal throughout one. Rows with a null id stay, null
    and wordless texts are a group, all columns go through, and an empty table gives an empty table.
    """
    return simhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their whole texts replaced by their kind; ``n_chars``, if there is one, follows the text.

    Null texts stay null, overlapping spans are replaced together, repeated rows stay, other columns go through, and an empty table gives an empty table.
    """
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: a row per piece of a document with its place.

    A null or empty text is a piece of the end token alone; longer texts than a sequence are cut. Repeated rows are packed each, null ids stay, equal
    lengths go by the other columns of a piece, columns other than id and text aren't read, and an empty table gives an empty table.
    """
    pieces = packing.cut(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    packed = packing.pack(pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32"), capacity=4096)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("packing", pack)]

#: None of the stages can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
