"""The corpus pipeline: quality, near-duplicates, secrets, source mixing, packing. Part of the training-data subpackage.

Every stage works on whole texts and keeps all columns of ``docs`` as they are named, whatever the names. All but the last return the columns of
``docs``. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.llm import minhash, mixing, packing, quality, secrets
from pointmill.llm.common import materialize, read

#: No SQL: four of the five stages are fitted, sampled or packed. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. The score is computed beside each row, so texts are not shuffled.

    Null and empty texts are scored as empty ones; rows with a null doc_id are scored like others; repeated rows stand or fall together; without any trusted positive
    all rows stay.
    """
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each class of near duplicates: that of the smallest doc_id.

    Decisions are by doc_id and text: a doc_id that repeats with a text of its own loses nothing, and of rows that repeat both one stays. Null texts are
    copies of empty ones; rows with a null doc_id stay only where their class has no other.
    """
    return minhash.keep_one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked and n_chars, where there is one, counted anew. Null texts stay null, with null characters."""
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again, up to twice, to meet the weights of the sources.

    A null source is a source; null and empty texts count as one token; repeated rows are documents of their own.
    """
    return mixing.repeat_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give one piece of the end id; repeated rows are packed one by one; a null doc_id stays.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_first_of_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of ``sf_dir``, each written to the shared folder and read again: the pieces of the last one."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
