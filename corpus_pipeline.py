"""From documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and judges all that its predecessor
kept; all but the last return the columns of ``documents``. Every stage's result
is written as Parquet to shared storage and read again by the next.

All stages take nulls in any column, empty and very long texts, repeated rows,
empty tables and columns of any name; each function says what it does with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern import storage
from quern.llm import exact_dedup, mixing, packing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; labels of ``sf_dir`` train the model. Null and empty texts stay, repeated rows share a
    verdict, a text of any length is scanned whole; without labels of both classes, or without rows, all stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (blanks apart) the longest, then the least id, then the first by file and place stays. Null, empty
    and blank texts are one group; a null id comes last."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: fingerprints of five-word shingles that link, or shingles with
    a similarity of 0.8. The least id stays, a null id only if there is no other; blank texts have fingerprint zero."""
    return simhash.keep_one(docs, width=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets. A null source is one of its own; empty texts
    have no words and are taken with their block; repeated rows are drawn one by one."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences. A null or empty text is an end token alone; a text of any
    length is cut into pieces; rows of one id are documents of their own."""
    return packing.pack(packing.pieces(docs)).drop("row")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the fingerprints. Tests hold each stage's rows against those recomputed:
#: toxicity and mixing by the operators that have brute-force tests of their own, both dedup stages and packing directly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.stage(spark, stage(spark, docs, sf_dir), name)
    return docs
