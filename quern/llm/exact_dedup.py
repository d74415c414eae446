"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three stages, each grouping by the full normalised text beside its digest:

1. local: the partial aggregation in every scan task merges the copies it meets;
2. salted: digests with at least 1/2000 of all rows (at most 2000 of them, so
   the list is broadcast) are dealt over ``salts`` tasks each, others go to one;
3. global: the few salt winners of those digests are combined.

The text is shuffled once. Rows then get their class through the digest, which
is exact unless two different texts share one; stage 3 sees that, and the class
is then looked up by digest and text.

Defined cases: a null text counts as empty, so null, empty and blank texts are
one group; a null id comes after every other id; of rows alike in length and id
the first by file and place stays; texts of any length are compared whole; an
empty table gives an empty result; other columns, whatever their names, are
ignored by ``classes`` and kept by ``drop_copies``. The input is read twice; its
rows are told apart by their place in their file (`storage.numbered`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import storage

#: Characters that don't count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """``text`` without blanks; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256, row_col: str | None = None
) -> DataFrame:
    """A row per input row: ``row`` (its number, or the numbers in ``row_col``),
    ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``digest``."""
    spark = docs.sparkSession
    if row_col is None:
        docs, row_col = storage.numbered(docs)
    rows = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("row", "doc_id", F.char_length("text").cast("long").alias("chars"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    narrow = storage.stage(spark, rows.select("row", "doc_id", "digest"), "digests")
    total = narrow.count()
    bar = max(1000, total // storage.HOT_KEYS)
    hot = narrow.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= bar).select("digest", F.lit(True).alias("hot"))
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    salted = (
        rows.join(F.broadcast(hot), "digest", "left")
        .withColumn("hot", F.coalesce("hot", F.lit(False)))
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(salts))).otherwise(F.lit(0)))
        .groupBy("hot", "digest", "salt", "norm")
        .agg(F.count("*").alias("n"), best.alias("best"))
    )
    content = F.xxhash64("norm").alias("content")
    cold_won = salted.where(~F.col("hot")).select("digest", content, "n", "best")
    hot_won = salted.where("hot").groupBy("digest", "norm").agg(F.sum("n").alias("n"), F.min("best").alias("best")).select("digest", content, "n", "best")
    won = cold_won.unionByName(hot_won).select("digest", "content", F.col("n").alias("group_size"), F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    won = storage.stage(spark, won, "classes")
    clash = won.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").limit(1).count() > 0
    if clash:
        out = _by_content(rows, salted)
    else:
        many = won.where("group_size > 1").drop("content")
        out = storage.lookup(narrow, many, "digest", total, "group_size").select(
            "row",
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"),
            (F.col("group_size").isNull() | (F.col("keep_row") == F.col("row"))).alias("kept"),
            "digest",
        )
    return out


def _by_content(rows: DataFrame, salted: DataFrame) -> DataFrame:
    """The same where one digest has several texts: rows meet their class by text."""
    won = salted.groupBy("digest", "norm").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    won = won.select("digest", "norm", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    found = rows.join(won, ["digest", "norm"])
    return found.select("row", "doc_id", "keep_id", "group_size", (F.col("keep_row") == F.col("row")).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    docs, row = storage.numbered(docs)
    losers = classes(docs, id_col, text_col, row_col=row).where(~F.col("kept")).select(F.col("row").alias(row))
    return storage.without(docs, row, storage.stage(docs.sparkSession, losers, "copies")).drop(row)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of equal texts among ``documents``, a row per document."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256
FROM w
"""
