"""Line dedup over levelled sorted runs of line hashes.

`LineRuns` is an index that documents enter batch by batch. A run is a table of
``hash``, ``docs`` (how many documents have the line) and ``last`` (the largest
place among them), bucketed and sorted by hash, one file a bucket. A new batch

1. is aggregated by hash (partial sums in the scan tasks, one narrow shuffle),
2. is merge-anti-joined with each run: bucket meets bucket, no run is shuffled, and a
   hash drops out that a run has settled, that is, seen in enough documents with
   a last place that the batch doesn't exceed,
3. is added as a run of level 0.

When a level has ``fanout`` runs, they are merged into one run of the next level:
counts add up, the larger place stays. So there are at most ``fanout`` - 1 runs a
level and a logarithm of levels, and every entry is rewritten once a level. The
order of batches changes neither counts nor places of lines below the threshold;
a settled line keeps a count of at least ``least`` and its exact last place.

`drop_lines` fills an index with all documents, merges it, and rewrites the texts:
occurrences meet the common hashes (`storage.lookup`: hot ones are broadcast),
their places in the text are gathered by document, and the text is cut there
(a slice a gap, so linear in the text). Texts are shuffled once for that, however
many lose lines.

Hashes are the first 128 bits of SHA-256, so different lines are taken for equal with
a chance below 1e-14 at 10^12 lines.

Defined cases: a null or empty text is one empty line; every row is a document of
its own, rows of one id in the order of file and place, a null id before all others;
a text all of whose lines go becomes empty; a line twice in a document counts
once, and both go or stay; texts of any length are read whole; an empty table gives an empty
result; other columns, whatever their names, are kept by `drop_lines`.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import storage

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 40
LEAST_DOCS = 5
FANOUT = 4
BATCHES = 8


def key_of(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hash_of(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def occurrences(docs: DataFrame, row: str, place: Column, text_col: str, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``row``, ``place`` (of the document among all), ``at`` (of the line in it) and ``hash`` of every long enough line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(row).alias("row"), place.alias("place"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    keys = lines.where(F.char_length("line") >= least_chars).select("row", "place", "at", key_of(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= least_chars).select("row", "place", "at", hash_of(F.col("key")).alias("hash"))


class LineRuns:
    """Runs by level, the youngest level first. Tables lie in the shared folder and are known to this session."""

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.merged = 0  # how many merges there were

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        """A batch of whole documents' lines (``row``, ``place``, ``hash``) enters."""
        batch = lines.select("hash", "row", "place").distinct().groupBy("hash").agg(F.count("*").alias("docs"), F.max("place").alias("last"))
        for run in self.runs():
            old = self.spark.table(run).select(F.col("hash").alias("h"), F.col("docs").alias("d"), F.col("last").alias("l"))
            settled = (F.col("hash") == F.col("h")) & (F.col("d") >= self.least) & (F.col("l") >= F.col("last"))
            batch = batch.join(old.hint("merge"), settled, "left_anti")
        self._put(batch, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._merge(self.levels[level], level + 1)
            level += 1

    def index(self) -> DataFrame:
        """All runs, of which there must be one, merged into one."""
        if len(self.runs()) > 1:
            self._merge(self.runs(), len(self.levels))
        return self.spark.table(self.runs()[0])

    def close(self) -> None:
        """Forget and delete all runs."""
        for run in self.runs():
            self._drop(run)
        self.levels = []

    def _put(self, rows: DataFrame, level: int) -> None:
        name = f"quern_run_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, "hash").sortBy("hash").format("parquet")
        self.paths[name] = storage.new_path(self.spark, "line_run")
        writer.option("path", self.paths[name]).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merge(self, names: list[str], level: int) -> None:
        old = list(names)
        both = reduce(DataFrame.unionByName, [self._files(n) for n in old])
        self._put(both.groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("last").alias("last")), level)
        self.levels = [[n for n in have if n not in old] for have in self.levels]
        for n in old:
            self._drop(n)
        self.merged += 1

    def _files(self, name: str) -> DataFrame:
        """A run without its buckets: Spark 4.1 takes a union of bucketed scans for bucketed, but may read it otherwise."""
        return self.spark.read.schema(self.spark.table(name).schema).parquet(self.paths[name])

    def _drop(self, name: str) -> None:
        storage.discard(self.spark, self._files(name))
        self.spark.sql(f"DROP TABLE {name}")


def lost_places(docs: DataFrame, row: str, id_col: str, text_col: str, least_chars: int, least_docs: int, batches: int, fanout: int) -> DataFrame:
    """Staged ``row`` and ``gone``: the places, ascending, of the lines that a document loses."""
    spark = docs.sparkSession
    place = F.struct(F.col(id_col).alias("id"), F.col(row).alias("row"))  # nulls first
    found = occurrences(docs, row, place, text_col, least_chars).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))
    path = storage.new_path(spark, "line_hashes")
    found.write.partitionBy("batch").parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    index = LineRuns(spark, least_docs, fanout)
    for k in range(batches):
        index.add(found.where(F.col("batch") == k))
    common = storage.stage(spark, index.index().where(F.col("docs") >= least_docs), "common_lines")
    index.close()
    met = storage.lookup(found.select("hash", "row", "place", "at"), common, "hash", found.count(), "docs")
    lost = met.where(F.col("docs").isNotNull() & (F.col("place") < F.col("last")))
    return storage.stage(spark, lost.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("gone")), "lost_lines")


def drop_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``docs`` without the lines that ``least_docs`` documents have, but for the last of them, and with ``line_dedup``:
    ``n_lines`` (before) and ``n_dropped``."""
    columns = docs.columns
    docs, row = storage.numbered(docs)
    lost = lost_places(docs, row, id_col, text_col, least_chars, least_docs, batches, fanout)
    gone, info = storage.free_name(docs.columns, "_quern_gone"), storage.free_name(columns, "line_dedup")
    joined = docs.join(lost.select(F.col("row").alias(row), F.col("gone").alias(gone)).hint("shuffle_hash"), row, "left")
    lines, g = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), F.col(gone)
    after = F.concat(g, F.array(F.size(lines)))  # the place behind each gap
    gaps = F.transform(after, lambda end, k: F.slice(lines, F.coalesce(F.get(after, k - 1), F.lit(-1)) + 2, end - F.coalesce(F.get(after, k - 1), F.lit(-1)) - 1))
    kept = F.when(g.isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(gaps), "\n"))
    counts = F.struct(F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(g), F.lit(0)).cast("long").alias("n_dropped"))
    return joined.select(*[(kept if c == text_col else F.col(f"`{c}`")).alias(c) for c in columns], counts.alias(info))


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line counts and what is left of every document's text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return drop_lines(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(text, 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, pos, ls[pos] AS line FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM d))),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(rid) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.rid < c.last AS gone FROM k LEFT JOIN c USING (key)),
o AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
  FROM m GROUP BY rid
)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM d JOIN o USING (rid)
"""
