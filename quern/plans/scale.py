"""Queries whose operators keep no group, series or order in one task: random access, permutations, scans, streams, totals seen while writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import storage
from quern.functions import text as t
from quern.operators import chat, metrics, mix, packing
from quern.plans.queries import SEQ, WORDS, query, r6
from quern.plans.training import ENCODED_SQL, TOK
from quern.sources import readers, sinks
from quern.streaming import curve, packers

# Random access

CHUNKS_SQL = ENCODED_SQL.replace("ROOM", "2048") + """, f AS (SELECT conv_id, conv_id % 4 AS task, unnest(ids) AS id, unnest(mask) AS m, unnest(range(len(ids))) AS i FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY conv_id, i) - 1 AS p, count(*) OVER (PARTITION BY task) AS n FROM f),
c AS (SELECT task, p // 256 AS row, md5(string_agg(id, ',' ORDER BY p)) AS ids, md5(string_agg(m, ',' ORDER BY p)) AS mask FROM g WHERE p // 256 < n // 256 GROUP BY task, p // 256),
x AS (SELECT row_number() OVER (ORDER BY task, row) - 1 AS index, ids, mask FROM c)"""


def chunks(d):
    """Packed rows of 256 tokens with their masks."""
    got = chat.encoded(d.conversations, TOK, 2048).withColumn("task", F.col("conv_id") % 4)
    pieces = packing.stream_pieces(packing.range_offsets(got, ["task"], "conv_id", F.size("ids")), 256)
    ids, mask = packing.stream_rows(pieces, ["task"], "ids"), packing.stream_rows(pieces, ["task"], "mask").withColumnRenamed("ids", "mask")
    return ids.join(mask, ["task", "row"])


@query(CHUNKS_SQL + " SELECT index, ids, mask FROM x WHERE index % 17 = 5")
def packed_random_access(d):
    """Scattered rows of a packed matrix and its masks, by global index, from blocks of sixteen."""
    path = storage.new_path(d.spark, "matrix")
    sinks.blocked(chunks(d), path, ["task", "row"], 16)
    rows = d.spark.read.parquet(path)
    wanted = rows.select("index").where("index % 17 = 5")
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return readers.rows_at(d.spark, path, wanted).select("index", digest("ids"), digest("mask"))


# Orders that are arithmetic

KEYS = mix.round_keys(42, 3)


def permuted_sql(rows: str) -> str:
    """``rows`` (with index and n) with their ``place``, by the same rounds, walked recursively."""
    state = "SELECT *, CAST(floor(sqrt(greatest(n - 1, 0))) AS BIGINT) + 1 AS a FROM s"
    state = f"SELECT *, greatest((n + a - 1) // a, 1) AS b FROM ({state})"
    state = f"SELECT *, v // b AS x, v % b AS y FROM ({state})"
    for i, key in enumerate(KEYS):
        half, size, other = ("x", "a", "y") if i % 2 == 0 else ("y", "b", "x")
        h = f"(({other} * {mix.FACTOR} + {key}) % {mix.PRIME})"
        state = f"SELECT * REPLACE (({half} + ({h} * {h} + {key}) % {mix.PRIME}) % {size} AS {half}) FROM ({state})"
    return f"""WITH RECURSIVE r AS ({rows}), s AS (SELECT index, n, index AS v, 0 AS k FROM r UNION ALL SELECT index, n, x * b + y AS v, k + 1 AS k FROM ({state}) WHERE k = 0 OR v >= n)
SELECT index, v AS place FROM s WHERE k > 0 AND v < n"""


ROWS_SQL = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS index, CAST((SELECT count(*) FROM documents) AS BIGINT) AS n FROM documents"


def counted(d):
    return mix.placed(d.documents.select("doc_id"), [], ["doc_id"], at="index"), d.documents.count()


@query(permuted_sql(ROWS_SQL))
def epoch_places(d):
    """Each document's place in an epoch, and back."""
    rows, n = counted(d)
    got = rows.select("index", mix.permuted(F.col("index"), n, 42, 3).alias("place"))
    back = mix.permuted(F.col("place"), n, 42, 3, inverse=True)
    return got.select("index", F.when(back == F.col("index"), F.col("place")).alias("place"))


@query(f"SELECT * FROM ({permuted_sql(ROWS_SQL)}) WHERE place >= 300")
def epoch_rest(d):
    rows, n = counted(d)
    return mix.epoch_rest(rows, "index", n, 42, 3, 300, at="place").select("index", "place")


# Scans over one series


@query("SELECT event_id, best, coalesce(value < before, true) AS new_low FROM (SELECT event_id, value, min(value) OVER (ORDER BY event_id) AS best, min(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)")
def best_of_all(d):
    return metrics.best_so_far(d.events.select("event_id", "value"), [], "event_id", "value").select("event_id", "best", "new_low")


@query("""WITH s AS MATERIALIZED (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events)
SELECT a.event_id, round(sum(power(0.9, a.k - b.k) * CASE WHEN b.k = 0 THEN 1 ELSE 0.1 END * b.value), 6) AS ema FROM s a JOIN s b ON b.k BETWEEN a.k - 400 AND a.k GROUP BY a.event_id""")
def loss_ema_curve(d):
    """The exponential mean after every event, all events being one series."""
    return metrics.ema_curve(d.events.select("event_id", "value"), [], "event_id", "value").select("event_id", r6(F.col("ema")).alias("ema"))


# Totals seen while writing


@query(f"""SELECT source, CAST(count(*) AS BIGINT) AS rows, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT CASE WHEN source IN ('src0', 'src1', 'src2') THEN source END AS source, {WORDS} AS n FROM documents) GROUP BY source""")
def written_totals(d):
    rows = d.documents.select("doc_id", "source", "text", t.n_tokens(F.col("text")).alias("n"))
    return sinks.written(rows, storage.new_path(d.spark, "written"), ["src0", "src1", "src2"])


# Streams


@query()
def stream_best_fit(d):
    """Documents that arrive in twelve files in no order, packed as the batch packer packs them."""
    docs = d.documents.select("doc_id", t.n_tokens(F.col("text")).alias("size")).withColumn("shard", F.col("doc_id") % 3)
    rows = mix.placed(docs, ["shard"], ["doc_id"], at="ord").select("shard", "ord", (F.col("size") + 1).alias("n"))
    ends = rows.groupBy("shard").agg(F.count("*").alias("ord"), F.lit(None).cast("long").alias("n"))
    path = storage.new_path(d.spark, "arriving")
    rows.unionByName(ends).repartition(12, F.xxhash64("shard", "ord")).write.parquet(path)
    own = d.spark.newSession()  # every micro-batch opens all partitions of the state, and three shards need no more for more documents
    own.conf.set("spark.sql.shuffle.partitions", "12")
    stream = own.readStream.schema("shard long, ord long, n long").option("maxFilesPerTrigger", 3).parquet(path)
    out = storage.new_path(d.spark, "packed")
    curve.replay(packers.best_fit(stream, SEQ, 100), out, storage.new_path(d.spark, "stream_state")).awaitTermination()
    return d.spark.read.schema(packers.ROWS).parquet(out)
