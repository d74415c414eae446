"""Sharding by k-d tree: weighted medians along the widest metadata dimension.

Each row is a point: its size, the place of its id, and the hashed language and
source, every dimension spread over the same grid. A node that is to hold k
shards is cut along the dimension in which its rows spread widest, where the
bytes to the left are k/2 (rounded down) of k parts of the node's bytes. Ties in
a dimension are broken by a hash of the row, so every row has its own place and
a third of all rows with one value is cut like any other.

The cut of all nodes of a level is found at once by refining histograms: each
pass sums bytes by node and bin (native partial aggregation; at most 2^BITS bins
a node and 2^MOST_BITS bins in all reach the driver), and the bin that holds the
target is refined until it is light. Rows get their node by a lookup in the
level's cuts and are written narrow once a level; no pass shuffles a row. Slots are numbered by (shard, bucket) in parallel.

Leaves are given by number, or by the bytes they may hold (``target_bytes``): the
tree then splits until its leaves' mean is at most that.

Law ``bytes``: sizes are near equal. Tolerance: a cut misses its target by less
than half a document, or half of a last bin, which weighs at most ``NEAR`` of a
shard; each level divides what it got. Equal texts are points like any others
and may be parted, as one group may be larger than a shard.

Defined cases: a null text counts 16 bytes and has the checksum of the empty
text; ids that aren't numbers are placed by their hash; null ids, languages and
sources have a place of their own; repeated rows are told apart by scan order,
which is written once; a text of any length is one point; an empty table gives an
empty result; fewer rows than shards leave shards empty; other columns are
ignored. The points are written to shared storage, and the input is read only for
that.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quern import storage

GRID = 16  # bits of a dimension's grid
TIE = 46  # bits of the hash that breaks ties
BITS = 12  # bits refined in a pass, at most
MOST_BITS = 18  # bits of bins that a pass brings to the driver, over all nodes
NEAR = 1e-3  # a bin that weighs at most this part of a shard needn't be refined
SLOT_ROWS = 20_000


@dataclass
class Node:
    lo: int  # shards lo to hi - 1
    hi: int
    dim: int = 0
    cut: int = 1 << (GRID + TIE)  # places below it go left


def points(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None, source_col: str | None) -> DataFrame:
    """``row``, ``doc_id``, ``size``, ``crc``, ``tie`` and a place for each dimension."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00")) if c else F.lit("")
    raw = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(named(lang_col)), 64 - GRID).alias("lang"),
        F.shiftrightunsigned(F.xxhash64(named(source_col)), 64 - GRID).alias("source"),
    )
    raw = storage.stage(spark, raw.withColumn("tie", F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 64 - TIE)), "points")
    top = (1 << GRID) - 1
    numeric = isinstance(raw.schema["doc_id"].dataType, NumericType)
    along = F.col("doc_id").cast("double") if numeric else F.when(F.col("doc_id").isNotNull(), F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - GRID).cast("double"))
    lo, hi, big = raw.agg(F.min(along), F.max(along), F.max("size")).first()
    place = F.when(F.lit((hi or 0) > (lo or 0)), (along - F.lit(lo)) / F.lit(max((hi or 0) - (lo or 0), 1)) * top).otherwise(F.lit(0))
    size = F.log2(F.col("size").cast("double")) / F.log2(F.lit(float(max(big or 2, 2)))) * top
    return raw.select(
        "row", "doc_id", "size", "crc", "tie", "lang", "source",
        F.coalesce(place.cast("long"), F.lit(top)).alias("id"),
        F.least(size.cast("long"), F.lit(top)).alias("bytes"),
    )


DIMS = ("bytes", "id", "lang", "source")


def place(dims: list[int], node: Column) -> Column:
    """The strict place of a row along the dimension of its node."""
    along = F.get(F.array(*[F.col(d) for d in DIMS]), F.get(F.array(*[F.lit(d) for d in dims]), node))
    return F.shiftleft(along, TIE).bitwiseOR(F.col("tie"))


def descend(rows: DataFrame, level: list[Node]) -> DataFrame:
    """``rows`` with ``node`` moved to the children, numbered 2 i and 2 i + 1."""
    cuts = F.get(F.array(*[F.lit(n.cut).cast("long") for n in level]), F.col("node"))
    right = place([n.dim for n in level], F.col("node")) >= cuts
    return rows.withColumn("node", F.col("node") * 2 + F.when(right, 1).otherwise(0))


def median(tagged: DataFrame, level: list[Node], each: float) -> None:
    """Choose dimension and cut of all nodes of a level that hold several shards."""
    got = tagged.groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{k}_{d}") for d in DIMS for k, f in (("lo", F.min), ("hi", F.max))]).collect()
    goal, base, span = {}, [0] * len(level), GRID + TIE
    for r in got:
        n = level[r.node]
        if n.hi - n.lo > 1:
            n.dim = max(range(len(DIMS)), key=lambda d: r[f"hi_{DIMS[d]}"] - r[f"lo_{DIMS[d]}"])
            goal[r.node] = r.w * ((n.hi - n.lo) // 2) / (n.hi - n.lo)
    while goal:
        shift = max(0, span - max(1, min(BITS, MOST_BITS - len(goal).bit_length())))
        p = place([n.dim for n in level], F.col("node")) - F.get(F.array(*[F.lit(b).cast("long") for b in base]), F.col("node"))
        seen = tagged.where(F.col("node").isin(*goal)).withColumn("p", p).where((F.col("p") >= 0) & (F.col("p") < (1 << span)))
        sums = defaultdict(list)
        for r in seen.groupBy("node", F.shiftright("p", shift).alias("bin")).agg(F.sum("size").alias("w"), F.count("*").alias("k")).collect():
            sums[r.node].append((r.bin, r.w, r.k))
        for i in list(goal):
            bins = sorted(sums[i])
            for b, w, k in bins:
                if w >= goal[i] or b == bins[-1][0]:
                    base[i] += b << shift
                    if k == 1 or shift == 0 or w <= NEAR * each:  # the cut goes to the nearer side of the bin
                        level[i].cut = base[i] if goal.pop(i) <= w / 2 else base[i] + (1 << shift)
                    break
                goal[i] -= w
        span = shift


def build(rows: DataFrame, shards: int) -> tuple[DataFrame, list[Node]]:
    """``rows`` with ``node``, and the leaves that it numbers."""
    each = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    level = [Node(0, shards)]
    first = tagged = rows.withColumn("node", F.lit(0))
    while any(n.hi - n.lo > 1 for n in level):
        median(tagged, level, each)
        before, tagged = tagged, storage.stage(rows.sparkSession, descend(tagged, level), "tree_level")
        if before is not first:
            storage.discard(rows.sparkSession, before)
        halves = [(n, n.lo + (n.hi - n.lo) // 2 if n.hi - n.lo > 1 else n.hi) for n in level]
        level = [c for n, mid in halves for c in (Node(n.lo, mid), Node(mid, n.hi))]
    return tagged, level


def shard(docs: DataFrame, shards: int = 40, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", target_bytes: int | None = None) -> DataFrame:
    """``row``, ``doc_id``, ``size``, ``crc``, ``shard`` and ``slot`` (gapless in its shard) of every row,
    in ``shards`` shards, or in as many as leaves of ``target_bytes`` take."""
    rows = points(docs, id_col, text_col, lang_col, source_col)
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if target_bytes is not None:
        shards = max(1, -(-size // target_bytes))
    placed, leaves = build(rows, shards)
    placed = placed.select("row", "doc_id", "size", "crc", "tie", F.get(F.array(*[F.lit(n.lo) for n in leaves]), F.col("node")).alias("shard"))
    buckets = max(16, total // (shards * SLOT_ROWS))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("tie"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("k"))
    counts = counts.select("shard", "bucket", F.expr("sum(k) over (partition by shard order by bucket) - k").alias("before"))
    within = placed.withColumn("at", F.expr("row_number() over (partition by shard, bucket order by tie, row) - 1"))
    out = within.join(counts, ["shard", "bucket"])
    return out.select("row", "doc_id", "size", "crc", "shard", (F.col("before") + F.col("at")).alias("slot"))


def op4_kd_shards(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, sizes near equal."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
