"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code-point order (null last) weigh ``WEIGHTS`` in turn and
share ``share`` of all words; a target stops at ``most`` times its source and
the excess is reshared by weight. A source is taken whole as often as its target
allows, and the rest of the target is drawn from it without replacement.

Unit: a block, ``BLOCK_ROWS`` documents of one source or more (at most about
``MOST_BLOCKS`` in all), chosen by hash of id and text, so a block is a random
sample of its source. The rest of a target is the first blocks in a seeded
order; the block that straddles its end is filled document by document in a
seeded order, first fit, so a source misses its target by less than a document.

Tree: the exact number of block copies of each source is split among the output
shards by halving them: the left half gets a multivariate-hypergeometric draw
from the node's counts, the right half the remainder. The driver splits down to
``DRIVER_NODES`` nodes, tasks split on below them. At a leaf each source has an
exact quota, drawn as the next disjoint range of its permuted block copies. Rows
are then shuffled within their shard only.

There is no limit to sources, shards or quotas: orders and running sums come
from sorted ranges (`storage.running`), the water level of the targets from sums
over the table of sources. The driver holds one count a source. All seeds come
from names, so reruns agree.

Defined cases: null and empty texts have size 0 and are taken with their block;
a text of any length is one document; a null source is a source of its own, the
last; a null id is hashed as any id; repeated rows are drawn one by one, and
blocks that they overfill are divided by the rows' places in their files; an
empty table gives an empty result; other columns are ignored by ``plan`` and, of
whatever names, kept by ``mix``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import storage

WEIGHTS = (5, 2, 1)
BLOCK_ROWS = 512
MOST_BLOCKS = 1_000_000
BLOCKS_A_SHARD = 4
DRIVER_NODES = 256
#: Rows of a straddling block broadcast at most; beyond it rows of such blocks are shuffled.
FEW = 500_000


def targets(sizes: list[int], share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> list[float]:
    """Targets of sources in order: shares by weight, capped, the excess reshared."""
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while free:
        level = left / sum(weight[i] for i in free)
        over = {i for i in free if level * weight[i] > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = level * weight[i]
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def levelled(sources: DataFrame, share: float, most: float) -> DataFrame:
    """The staged ``sources`` (words, weight) with their ``target``: the water level
    rises as sources fill up, and each turn is one sum over the table."""
    total, whole = sources.agg(F.sum("words"), F.sum("weight")).first()
    level, full = share * (total or 0) / (whole or 1), -1
    over = lambda: F.lit(level) * F.col("weight") > F.lit(float(most)) * F.col("words")
    while True:
        words, weight, n = sources.agg(F.sum(F.when(over(), F.col("words"))), F.sum(F.when(~over(), F.col("weight"))), F.count(F.when(over(), 1))).first()
        if n == full or not weight:
            break
        level, full = (share * total - most * (words or 0)) / weight, n
    return sources.withColumn("target", F.when(over(), F.lit(float(most)) * F.col("words")).otherwise(F.lit(level) * F.col("weight")))


def seed_of(*names) -> int:
    return int.from_bytes(hashlib.sha256(repr(names).encode()).digest()[:8], "big")


def halve(lo: int, hi: int, counts: np.ndarray, total: int, shards: int, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """The two halves of a node: shards ``lo`` to ``hi`` - 1 have ``counts`` blocks of each source, ``total`` blocks are in all."""
    room = lambda a, b: (b - a) * (total // shards) + max(0, min(b, total % shards) - a)
    mid = (lo + hi) // 2
    rng = np.random.default_rng([seed, lo, hi])
    left = rng.multivariate_hypergeometric(counts, room(lo, mid), method="marginals")
    return [(lo, mid, left), (mid, hi, counts - left)]


def descend(lo: int, hi: int, nos: np.ndarray, counts: np.ndarray, total: int, shards: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The leaves below a node: shard, sources, their quotas. Sources without blocks are left out on the way."""
    stack = [(lo, hi, nos, counts)]
    while stack:
        lo, hi, nos, counts = stack.pop()
        nos, counts = nos[counts > 0], counts[counts > 0]
        if hi - lo == 1 or not len(nos):
            yield lo, nos, counts
        else:
            stack += [(a, b, nos, c) for a, b, c in halve(lo, hi, counts, total, shards, seed)]


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas (source, shard): rows add up to ``counts``, columns differ by one at most."""
    out = np.zeros((len(counts), shards), np.int64)
    for shard, nos, have in descend(0, shards, np.arange(len(counts)), counts, int(counts.sum()), shards, seed):
        out[nos, shard] = have
    return out


def quotas(spark, nos: np.ndarray, counts: np.ndarray, shards: int, seed: int) -> DataFrame:
    """``no``, ``shard`` and ``quota`` (over 0) of all leaves; tasks split what is below ``DRIVER_NODES`` nodes."""
    total, level = int(counts.sum()), [(0, shards, nos, counts)]
    while len(level) < DRIVER_NODES and any(hi - lo > 1 for lo, hi, _, _ in level):
        level = [x for lo, hi, n, c in level for x in ([(a, b, n[h > 0], h[h > 0]) for a, b, h in halve(lo, hi, c, total, shards, seed)] if hi - lo > 1 and len(n) else [(lo, hi, n, c)])]
        if not any(len(n) and hi - lo > 1 for lo, hi, n, _ in level):
            break

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo, hi, n, c in f.itertuples(index=False):
                for shard, have, quota in descend(lo, hi, np.asarray(n, np.int64), np.asarray(c, np.int64), total, shards, seed):
                    yield pd.DataFrame({"no": have, "shard": np.full(len(have), shard), "quota": quota})

    rows = spark.createDataFrame([(lo, hi, n.tolist(), c.tolist()) for lo, hi, n, c in level], "lo long, hi long, nos array<long>, counts array<long>")
    return rows.repartition(min(len(level), int(spark.conf.get("spark.sql.shuffle.partitions"))), "lo").mapInPandas(run, "no long, shard long, quota long")


def fill(gap: int, sizes: np.ndarray) -> np.ndarray:
    """Which of the documents, in order, go into ``gap`` words: first fit, then the one
    addition or exchange of two documents that comes nearest to it."""
    took = np.zeros(len(sizes), bool)
    for i, x in enumerate(sizes.tolist()):
        if x <= gap:
            gap -= x
            took[i] = True
    if gap and not took.all():
        out = np.flatnonzero(~took)
        into = np.concatenate(([-1], np.flatnonzero(took)))  # -1: nothing is given back
        give = np.where(into < 0, 0, sizes[into])
        order = np.argsort(give, kind="stable")
        at = np.searchsorted(give[order], sizes[out] - gap)
        near = np.stack([order[np.clip(at - 1, 0, len(order) - 1)], order[np.clip(at, 0, len(order) - 1)]])
        miss = np.abs(gap - (sizes[out] - give[near]))
        side, a = np.unravel_index(np.argmin(miss), miss.shape)
        if miss[side, a] < gap:
            took[out[a]] = True
            if into[near[side, a]] >= 0:
                took[into[near[side, a]]] = False
    return took


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows taken of straddling blocks: rows come sorted by source, hash and row, one block a source."""
    source, gap, rows, sizes = None, 0, [], []

    def taken() -> pa.RecordBatch:
        took = fill(gap, np.array(sizes, np.int64)) if rows else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(np.array(rows, np.int64)[took])], ["row"])

    for b in batches:
        out = []
        for no, row, size, room in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if no != source:
                out.append(taken())
                source, gap, rows, sizes = no, room, [], []
            rows.append(row)
            sizes.append(size)
        yield from pa.Table.from_batches(out, pa.schema([("row", pa.int64())])).combine_chunks().to_batches()
    yield taken()


class Mix:
    """The plan of a mix: staged tables of sources, blocks and the rows taken of straddling blocks."""

    def __init__(self, rows: DataFrame, share: float, most: float, seed: int, shards: int | None):
        spark = rows.sparkSession
        self.seed, self.total = seed, rows.count()
        most_copies = int(most)
        each = max(BLOCK_ROWS, self.total // MOST_BLOCKS)
        sources = storage.stage(spark, rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "sources")
        sources = storage.running(sources, [], ["source is null", "source"], at="no")
        sources = sources.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("no") % len(WEIGHTS)).cast("int")))
        sources = levelled(storage.stage(spark, sources, "weights"), share, most)
        full = F.when(F.col("words") > 0, F.least(F.floor(F.col("target") / F.col("words")), F.lit(most_copies))).otherwise(0).cast("int")
        sources = sources.withColumn("full", full).withColumn("rest", F.greatest(F.rint(F.col("target") - F.col("full") * F.col("words")), F.lit(0)).cast("long"))
        sources = sources.select(self.source_key().alias("skey"), "n", "no", F.col("words").alias("source_size"), "target", "full", "rest", F.ceil(F.col("n") / each).alias("blocks"))
        self.sources = storage.stage(spark, sources, "sources")

        self.heavy = None
        known = self.blocked(rows)
        sums = self.sums(known)
        heavy = sums.where(F.col("n") > 4 * each).select("nb", "n", F.ceil(F.col("n") / each).alias("parts"))
        if not heavy.isEmpty():  # rows of one id and text: divided by their places
            self.heavy = storage.stage(spark, heavy, "heavy")
            known = self.blocked(rows)
            sums = self.sums(known)

        # the rest of each target: whole blocks in a seeded order, then the one that straddles the end
        sums = storage.running(sums, ["no"], [f"xxhash64('rest', {seed}, no, block)", "block"], ("words",))
        whole = (F.col("words_before") + F.col("words") <= F.col("rest")) & (F.col("rest") > 0)
        part = ~whole & (F.col("words_before") < F.col("rest"))
        sums = sums.select("nb", "no", "block", "n", "full", whole.alias("whole"), F.when(part, F.col("rest") - F.col("words_before")).alias("gap"))
        sums = storage.stage(spark, sums, "blocks")

        # the tree: block copies of each source, split among the shards
        once_more = F.col("whole") | F.col("gap").isNotNull()
        have = sums.groupBy("no").agg(F.sum(F.col("full") + once_more.cast("int")).alias("k")).where("k > 0").orderBy("no").toPandas()
        nos, counts = have.no.to_numpy(np.int64), have.k.to_numpy(np.int64)
        shards = shards or max(16, int(counts.sum()) // BLOCKS_A_SHARD)
        leaves = storage.stage(spark, quotas(spark, nos, counts, shards, seed_of("tree", seed)), "quotas")
        slots = storage.running(leaves, ["no"], ["shard"], ("quota",))
        slots = slots.select("no", "shard", F.explode(F.expr("sequence(quota_before, quota_before + quota - 1)")).alias("at"))
        copies = sums.withColumn("copy", F.explode(F.expr("sequence(0, full)"))).where((F.col("copy") < F.col("full")) | once_more)
        copies = storage.running(storage.stage(spark, copies.select("nb", "no", "block", "copy"), "copies"), ["no"], [f"xxhash64('draw', {seed}, no, block, copy)", "block", "copy"])
        drawn = copies.join(slots, ["no", "at"]).groupBy("nb").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("copies"))  # at most `most` + 1 a block
        blocks = sums.select("nb", "n", "full", "gap").join(drawn, "nb", "left")
        self.blocks = storage.stage(spark, blocks, "drawn")

        edge = self.lookup_blocks(known).where("gap is not null")
        edge = edge.select("no", "row", "size", "gap", "h").repartition("no").sortWithinPartitions("no", "h", "row").drop("h")
        self.took = storage.stage(spark, edge.mapInArrow(_fill, "row long"), "straddling")
        self.few = self.took.count() <= FEW

    @staticmethod
    def source_key() -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("skey")

    def blocked(self, rows: DataFrame) -> DataFrame:
        """``rows`` (source, row, h) with their source's plan and ``nb``, the block."""
        kept = [c for c in rows.columns if c != "source"]
        known = storage.lookup(rows.select(*kept, self.source_key()), self.sources.withColumnRenamed("n", "source_rows"), "skey", self.total, "source_rows")
        block = F.pmod(F.xxhash64(F.lit("block"), F.lit(self.seed), "h"), "blocks")
        known = known.withColumn("nb", F.struct("no", block.alias("block"))).drop("skey", "source_rows")
        if self.heavy is not None:
            known = storage.lookup(known, self.heavy, "nb", self.total, "n")
            part = F.when(F.col("n").isNull(), F.col("nb.block")).otherwise(F.col("nb.block") + F.col("blocks") * (1 + F.pmod(F.xxhash64("row"), "parts")))
            known = known.withColumn("nb", F.struct("no", part.alias("block"))).drop("n", "parts")
        return known

    def sums(self, known: DataFrame) -> DataFrame:
        sums = known.groupBy("nb", "full", "rest").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        return storage.stage(known.sparkSession, sums.select("nb", "nb.no", "nb.block", "full", "rest", "words", "n"), "sums")

    def lookup_blocks(self, known: DataFrame) -> DataFrame:
        return storage.lookup(known.drop("full", "no"), self.blocks.withColumn("no", F.col("nb.no")), "nb", self.total, "n", most=2 * MOST_BLOCKS)

    def assigned(self, rows: DataFrame) -> DataFrame:
        """``rows`` (source, row, h and others) with ``copies``, the output shards each goes to."""
        found = self.lookup_blocks(self.blocked(rows)).drop("n", "nb", "blocks", "rest")
        took = self.took.withColumn("extra", F.lit(True))
        if self.few:
            found = found.join(F.broadcast(took), "row", "left")
        else:
            edge = found.where("gap is not null").join(took, "row", "left")
            found = found.where("gap is null").withColumn("extra", F.lit(None).cast("boolean")).unionByName(edge)
        stays = F.col("gap").isNull() | F.coalesce("extra", F.lit(False))
        goes = F.filter(F.coalesce("copies", F.array().cast("array<struct<copy:int,shard:bigint>>")), lambda c: (c["copy"] < F.col("full")) | stays)
        return found.withColumn("copies", F.transform(goes, lambda c: c["shard"])).drop("gap", "full", "extra", "no")


def _hash(seed: int, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col)))


def _narrow(docs: DataFrame, row: str, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), _hash(seed, id_col, text_col).alias("h"))
    return storage.stage(docs.sparkSession, rows, "sizes")


def plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", share: float = 1.5, most: float = 2.0, seed: int = 17, shards: int | None = None) -> DataFrame:
    """``row``, ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` and
    ``copies`` (array of the output shards a row goes to) of every row."""
    docs, row = storage.numbered(docs)
    rows = _narrow(docs, row, id_col, text_col, source_col, seed)
    found = Mix(rows, share, most, seed, shards).assigned(rows)
    return found.select("row", "doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, shards: int | None = None, id_col="doc_id", text_col="text", source_col="source", share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: rows of ``docs``, repeated or left out as planned,
    gathered by output shard and shuffled within it. The plan meets the rows where
    they are read, so their texts are shuffled once."""
    numbered, row = storage.numbered(docs)
    made = Mix(_narrow(numbered, row, id_col, text_col, source_col, seed), share, most, seed, shards)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = made.assigned(numbered.select(F.col(row).alias("row"), F.col(source_col).cast("string").alias("source"), _hash(seed, id_col, text_col).alias("h"), whole))
    out = rows.select("row", "whole", F.posexplode("copies").alias("copy", "shard"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(n, "shard").sortWithinPartitions("shard", F.xxhash64("row", "copy"))
    return out.select("whole.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
