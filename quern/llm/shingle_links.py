"""Links between texts whose word shingles have a Jaccard similarity of 0.8 or more.

A 64-bit SimHash differs in about ten bits at that similarity, far beyond the
balls that multi-index hashing can enumerate, so a near-duplicate stage adds
these links to those of `simhash`. ``BANDS`` x ``ROWS`` min-hashes of the set of
shingles are taken; texts that agree on a whole band meet in a bucket (at 0.8 a
pair shares one of 32 bands of 8 with probability 0.997). A signature is the low
byte of each min-hash.

Each bucket is met with its leader, the member of least priority (a hash of its
fingerprint, the same in all buckets, so a group mostly has one leader). In
buckets whose other members these links leave in several components, the members
then meet with their texts in blocks: pairs of different components are taken,
the likeliest first, each in the first bucket it shares, unless a link found
before in the block has joined their components. So no pair of a bucket is missed
whatever text leads it; pairs within a component could change nothing. The share
of equal bytes estimates a pair's similarity with a deviation of 0.025 at 0.8 and
only refuses pairs that are over three and a half deviations (``MARGIN``) below
the similarity asked for; of all others the complete sets of shingles are
compared. Leaders of many members are broadcast (their number is bounded, see
`storage.lookup`) or get their text in several places, and blocks are bounded in
rows and bytes, so no group fills a task. No pair is written but found links and
those of members with leaders. The last meeting takes time with the square of the
unlike texts in a bucket, and sends a text to each block of it.

Texts without words have no signature and get no link here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import storage

SIMILARITY = 0.8
MARGIN = 0.09
BANDS, ROWS = 32, 8
#: Shingles hashed at a time: a bound on memory for any text.
SLICE = 2048
#: Signatures (256 bytes each) broadcast at most where the leaders are few.
FEW = 10_000
#: Pairs compared at a time.
FEW_ROWS = 512
PAIRS = "row long, lead long, fp long, lead_fp long"
#: Texts compared with one copy of their leader's.
EACH = 64
#: Members of a bucket in a block, and bytes of their texts; blocks are met two by two.
BLOCK = 512
BLOCK_BYTES = 16 << 20
#: Shingles kept at a time while pairs of a block are compared.
KEPT = 400_000
#: Pairs broadcast at most, so that texts in no pair stay where they are.
FEW_PAIRS = 150_000

_SALT = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint64).astype(np.uint32)
_FLIP, _TIMES = _SALT[0], _SALT[1] | np.uint32(1)


def absorb(least: np.ndarray, digests: np.ndarray) -> None:
    """Lower the min-hashes ``least`` by a block of 64-bit shingle digests."""
    low = np.unique(digests).astype(np.uint32)  # the lower halves
    for i in range(0, len(low), SLICE):
        np.minimum(least, ((low[i : i + SLICE] ^ _FLIP) * _TIMES).min(axis=1), out=least)


def no_hashes() -> np.ndarray:
    return np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)


def band_keys(hashes: bytes) -> list[int]:
    """A signed 64-bit key for each band, unlike those of other bands."""
    step = 4 * ROWS
    return [xxhash.xxh64_intdigest(hashes[i * step : (i + 1) * step], i) - (1 << 63) for i in range(BANDS)]


def signature(least: np.ndarray) -> bytes:
    """The low byte of each min-hash."""
    return least.astype(np.uint8).tobytes()


def agreement(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity: the share of equal min-hashes (of 256 unlike ones about one has the same byte)."""
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def buckets(sketches: DataFrame) -> DataFrame:
    """The staged buckets of the staged ``sketches`` (row, fp, signature, bands)
    that have two rows or more: key, n, lead, lead_fp."""
    members = sketches.select("row", "fp", F.explode("bands").alias("key"))
    priority = F.struct(F.xxhash64("fp").alias("rank"), "row", "fp")
    found = members.groupBy("key").agg(F.count("*").alias("n"), F.min(priority).alias("lead")).where("n > 1")
    return storage.stage(sketches.sparkSession, found.select("key", "n", F.col("lead.row").alias("lead"), F.col("lead.fp").alias("lead_fp")), "buckets")


def led(sketches: DataFrame, met: DataFrame, total: int, similarity: float = SIMILARITY) -> DataFrame:
    """Staged likely pairs (row, lead, fp, lead_fp) of the members of the buckets
    ``met`` with their leaders; ``total`` sketches."""
    spark = sketches.sparkSession
    members = sketches.select("row", "fp", F.explode("bands").alias("key"))
    met = storage.lookup(members, met, "key", total, "n").where("lead <> row and lead_fp <> fp")
    pairs = storage.stage(spark, met.groupBy("row", "lead").agg(F.first("fp").alias("fp"), F.first("lead_fp").alias("lead_fp")), "pairs")
    signatures = sketches.select("row", "signature")
    leads = pairs.groupBy("lead").agg(F.count("*").alias("n")).hint("merge").join(signatures, F.col("lead") == F.col("row"))
    leads = storage.stage(spark, leads.select("lead", "n", F.col("signature").alias("lead_signature")), "leads")
    both = storage.lookup(pairs.hint("merge").join(signatures, "row"), leads, "lead", pairs.count(), "n", most=FEW)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, FEW_ROWS) for whole in batches for i in range(0, whole.num_rows, FEW_ROWS)):
            near = [agreement(x.as_py(), y.as_py()) >= similarity - MARGIN for x, y in zip(b.column(4), b.column(5), strict=True)]
            yield b.select([0, 1, 2, 3]).filter(pa.array(near, pa.bool_()))

    found = both.select("row", "lead", "fp", "lead_fp", "signature", "lead_signature").mapInArrow(likely, PAIRS)
    return storage.stage(spark, found, "likely")


def parted(sketches: DataFrame, met: DataFrame, total: int, roots: DataFrame) -> DataFrame:
    """Staged: the members other than the leader of the buckets ``met`` that have several ``roots``
    (staged: fp, n, root), once for each pair of blocks they are in: key, low, high, own, row, fp, root."""
    spark = sketches.sparkSession
    rooted = storage.lookup(sketches.select("row", "fp", "bytes", "bands"), roots, "fp", total, "n").select("row", "fp", "bytes", "root", F.explode("bands").alias("key"))
    members = storage.lookup(rooted, met.where("n > 2"), "key", total, "n").where("lead <> row").select("key", "row", "fp", "bytes", "root")
    members = storage.stage(spark, members, "members")
    # a component with many members of a bucket has blocks of its own, which needn't meet each other
    count = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))
    parts = members.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).withColumn("own", count(F.col("n"), F.col("bytes")))
    many = F.col("own") > 1
    mixed = parts.groupBy("key").agg(
        F.count("*").alias("roots"),
        F.sum("n").alias("n"),
        F.coalesce(count(F.sum(F.when(~many, F.col("n"))), F.sum(F.when(~many, F.col("bytes")))), F.lit(0)).alias("few"),
        F.collect_list(F.when(many, F.struct("root", "own"))).alias("own"),
    )
    owned = "flatten(transform(own, x -> transform(sequence(0L, x.own - 1), i -> concat(x.root, '/', i))))"
    pooled = "if(few > 0, transform(sequence(0L, few - 1), i -> concat('-/', i)), array())"
    mixed = storage.stage(spark, mixed.where("roots > 1").select("key", "n", "few", "own", F.expr(f"concat({owned}, {pooled})").alias("blocks")), "mixed")
    rows = storage.lookup(members, mixed, "key", members.count(), "n").where("n is not null").withColumn("mine", F.expr("get(filter(own, x -> x.root = root), 0).own"))
    rows = rows.withColumn("name", F.expr("if(mine is null, '-', string(root))"))
    rows = rows.withColumn("own", F.expr("concat(name, '/', pmod(xxhash64(row), coalesce(mine, few)))"))
    rows = rows.withColumn("other", F.explode(F.expr("filter(blocks, x -> mine is null or not startswith(x, concat(name, '/')))")))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "row", "fp", "root")
    return storage.stage(spark, rows, "blocks")


class Block:
    """Members of two blocks of a bucket (or of one, met with itself) with their texts."""

    def __init__(self, cells: list[tuple], shingles: Callable[[str], set[bytes]], similarity: float):
        self.key, self.low, self.high = cells[0][:3]
        self.own = np.array([c[3] for c in cells])
        self.fp, self.root = [c[4] for c in cells], np.array([c[5] for c in cells], np.int64)
        self.signs = np.frombuffer(b"".join(c[6] for c in cells), np.uint8).reshape(len(cells), -1)
        self.bands = np.array([c[7] for c in cells], np.int64)
        self.texts, self.shingles, self.similarity = [c[8] for c in cells], shingles, similarity
        self.sets: dict[int, set[bytes]] = {}

    def likely(self) -> Iterator[tuple[int, int]]:
        """Pairs of different roots that this bucket is the first to hold, the likeliest first."""
        found = []
        for i in np.flatnonzero(self.own == self.low).tolist():
            others = (self.root != self.root[i]) & (self.own == self.high)
            if self.low == self.high:
                others[: i + 1] = False
            at = np.flatnonzero(others)
            near = (self.signs[at] == self.signs[i]).mean(axis=1)
            at, near = at[near >= self.similarity - MARGIN], near[near >= self.similarity - MARGIN]
            first = np.argmax(self.bands[at] == self.bands[i], axis=1)
            mine = self.bands[i][first] == self.key
            found.append((near[mine], np.full(int(mine.sum()), i), at[mine]))
        if found:
            near, a, b = map(np.concatenate, zip(*found, strict=True))
            for k in np.argsort(-near, kind="stable").tolist():
                yield int(a[k]), int(b[k])

    def taken(self, i: int) -> set[bytes]:
        if i not in self.sets:
            if sum(map(len, self.sets.values())) > KEPT:
                self.sets.clear()
            self.sets[i] = self.shingles(self.texts[i])
        return self.sets[i]

    def links(self) -> list[tuple[int, int]]:
        """Links that join the roots of the block."""
        parent, out = {}, []

        def head(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for i, j in self.likely():
            a, b = head(int(self.root[i])), head(int(self.root[j]))
            if a == b:
                continue
            ours, theirs = self.taken(i), self.taken(j)
            shared = len(ours & theirs)
            if shared / (len(ours) + len(theirs) - shared) >= self.similarity:
                parent[a] = b
                out.append((min(self.fp[i], self.fp[j]), max(self.fp[i], self.fp[j])))
        return out


def apart(sketches: DataFrame, met: DataFrame, total: int, roots: DataFrame, texts: DataFrame, shingles: Callable[[str], set[bytes]], similarity: float = SIMILARITY) -> DataFrame | None:
    """Links (u < v, fingerprints) between similar members, other than the leader, of the
    buckets ``met`` that have different ``roots`` (staged: fp, n, root); None if no bucket has such members."""
    spark, rows = sketches.sparkSession, parted(sketches, met, total, roots)
    if rows.isEmpty():
        return None
    need = storage.stage(spark, rows.select("row").distinct(), "needed")
    need = F.broadcast(need) if need.count() <= FEW_PAIRS else need.hint("merge")
    sides = texts.join(need, "row").join(sketches.select("row", "signature", "bands").hint("merge"), "row")
    sides = storage.stage(spark, sides.select("row", "signature", "bands", "text"), "sides")
    given = rows.hint("merge").join(sides, "row").select("key", "low", "high", "own", "fp", "root", "signature", "bands", "text")
    given = given.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[tuple] = []

        def found() -> pa.RecordBatch:
            made = Block(cells, shingles, similarity).links() if len(cells) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.int64()) for k in (0, 1)], ["u", "v"])

        for b in batches:
            for cell in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cells and cells[0][:3] != cell[:3]:
                    yield found()
                    cells = []
                cells.append(cell)
        yield found()

    return given.mapInArrow(run, "u long, v long").where("u <> v").distinct()


def alike(pairs: DataFrame, texts: DataFrame, shingles: Callable[[str], set[bytes]], similarity: float) -> DataFrame:
    """Of the staged ``pairs`` (row, lead, fp, lead_fp) of unlike rows those whose sets of shingles are similar, as fingerprints ``u < v``."""
    spark, total = pairs.sparkSession, pairs.count()
    counts = storage.stage(spark, pairs.groupBy("lead").agg(F.count("*").alias("n")), "counts")
    slot = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / EACH)).alias("slot")
    members = storage.lookup(pairs, counts, "lead", total, "n").select("lead", slot, F.lit(1).alias("side"), "row", "fp", "lead_fp")
    leads = members.select("lead", "slot", F.lit(0).alias("side"), F.col("lead").alias("row"), F.col("lead_fp").alias("fp"), "lead_fp").distinct()
    sides = storage.stage(spark, members.unionByName(leads), "sides")
    met = texts.join(F.broadcast(sides) if total <= FEW_PAIRS else sides.hint("merge"), "row")
    met = met.select("lead", "slot", "side", "fp", "lead_fp", "text").repartition("lead", "slot").sortWithinPartitions("lead", "slot", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours: set[bytes] = set()
        for b in (whole.slice(i, FEW_ROWS) for whole in batches for i in range(0, whole.num_rows, FEW_ROWS)):
            near = []
            for side, text in zip(b.column(2).to_pylist(), b.column(5), strict=True):
                found = shingles(text.as_py())
                if side == 0:  # the leader comes before its members
                    ours = found
                shared = len(ours & found)
                near.append(side == 1 and shared / (len(ours) + len(found) - shared) >= similarity)
            yield b.select([3, 4]).filter(pa.array(near, pa.bool_()))

    kept = met.mapInArrow(compare, "fp long, lead_fp long").where("fp <> lead_fp")
    return kept.select(F.least("fp", "lead_fp").alias("u"), F.greatest("fp", "lead_fp").alias("v")).distinct()
