"""SimHash near-duplicates by multi-index hashing.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of the
word shingles. Two fingerprints are linked at ``radius`` = 3 differing bits or
fewer. Of their two 32-bit segments one then differs in one bit at most, so
each segment is a hash table and every fingerprint probes both with the ball of
radius 1 round its own segment. A pair that differs in a bit is met from the
side where that bit is 0, so only those flips are enumerated (half the ball).
Matches are verified by the complete distance. Only distinct fingerprints take
part, so exact copies cost nothing, and links are contracted to components by
alternating large and small stars, each round written to shared storage.

Defined cases: null, empty and blank texts have fingerprint zero, linked like
any other; fewer words than a shingle make one shingle; a text of any length is
taken whole; a null id never names a component unless all its ids are null;
repeated rows share a component; an empty table gives an empty result; other
columns, whatever their names, are ignored or, by ``keep_one``, kept. Rows are
told apart by their place in their file (`storage.numbered`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import storage
from quern.llm import shingle_links

SEED = 42
RADIUS = 3
#: Hashes whose bits are counted at a time: a bound on memory for any text.
BLOCK = 1 << 14
#: Rows answered at a time.
SOME = 256
#: Characters between words.
BLANKS = " \t\n\x0b\x0c\r"


def shingle_blocks(text: str | None, width: int) -> Iterator[list[bytes]]:
    """The word shingles of a text, repeats included, up to ``BLOCK`` at a time; all its words if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, as the contract has it
    if not words:
        return
    line = b" ".join(words)
    if len(words) <= width:
        yield [line]
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width]))
    stops = ends[width - 1 :] - 1
    del words
    for i in range(0, len(starts), BLOCK):
        yield [line[a:b] for a, b in zip(starts[i : i + BLOCK].tolist(), stops[i : i + BLOCK].tolist(), strict=True)]


def shingle_set(text: str | None, width: int) -> set[bytes]:
    """The different word shingles of a text."""
    return {s for found in shingle_blocks(text, width) for s in found}


def sketch(text: str | None, width: int = 3, least: np.ndarray | None = None) -> int:
    """The signed 64-bit fingerprint of a text; min-hashes ``least`` take in its shingles."""
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, np.int64), 0
    for found in shingle_blocks(text, width):
        n += len(found)
        raw = np.frombuffer(b"".join([digest(s, SEED) for s in found]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        if least is not None:
            shingle_links.absorb(least, raw.view(np.uint64))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit fingerprint of a text."""
    return sketch(text, width)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, signed: bool = False, row_col: str | None = None) -> DataFrame:
    """``row`` (its number, or that in ``row_col``), ``doc_id`` and ``fp`` of every row;
    if ``signed``, its length in ``bytes``, ``signature`` of min-hashes and their ``bands`` too."""
    storage.small_batches(docs.sparkSession)
    if row_col is None:
        docs, row_col = storage.numbered(docs)

    def one(text: str | None) -> tuple[int, bytes | None, list[int]]:
        least = shingle_links.no_hashes()
        fp = sketch(text, width, least)
        if not (text or "").strip(BLANKS):
            return fp, None, []
        return fp, shingle_links.signature(least), shingle_links.band_keys(least.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, SOME) for i in range(0, whole.num_rows, SOME)):
                if not signed:
                    fp = pa.array([fingerprint(t.as_py(), width) for t in b.column(2)], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], ["row", "doc_id", "fp"])
                    continue
                fp, signature, bands = zip(*(one(t.as_py()) for t in b.column(2)), strict=True)
                out = [pa.array(fp, pa.int64()), pa.array([len(t.as_buffer() or b"") for t in b.column(2)], pa.int64()), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out], ["row", "doc_id", "fp", "bytes", "signature", "bands"])

    rows = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc_id {kind}, fp long" + (", bytes long, signature binary, bands array<long>" if signed else ""))


def links(distinct: DataFrame) -> DataFrame:
    """All pairs ``u < v`` of distinct fingerprints (column ``fp``) that are linked."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    segments = F.array(F.struct(F.lit(0).alias("seg"), high.alias("part")), F.struct(F.lit(1).alias("seg"), low.alias("part")))
    parts = distinct.select("fp", F.explode(segments).alias("s")).select("fp", "s.seg", "s.part")
    tables = parts.select(F.col("fp").alias("other"), F.col("seg").alias("in_seg"), F.col("part").alias("in_key"))
    flips = F.filter(F.array(*[F.lit(0), *[F.lit(1 << i) for i in range(32)]]), lambda m: F.col("part").bitwiseAND(m) == 0)
    probes = parts.select("fp", "seg", "part", F.explode(flips).alias("flip"))
    probes = probes.select("fp", "seg", F.col("part").bitwiseOR(F.col("flip")).alias("key"), (F.col("flip") == 0).alias("same"))
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    near = F.bit_count(differ) <= RADIUS
    once = ~F.col("same") | (F.col("fp") < F.col("other"))  # within one bucket each pair is met from both sides
    first = (F.col("in_seg") == 0) | (F.bit_count(F.shiftrightunsigned(differ, 32)) > 1)  # else segment 0 has found it
    # the estimate of an exploded side is far too small, so no side may be broadcast on it
    joined = probes.hint("merge").join(tables, (F.col("seg") == F.col("in_seg")) & (F.col("key") == F.col("in_key")) & near & once & first)
    return joined.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) for every node of the
    undirected ``edges`` (u, v), by alternating large and small stars."""
    spark = edges.sparkSession
    edges, mark = storage.stage(spark, edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = storage.stage(spark, both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "least")
        above = storage.lookup(both.where("v > u"), least, "u", 2 * edges.count(), "n")  # a star's centre is no one's work alone
        large = above.select("v", "m").distinct()  # each neighbour above goes to the least one
        up = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        base = up.groupBy("u").agg(F.min("v").alias("m"))
        small = up.join(base, "u").select(F.col("v").alias("u"), "m").where("u > m").unionByName(base).distinct()
        done = storage.stage(spark, small.select(F.col("m").alias("u"), F.col("u").alias("v")), "stars")
        now = done.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        storage.discard(spark, edges)
        storage.discard(spark, least)
        edges = done
        if now == mark:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        mark = now


def similar(prints: DataFrame, distinct: DataFrame, texts: DataFrame, total: int, width: int, similarity: float) -> DataFrame:
    """Components (node, root) of linked fingerprints (staged: ``distinct``) and of
    similar ``texts`` (row, text), from the ``total`` staged signed ``prints``."""
    spark, shingles = prints.sparkSession, lambda t: shingle_set(t, width)
    met = shingle_links.buckets(prints)
    near = shingle_links.alike(shingle_links.led(prints, met, total, similarity), texts, shingles, similarity)
    linked = components(links(distinct.select("fp")).unionByName(near).distinct())
    roots = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    more = shingle_links.apart(prints, met, total, storage.stage(spark, roots, "roots"), texts, shingles, similarity)
    if more is None:
        return linked
    return components(linked.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(more).distinct())


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None, row_col: str | None = None) -> DataFrame:
    """``row``, ``doc_id``, ``fp``, ``component_id`` (least id of the component)
    and ``kept`` (one row of each component: of that id, the first by file and place).

    With a ``similarity``, texts whose shingles are that similar are linked too.
    """
    spark = docs.sparkSession
    if row_col is None:
        docs, row_col = storage.numbered(docs)
    prints = storage.stage(spark, fingerprints(docs, id_col, text_col, width, similarity is not None, row_col), "fingerprints")
    total = prints.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    distinct = storage.stage(spark, prints.groupBy("fp").agg(F.count("*").alias("n"), first), "distinct")
    if similarity is None:
        linked = components(links(distinct.select("fp")))
    else:
        texts = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
        linked = similar(prints, distinct, texts, total, width, similarity)
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("head"))
    table = rooted.join(named, "root").select("fp", "n", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("head_row"))
    table = storage.stage(spark, table, "components")
    found = storage.lookup(prints, table, "fp", total, "n")
    return found.select("row", "doc_id", "fp", "component_id", (F.col("row") == F.col("head_row")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each component, with all its columns."""
    docs, row = storage.numbered(docs)
    losers = near_classes(docs, id_col, text_col, width, similarity, row).where(~F.col("kept")).select(F.col("row").alias(row))
    return storage.without(docs, row, storage.stage(docs.sparkSession, losers, "near")).drop(row)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
