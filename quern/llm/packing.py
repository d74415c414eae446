"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids and are cut only if longer than a sequence; all
pieces but the first are then full and make sequences of their own. The other
pieces (at most one a document) are dealt by hash into blocks of about
``BLOCK_ITEMS``, a bin-packing problem each. Every block evolves on ``ISLANDS``
islands at once: a genome is a set of bins, crossover injects whole well-filled
bins of one parent into the other, bins that now hold a piece twice are
dissolved, and what they displace is put back by best fit, longest first. Most
crossovers inject the giver's full bins that leave the full bins of the other
alone, so that islands add up what they found. Mutation takes a few bins that
aren't full and some others apart and groups their pieces anew, each bin led by its
longest piece and filled as far as any subset of the others can (sums as a bit
set); what is no worse stays, so that free room gathers in few bins and frees them. A
search ends at the lower bound. After each epoch the islands are written
to shared storage and every island gets its neighbour's elite. Pieces left in
badly filled bins are pooled over all blocks and packed once more.

A block loses less than one sequence against packing it with others, so the loss
is below one in a thousand and doesn't grow. No step holds more than a block.

Tokens: the ids are those of the tokenizer file. The `tokenizers` library encodes
0.9 MB a second and core here, so the vocabulary of a plain byte-level BPE file is
run by `tiktoken` (4.3 MB); files of another kind, texts with a special token's
string in them, and texts with more blanks in a row than `tiktoken` can take, go
through `tokenizers` itself. A test compares both. A worker process builds an
encoder once, and the library's only when a text needs it.

Defined cases: null and empty texts are the end token alone; a null id is carried;
repeated rows are documents of their own; a text of any length is encoded whole (a
task holds its text and ids); an empty table gives an empty result; other columns
are ignored. Seeds come from block, island and epoch.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import storage

EOS = 2
SEQ_LEN = 1024
BLOCK_ITEMS = 16384
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 4
POPULATION = 4
TRIES = 2400  # groups of bins that a mutation takes apart
OPEN, OTHERS = 4, (1, 1, 1, 1, 4)  # bins of such a group: not full, and any (one of these numbers)
POOR = 0.97  # bins filled less are pooled and packed once more

# Fixed value: the pre-tokenisation pattern of the public byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: More blanks in a row than the fast way takes well: its pattern's stack ends, and long tokens are merged slowly.
BLANK_RUN = re.compile(r"\s{5000}")
#: Texts answered at a time.
SOME = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, spec: str):
        import tiktoken

        parsed = json.loads(spec)
        self.spec = spec
        self.special = [t["content"] for t in parsed.get("added_tokens", [])]
        ranks = self._ranks(parsed)
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    @cached_property
    def whole(self):
        """The library's tokenizer."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        """Byte strings to ids, if the file is a plain byte-level BPE whose ids follow its merges."""
        model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
        plain_pre = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        unlike = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
        if model.get("type", "BPE") != "BPE" or not plain_pre or spec.get("normalizer") or spec.get("truncation") or any(unlike):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocab.get(m, -1) for m in merged]
        if len(vocab) != 256 + len(merged) or ids != sorted(ids) or not all(c in byte_of for k in vocab for c in k):
            return None
        return {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special) or BLANK_RUN.search(text):
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids)
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        return ids.astype("<u4").tobytes()


@lru_cache(maxsize=1)
def encoder(spec: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(spec)


def pieces(docs: DataFrame, tokenizer: str | None = None, id_col="doc_id", text_col="text", with_ids: bool = False) -> DataFrame:
    """``row``, ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` (little-endian bytes)."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(spec.value), np.array([EOS], "<u4").tobytes()
        for b in (whole.slice(i, SOME) for whole in batches for i in range(0, whole.num_rows, SOME)):
            source, out = [], []
            for i, cell in enumerate(b.column(2)):
                ids = encode(cell.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % SEQ_LEN or SEQ_LEN, n + 1, SEQ_LEN)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * s : 4 * e]
                    source.append(i)
                    out.append((k, s, e - s, zlib.crc32(part), part if with_ids else b""))
            at = pa.array(source, pa.int64())
            cols = list(zip(*out, strict=True)) or [[]] * 5
            made = [b.column(0).take(at), b.column(1).take(at), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:4]]]
            yield pa.RecordBatch.from_arrays(made + [pa.array(cols[4], pa.binary())] * with_ids, ["row", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Packing:
    """A genome: the bin of each item (``of``) and the fill of each bin."""

    def __init__(self, sizes: np.ndarray, of: np.ndarray, room: int):
        self.sizes, self.room = sizes, room
        _, self.of = np.unique(of, return_inverse=True)
        self.fill = np.bincount(self.of, sizes).astype(np.int64) if len(of) else np.zeros(0, np.int64)

    def worth(self) -> float:
        """Fewer bins first; among as many, the more unevenly filled."""
        return -len(self.fill) + float(np.mean((self.fill / self.room) ** 2)) if len(self.fill) else 0.0


def best_fit(sizes: np.ndarray, of: np.ndarray, loose: np.ndarray, room: int) -> np.ndarray:
    """Put the items ``loose`` (bin -1) into the fullest bin that takes them, longest first; a bit set of free rooms finds it at once."""
    of = of.copy()
    free = np.full(int(of.max(initial=-1)) + 1, room, np.int64)
    np.subtract.at(free, of[of >= 0], sizes[of >= 0])
    by: list[list[int]] = [[] for _ in range(room + 1)]
    bits = 0
    for b, f in enumerate(free.tolist()):
        by[f].append(b)
        bits |= 1 << f
    new = len(free)
    for i in loose[np.argsort(-sizes[loose], kind="stable")].tolist():
        n = int(sizes[i])
        fits = bits >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = by[f].pop()
            if not by[f]:
                bits &= ~(1 << f)
        else:
            f, b, new = room, new, new + 1
        of[i] = b
        by[f - n].append(b)
        bits |= 1 << (f - n)
    return of


def cross(into: Packing, giver: Packing, rng: np.random.Generator) -> Packing:
    """Inject whole well-filled bins of ``giver``; dissolve bins that hold a piece twice; best-fit what is displaced."""
    full = giver.fill / giver.room
    if rng.random() < 0.75:  # full bins that break no full bin
        breaks = np.zeros(len(full), bool)
        np.logical_or.at(breaks, giver.of, (into.fill == into.room)[into.of])
        chosen = np.flatnonzero((giver.fill == giver.room) & ~breaks)
    else:
        chosen = np.flatnonzero((full >= np.quantile(full, 0.3)) & (rng.random(len(full)) < rng.uniform(0.2, 0.7)))
    inside = np.isin(giver.of, chosen)
    broken = np.zeros(len(into.fill), bool)
    broken[into.of[inside]] = True
    of = np.where(inside, giver.of + len(into.fill), np.where(broken[into.of], -1, into.of))
    return Packing(into.sizes, best_fit(into.sizes, of, np.flatnonzero(of < 0), into.room), into.room)


def regrouped(sizes: list[int], items: list[int], room: int, rnd: random.Random) -> list[list[int]]:
    """Bins of ``items``: each has the longest piece left and the subset of the others, met in random order, that fills it furthest."""
    items = sorted(items, key=lambda i: -sizes[i])
    out = []
    while items:
        first, others = items[0], items[1:]
        left = room - sizes[first]
        rnd.shuffle(others)
        sums, goal, within, steps = 1, 1 << left, (2 << left) - 1, []  # a bit a sum that can be had
        for i in others:
            more = (sums | sums << sizes[i]) & within
            if more != sums:
                steps.append((i, sums))
                sums = more
                if sums & goal:
                    break
        at, taken = sums.bit_length() - 1, [first]
        for i, before in reversed(steps):
            if not before >> at & 1:
                taken.append(i)
                at -= sizes[i]
        out.append(taken)
        gone = set(taken)
        items = [i for i in items if i not in gone]
    return out


def mutate(p: Packing, rng: np.random.Generator, tries: int = TRIES) -> Packing:
    """Group the pieces of a few bins anew, ``tries`` times; what is worse is not taken."""
    rnd, sizes, room = random.Random(int(rng.integers(1 << 62))), p.sizes.tolist(), p.room
    bins: list[list[int]] = [[] for _ in p.fill]
    for i, b in enumerate(p.of.tolist()):
        bins[b].append(i)
    fill, least, open_ = p.fill.tolist(), -(-int(p.sizes.sum()) // room), []
    for k in range(tries):
        if len(bins) <= least:
            break
        if k % 256 == 0:
            open_ = [b for b, f in enumerate(fill) if f < room]
        if len(open_) < 2:
            break
        chosen = sorted({*rnd.sample(open_, min(OPEN, len(open_))), *(rnd.randrange(len(bins)) for _ in range(rnd.choice(OTHERS)))})
        new = regrouped(sizes, [i for b in chosen for i in bins[b]], room, rnd)
        if len(new) > len(chosen):
            continue
        filled = [sum(sizes[i] for i in b) for b in new]
        if len(new) == len(chosen) and sum(f * f for f in filled) < sum(fill[b] ** 2 for b in chosen):
            continue
        for b, items, f in zip(chosen, new, filled):  # noqa: B905 - what is left of chosen is freed
            bins[b], fill[b] = items, f
        if len(new) < len(chosen):
            for b in reversed(chosen[len(new) :]):
                bins[b], fill[b] = bins[-1], fill[-1]
                bins.pop()
                fill.pop()
            open_ = [b for b, f in enumerate(fill) if f < room]
    of = np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        of[items] = b
    return Packing(p.sizes, of, room)


def evolve(sizes: np.ndarray, start: list[np.ndarray], room: int, seed: list[int], generations: int = GENERATIONS) -> list[Packing]:
    """One epoch of an island; the population, best first."""
    rng = np.random.default_rng(seed)
    everything, none = np.arange(len(sizes)), np.full(len(sizes), -1)
    pool = [Packing(sizes, of, room) for of in start]
    if not pool:
        pool = [Packing(sizes, best_fit(sizes, none, everything, room), room)]
    while len(pool) < POPULATION:  # newcomers: best fit over a part, the rest afterwards
        some = rng.random(len(sizes)) < 0.5
        of = best_fit(sizes, none, everything[some], room)
        pool.append(Packing(sizes, best_fit(sizes, of, everything[~some], room), room))
    least = -(-int(sizes.sum()) // room)
    for _ in range(generations):
        pool.sort(key=Packing.worth, reverse=True)
        if len(pool[0].fill) <= least:
            break
        other = pool[1 + int(rng.integers(len(pool) - 1))]
        pool.append(mutate(cross(pool[0], other, rng), rng, TRIES // 4))
        pool.append(mutate(max(pool, key=Packing.worth), rng))
        pool = sorted(pool, key=Packing.worth, reverse=True)[:POPULATION]
    return sorted(pool, key=Packing.worth, reverse=True)


def pack_blocks(items: DataFrame, room: int = SEQ_LEN, level: int = 0) -> DataFrame:
    """``items`` (any columns and ``row``, ``piece``, ``length``) with ``block``, ``bin`` and ``offset``."""
    spark = items.sparkSession
    items = storage.stage(spark, items, "items")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    dealt = items.select(F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(blocks)).alias("block"), F.struct("row", "piece", *[c for c in items.columns if c not in ("row", "piece")]).alias("item"))
    # about BLOCK_ITEMS narrow rows a block, dealt by hash: no key of the data decides
    dealt = dealt.groupBy("block").agg(F.array_sort(F.collect_list("item")).alias("items"))
    dealt = storage.stage(spark, dealt.withColumn("sizes", F.transform("items", lambda x: x["length"].cast("int"))), "bins")
    state = dealt.select("block", "sizes", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.array().cast("array<array<int>>").alias("pool"))
    schema = "block long, island int, pool array<array<int>>, worth double"
    for epoch in range(EPOCHS):

        def run(batches: Iterator[pa.RecordBatch], epoch=epoch) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    block, sizes, island, pool = (c[i].as_py() for c in b.columns)
                    best = evolve(np.array(sizes, np.int64), [np.array(p) for p in pool], room, [level, block, island, epoch])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([island], pa.int32()), pa.array([[p.of.tolist() for p in best[:2]]], pa.list_(pa.list_(pa.int32()))), pa.array([best[0].worth()], pa.float64())], ["block", "island", "pool", "worth"])

        n = min(blocks * ISLANDS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        grown = storage.stage(spark, state.repartition(n, "block", "island").mapInArrow(run, schema), "islands")
        if epoch + 1 < EPOCHS:  # every island's elite moves on to the next one
            elite = grown.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("pool")[0].alias("elite"))
            state = grown.join(elite, ["block", "island"]).join(dealt.select("block", "sizes"), "block")
            state = state.select("block", "sizes", "island", F.concat("pool", F.array("elite")).alias("pool"))
    best = grown.groupBy("block").agg(F.max_by(F.col("pool")[0], F.struct("worth", -F.col("island"))).alias("of"))
    placed = dealt.join(best, "block").select("block", F.explode(F.arrays_zip("items", "of")).alias("z"))
    out = placed.select("block", "z.items.*", F.col("z.of").alias("bin"))
    return out.withColumn("offset", F.expr("sum(length) over (partition by block, bin order by row, piece) - length"))


def pack(cut: DataFrame, room: int = SEQ_LEN) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    cut = storage.stage(spark, cut, "pieces")
    full = cut.where(F.col("length") == room).select(*cut.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = storage.stage(spark, pack_blocks(cut.where(F.col("length") < room), room).withColumn("fill", F.expr("sum(length) over (partition by block, bin)")), "packed")
    number = lambda level: F.col("block") * F.lit(1 << 20) + F.col("bin") * 2 + level
    good = first.where(F.col("fill") >= POOR * room).select(*cut.columns, number(0).alias("sequence_id"), "offset")
    again = pack_blocks(first.where(F.col("fill") < POOR * room).select(cut.columns), room, 1).select(*cut.columns, number(1).alias("sequence_id"), "offset")
    return full.unionByName(good).unionByName(again)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places."""
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("row")
