"""Subword vocabularies over tables.

`BytePairs` runs a byte-level BPE file (vocabulary and merges in order): texts are cut
into pre-tokens in the JVM and merged by rank in Arrow batches, each where it is read,
so neither texts nor pre-tokens are shuffled or written. A batch merges its distinct
pre-tokens once, and a worker remembers the latest short ones.
`Longest` segments by the longest entry of a vocabulary table, in a trie; every
distinct piece is segmented once.

A vocabulary is the driver's and every worker's whole, as a model file is: its size
is that of the file, whatever the texts. Texts have none of these bounds: a pre-token
of n bytes is merged in n log n steps.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import storage

# What byte-level vocabularies take for one pre-token.
PRETOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens that a worker remembers: up to about 70 MB.
REMEMBERED = 200_000

#: Characters of a short pre-token at most: it may be remembered, and is merged without a heap.
SHORT = 64

#: The rank of a pair that is no merge.
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next free one from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


def merged(symbols: list, ranks: dict) -> list:
    """``symbols`` after all merges, the lowest rank first and of equal ranks the leftmost."""
    n = len(symbols)
    symbols, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list[tuple] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0 and (rank := ranks.get((symbols[i], symbols[j]))) is not None:
            heapq.heappush(heap, (rank, i, symbols[i], symbols[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != left or symbols[j] != right:
            continue  # one of them has been merged since
        symbols[i], symbols[j] = left + right, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -1
        offer(before[i])
        offer(i)
    return [s for s in symbols if s is not None]


def segmented(texts: DataFrame, make: Callable[[], Callable[[str], list[int]]]) -> DataFrame:
    """``piece`` and ``ids`` of the distinct ``piece`` of ``texts``; ``make`` runs once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = make()
        for f in frames:
            yield pd.DataFrame({"piece": f["piece"], "ids": [code(p) for p in f["piece"]]})

    return texts.select("piece").distinct().mapInPandas(run, "piece string, ids array<int>")


class Merger:
    """Ids of a pre-token. It is sent once to a worker, whose copy remembers across batches and tasks."""

    def __init__(self, vocabulary: dict[str, int], ranks: dict[tuple[str, str], int]):
        self.vocabulary, self.ranks, self.letters = vocabulary, ranks, byte_letters()

    def long(self, piece: str) -> list[int]:
        return [self.vocabulary[s] for s in merged([self.letters[b] for b in piece.encode()], self.ranks)]

    @cached_property
    def short(self) -> Callable[[str], list[int]]:
        """The same over numbers of symbols, with the neighbours' ranks in a list: faster for a word, but quadratic."""
        symbols = list(dict.fromkeys([*self.letters, *(x for a, b in self.ranks for x in (a, b, a + b))]))
        number, n = {x: i for i, x in enumerate(symbols)}, len(symbols)
        ranks = {number[a] * n + number[b]: rank for (a, b), rank in self.ranks.items()}
        joined = {rank: number[a + b] for (a, b), rank in self.ranks.items()}
        first, ids, rank_of = [number[x] for x in self.letters], {i: self.vocabulary[x] for i, x in enumerate(symbols) if x in self.vocabulary}, ranks.get

        def merge(piece: str) -> list[int]:
            found = [first[b] for b in piece.encode()]
            ahead = [rank_of(a * n + b, NEVER) for a, b in zip(found, found[1:])]
            while ahead and (low := min(ahead)) != NEVER:
                i = ahead.index(low)
                found[i] = new = joined[low]
                del found[i + 1], ahead[i]
                if i:
                    ahead[i - 1] = rank_of(found[i - 1] * n + new, NEVER)
                if i < len(ahead):
                    ahead[i] = rank_of(new * n + found[i + 1], NEVER)
            return [ids[x] for x in found]

        return merge

    @cached_property
    def remembered(self) -> Callable[[str], list[int]]:
        return lru_cache(REMEMBERED)(self.short)

    def __call__(self, piece: str) -> list[int]:
        return self.remembered(piece) if len(piece) <= SHORT else self.long(piece)

    def batch(self, texts: pa.Array) -> pa.Array:
        """Lists of pre-tokens to lists of their ids."""
        pieces = texts.flatten().dictionary_encode()
        ids = pa.array(map(self, pieces.dictionary.to_pylist()), pa.list_(pa.int32())).take(pieces.indices)
        starts = pc.subtract(texts.offsets, texts.offsets[0])  # a text's first piece, then its first id
        return pa.ListArray.from_arrays(ids.offsets.take(starts), ids.values)


@dataclass(frozen=True)
class BytePairs:
    """Pieces (in the letters of bytes) to ids, and pairs of pieces to ranks."""

    vocabulary: dict[str, int]
    ranks: dict[tuple[str, str], int]

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BytePairs:
        """From a tokenizer file in JSON, wherever Spark can read it."""
        model = json.loads(spark.read.text(path, wholetext=True).first()[0])["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls(model["vocab"], {(a, b): i for i, (a, b) in enumerate(pairs)})

    @property
    def vocab_size(self) -> int:
        return len(self.vocabulary)

    def segment(self, texts: DataFrame) -> DataFrame:
        """``piece`` and ``ids`` of whole texts, cut into pre-tokens first."""
        whole = texts.select("piece").distinct()
        return self.encode(whole, "piece", F.col("piece")).select("piece", "ids")

    def encode(self, rows: DataFrame, key: str, text: Column) -> DataFrame:
        """``rows`` with ``ids``, their texts' tokens in order. A null or empty text has none. ``key`` names the rows, which are met by none."""
        storage.small_batches(rows.sparkSession)
        sent = rows.sparkSession.sparkContext.broadcast(Merger(self.vocabulary, self.ranks))

        @F.arrow_udf("array<int>")
        def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            merger = sent.value
            for t in texts:
                yield merger.batch(t)

        return rows.withColumn("ids", ids(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PRETOKEN), 0)))

    def decode(self, rows: DataFrame, ids: str = "ids", name: str = "decoded") -> DataFrame:
        """``rows`` with the text of ``ids``; ids that the vocabulary lacks are skipped, broken UTF-8 becomes U+FFFD."""
        back = {c: b for b, c in enumerate(byte_letters())}
        sent = rows.sparkSession.sparkContext.broadcast({i: bytes(back[c] for c in p) for p, i in self.vocabulary.items() if all(c in back for c in p)})

        @F.pandas_udf("string")
        def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            pieces = sent.value
            for s in parts:
                yield s.map(lambda x: None if x is None else b"".join(pieces.get(i, b"") for i in x).decode("utf-8", "replace"))

        return rows.withColumn(name, text(F.col(ids)))


@dataclass(frozen=True)
class Longest:
    """The longest entry at each place, from the left; a text with a place that no entry fits has no ids."""

    entries: dict[str, int]

    @classmethod
    def load(cls, table: DataFrame, piece: str, number: str) -> Longest:
        return cls({r[0]: r[1] for r in table.select(piece, number).toLocalIterator() if r[0]})

    def coder(self, spark: SparkSession) -> Callable[[], Callable[[str], list[int]]]:
        sent = spark.sparkContext.broadcast(self.entries)

        def make():
            trie: dict = {}
            for piece, number in sent.value.items():
                node = trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = number

            def code(text: str) -> list[int]:
                out, at = [], 0
                while at < len(text):
                    node, best, end, i = trie, None, at, at
                    while i < len(text) and (node := node.get(text[i])) is not None:
                        i += 1
                        if "" in node:
                            best, end = node[""], i
                    if best is None:
                        return []
                    out.append(best)
                    at = end
                return out

            return code

        return make

    def segment(self, texts: DataFrame) -> DataFrame:
        """``piece`` and ``ids`` of the distinct texts."""
        return segmented(texts, self.coder(texts.sparkSession))


def mapped(pieces: DataFrame, old, vectors: DataFrame, blank: str | None = "▁", special: list[str] | None = None) -> DataFrame:
    """What each piece (``id``, ``piece``) of a new vocabulary begins with: ``kind`` (one old token, several, or
    fallback), ``ids`` and ``vector``, the mean of the old tokens' vectors (``id``, ``vector``; one row an id) or,
    without any, of all of them. ``blank`` stands for a blank; a piece of blanks alone is one; special pieces are left
    to the caller. Old vectors meet the tokens by a lookup, so common tokens are no task's burden."""
    spark = pieces.sparkSession
    plain = F.replace(F.col("piece"), F.lit(blank), F.lit(" ")) if blank else F.col("piece")
    text = F.when(F.trim(plain) == "", F.lit(" ")).otherwise(plain)
    wanted = pieces.where(~F.col("piece").isin(*(special or [""]))).select("id", text.alias("piece"))
    coded = old.segment(wanted.where("piece is not null"))
    coded = storage.stage(spark, wanted.join(coded, "piece", "left").select("id", "piece", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), "coded")
    uses = storage.stage(spark, coded.select(F.col("id").alias("new"), F.explode("ids").alias("id")), "uses")
    known = vectors.join(uses.groupBy("id").agg(F.count("*").alias("n")), "id").select("id", "vector", "n")
    met = storage.lookup(uses, storage.stage(spark, known, "used_vectors"), "id", uses.count(), "n", most=10_000).where("n is not null")
    mean = _means(met.select("new", "vector"), ["new"])
    all_mean = F.broadcast(_means(vectors.select("vector"), []).withColumnRenamed("mean", "all_mean"))  # one row
    got = coded.join(mean.withColumnRenamed("new", "id"), "id", "left").join(all_mean, how="left")
    number = F.when(F.col("mean").isNull(), 0).otherwise(F.size("ids"))
    kind = F.when(number == 0, "fallback").when(number == 1, "one").otherwise("several")
    return got.select("id", "piece", "ids", kind.alias("kind"), F.coalesce("mean", "all_mean").alias("vector"))


def _means(rows: DataFrame, by: list[str]) -> DataFrame:
    """``mean``: the means of ``vector`` by place."""
    places = rows.select(*by, F.posexplode("vector").alias("at", "v")).groupBy(*by, "at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    whole = places.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("x"))
    return whole.select(*by, F.transform("x", lambda p: p["v"]).alias("mean"))
