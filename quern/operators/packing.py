"""Sequence packers of the corpus builder.

* ``stream_rows``/``stream_pieces``: documents joined end to end in each shard
  and cut every ``seq_len`` tokens, as window arithmetic (no user code);
* ``bos_best_fit``: documents that start with a BOS, the largest that fits from a
  bounded buffer, the shortest cropped when none does; state flows through a
  sorted shard, so it streams;
* ``chat_best_fit``: closed pools of segments, longest first, padded.

Every shard or pool is bounded by the caller's sharding, never a whole source.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import storage


def planned_shards(docs: DataFrame, by: str, order: str, length: Column, cap: int) -> DataFrame:
    """Narrow ``docs`` with ``shard``: each source's rows dealt by their id over as many shards as its tokens ask for (``cap``
    each). They are written once, so that lengths are counted once."""
    sized = storage.stage(docs.sparkSession, docs.withColumn("n_tokens", length), "sized")
    plan = sized.groupBy(by).agg(F.greatest(F.ceil(F.sum("n_tokens") / cap), F.lit(1)).alias("shards"))
    plan = storage.stage(docs.sparkSession, plan, "shards")
    plan = F.broadcast(plan) if plan.count() <= 100_000 else plan  # a row a source
    return sized.join(plan, by).withColumn("shard", F.pmod(F.col(order), F.col("shards")).cast("long")).drop("shards", "n_tokens")


def stream_offsets(docs: DataFrame, shard: list[str], order: str, length: Column) -> DataFrame:
    """``docs`` with ``n`` (tokens with their end token), ``off``, ``total`` of the shard."""
    by = ", ".join(shard)
    out = docs.withColumn("n", (length + 1).cast("long"))
    out = out.withColumn("total", F.expr(f"sum(n) over (partition by {by})"))
    return out.withColumn("off", F.expr(f"sum(n) over (partition by {by} order by {order}) - n"))


def range_offsets(docs: DataFrame, shard: list[str], order: str, length: Column) -> DataFrame:
    """The same of documents that carry their own end token, whatever a shard holds: only keys and lengths
    are sorted, in ranges, and meet their documents by ``shard`` and the unique ``order``."""
    spark = docs.sparkSession
    docs = storage.stage(spark, docs.withColumn("n", length.cast("long")), "encoded")
    places = storage.running(docs.select(*shard, order, "n"), shard, [order], ("n",)).select(*shard, order, F.col("n_before").alias("off"))
    totals = docs.groupBy(*shard).agg(F.sum("n").alias("total"))
    return docs.join(places, [*shard, order]).join(totals, shard)


def stream_pieces(offsets: DataFrame, seq_len: int, target: int | None = None) -> DataFrame:
    """A row per piece of a document in a packed row: ``row``, ``lo``, ``hi`` within the document."""
    rows = F.floor(F.col("total") / seq_len)
    most = F.least(rows, F.lit(target)) if target is not None else rows
    first, last = F.floor(F.col("off") / seq_len), F.floor((F.col("off") + F.col("n") - 1) / seq_len)
    out = offsets.withColumn("row", F.explode(F.sequence(first, last))).where(F.col("row") < most)
    lo = F.greatest(F.col("row") * seq_len - F.col("off"), F.lit(0)).cast("long")
    hi = F.least((F.col("row") + 1) * seq_len - F.col("off"), F.col("n")).cast("long")
    return out.withColumn("lo", lo).withColumn("hi", hi)


def stream_rows(pieces: DataFrame, shard: list[str], ids: str) -> DataFrame:
    """The packed rows: ``ids`` of each row in order."""
    cut = F.slice(F.col(ids), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("part")
    got = pieces.select(*shard, "row", "off", cut).groupBy(*shard, "row").agg(F.array_sort(F.collect_list(F.struct("off", "part"))).alias("parts"))
    return got.select(*shard, "row", F.flatten(F.transform("parts", lambda p: p["part"])).alias("ids"))


class BosBuffer:
    """Documents by length: the largest that fits and the shortest of all, the oldest among equals."""

    def __init__(self):
        self.lengths: list[int] = []
        self.queues: dict[int, list] = {}
        self.size = 0

    def add(self, length: int, item) -> None:
        if length not in self.queues:
            bisect.insort(self.lengths, length)
            self.queues[length] = []
        self.queues[length].append(item)
        self.size += 1

    def _take(self, at: int):
        length = self.lengths[at]
        queue = self.queues[length]
        item = queue.pop(0)
        if not queue:
            del self.queues[length], self.lengths[at]
        self.size -= 1
        return length, item

    def take_fitting(self, room: int):
        at = bisect.bisect_right(self.lengths, room) - 1
        return self._take(at) if at >= 0 else None

    def take_shortest(self):
        return self._take(0)


def bos_rows(lengths: Iterator[tuple[object, int]], seq_len: int, buffer: int, stats: dict) -> Iterator[list[tuple[object, int]]]:
    """Packed rows as lists of (document, tokens taken from its start). A last unfilled row isn't emitted."""
    pool, source = BosBuffer(), iter(lengths)

    def refill() -> None:
        while pool.size < buffer and (nxt := next(source, None)) is not None:
            stats["in"] += nxt[1]
            pool.add(nxt[1], nxt[0])

    refill()
    while pool.size:
        row, room = [], seq_len
        while room and pool.size:
            got = pool.take_fitting(room)
            if got is None:
                length, doc = pool.take_shortest()
                row.append((doc, room))
                stats["dropped"] += length - room
                room = 0
            else:
                row.append((got[1], got[0]))
                room -= got[0]
            refill()
        if room:
            stats["partial"] += seq_len - room
            return
        yield row


def bos_best_fit(docs: DataFrame, shard: str, order: str, length: str, seq_len: int, buffer: int = 1000, target: int | None = None) -> DataFrame:
    """``shard``, ``row``, ``ord``, ``at`` (place in the row) and ``taken`` of every use of a
    document, and a row with ``row`` = -1 whose ``ord``, ``at`` and ``taken`` are the
    shard's tokens in, tokens dropped and tokens left in an unfilled row. At most
    ``target`` rows a shard, if given."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records():
            for f in frames:
                yield from zip(f["shard"].tolist(), f["ord"].tolist(), f["n"].tolist(), strict=True)

        stream = records()
        ahead = next(stream, None)
        while ahead is not None:
            name, out, stats = ahead[0], [], {"in": 0, "dropped": 0, "partial": 0}

            def of_shard():
                nonlocal ahead
                while ahead is not None and ahead[0] == name:  # noqa: B023
                    now = ahead
                    ahead = next(stream, None)
                    yield now[1], now[2]

            for i, row in enumerate(bos_rows(of_shard(), seq_len, buffer, stats)):
                at = 0
                for doc, taken in row:
                    out.append((name, i, doc, at, taken))
                    at += taken
                if i + 1 == target:
                    break
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=["shard", "row", "ord", "at", "taken"])
                    out = []
            for _ in of_shard():  # what a full shard leaves unread
                pass
            out.append((name, -1, stats["in"], stats["dropped"], stats["partial"]))
            yield pd.DataFrame(out, columns=["shard", "row", "ord", "at", "taken"])

    rows = docs.select(F.col(shard).cast("long").alias("shard"), F.col(order).cast("long").alias("ord"), (F.col(length) + 1).cast("long").alias("n"))
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "ord")
    return dealt.mapInPandas(run, "shard long, row long, ord long, at long, taken long")


def chat_best_fit(segments: DataFrame, keys: list[str], order: str, length: str, seq_len: int, pool: int = 4000) -> DataFrame:
    """Segments with ``pool``, ``row`` and ``at``: pools of ``pool`` segments in order, each
    packed longest first, one descending scan a row; rows are padded to ``seq_len``."""
    numbered = storage.running(storage.stage(segments.sparkSession, segments, "segments"), keys, [order], at="pool")
    numbered = numbered.withColumn("pool", F.floor(F.col("pool") / pool).cast("long"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([length, order], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes, left, row = group[length].tolist(), list(range(len(group))), 0
        rows, ats = [0] * len(group), [0] * len(group)
        while left:
            at, rest = 0, []
            for i in left:
                if at + sizes[i] <= seq_len:
                    rows[i], ats[i] = row, at
                    at += sizes[i]
                else:
                    rest.append(i)
            if len(rest) == len(left):
                raise ValueError("a segment is longer than a row")
            left, row = rest, row + 1
        return group.assign(row=rows, at=ats)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields) + ", row long, at long"
    return numbered.groupBy(*keys, "pool").applyInPandas(run, schema)
