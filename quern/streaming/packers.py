"""Best-fit packing of streams, with the buffer as keyed state.

Documents of a shard carry their place ``ord`` (0, 1, 2, ...) and their length ``n``; a record
without a length, whose ``ord`` is the number of documents, closes the shard. They may
arrive in any order and in any micro-batches: those that come early wait in state until
their turn, so the rows equal those of `packing.bos_best_fit` over the same
documents. A step is taken only when the buffer is full (or the shard closed), as the
batch packer does; the buffer, the row in progress and the counts are state, so
a restart goes on in the middle of a row.

Each call of the state store is a round trip between processes. So those that wait lie in
blocks of ``BLOCK`` successive places: a micro-batch reads and writes a block that it
touches once, whatever it holds. Rows leave in frames of about ``OUT`` uses.

Defined cases: a place that comes again is ignored once used; documents beyond the closing record
and shards that are never closed wait; a closed shard without documents gives
its counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from quern.operators.packing import BosBuffer

ROWS = "shard long, row long, ord long, at long, taken long"
POOL = "next long, row long, room long, at long, read long, dropped long, ords array<long>, lengths array<long>"
WAITING = "ords array<long>, lengths array<long>"
BLOCK, OUT = 512, 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class StepPacker:
    """The batch packer one step at a time; ``used`` takes (row, document, place in the row, taken)."""

    seq_len: int
    buffer: int
    row: int = 0
    room: int = 0  # of the row in progress; none is if 0
    at: int = 0
    read: int = 0
    dropped: int = 0
    pool: BosBuffer = field(default_factory=BosBuffer)
    used: list[tuple[int, int, int, int]] = field(default_factory=list)

    def add(self, ord_: int, n: int) -> None:
        self.read += n
        self.pool.add(n, ord_)
        while self.pool.size >= self.buffer:
            self._step()

    def finished(self) -> list[tuple[int, int, int, int]]:
        """The uses of full rows, once; those of the row in progress stay."""
        done, self.used = [u for u in self.used if u[0] < self.row], [u for u in self.used if u[0] == self.row]
        return done

    def close(self) -> int:
        """Take what is left; how many tokens an unfilled last row has, whose documents are taken back."""
        while self.pool.size:
            self._step()
        left = self.at if self.room else 0
        if left:
            self.used = [u for u in self.used if u[0] != self.row]
        return left

    def _step(self) -> None:
        if not self.room:
            self.room, self.at = self.seq_len, 0
        got = self.pool.take_fitting(self.room)
        if got is None:
            length, doc = self.pool.take_shortest()
            taken = self.room
            self.dropped += length - taken
        else:
            taken, doc = got
        self.used.append((self.row, doc, self.at, taken))
        self.at += taken
        self.room -= taken
        if not self.room:
            self.row += 1


class BestFit(StatefulProcessor):
    def __init__(self, seq_len: int, buffer: int):
        self.seq_len, self.buffer = seq_len, buffer

    def init(self, handle) -> None:
        self.pool = handle.getValueState("pool", POOL)
        self.early = handle.getMapState("early", "block long", WAITING)
        self.row = handle.getMapState("row", "at long", "ord long, taken long")  # documents of the row in progress

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802 - the engine's name
        nxt, packer = self._load()
        come: dict[int, dict[int, int | None]] = {}  # by block
        for f in rows:
            for o, n in zip(f["ord"].tolist(), f["n"].tolist(), strict=True):
                if o >= nxt:
                    come.setdefault(o // BLOCK, {})[o] = None if pd.isna(n) else int(n)
        closed, at, here, changed = None, None, {}, False  # the block of the next place
        while closed is None:
            if at != nxt // BLOCK:
                if at is not None:
                    self._keep(at, here, changed)
                at = nxt // BLOCK
                here, changed = self._waiting(at) | come.get(at, {}), at in come
                come.pop(at, None)
            if nxt not in here:
                break
            n, changed = here.pop(nxt), True
            nxt += 1
            if n is None:
                closed = packer.close()
            else:
                packer.add(nxt - 1, n)
            if closed is None and len(packer.used) >= OUT and packer.used[0][0] < packer.row:
                yield self._frame(key, packer.finished())
        if closed is None:
            self._keep(at, here, changed)
            for block, new in come.items():
                self._keep(block, self._waiting(block) | new)
            done = packer.finished()
            self._save(nxt, packer)
        else:
            done = [*packer.used, (-1, packer.read, packer.dropped, closed)]
            for state in (self.pool, self.early, self.row):
                state.clear()
        yield self._frame(key, done)

    @staticmethod
    def _frame(key, uses: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *u) for u in uses], columns=["shard", "row", "ord", "at", "taken"])

    def _waiting(self, block: int) -> dict[int, int | None]:
        """What waits in a block."""
        if not self.early.containsKey((block,)):
            return {}
        ords, lengths = self.early.getValue((block,))
        return dict(zip(ords, lengths, strict=True))

    def _keep(self, block: int, waiting: dict[int, int | None], changed: bool = True) -> None:
        if waiting and changed:
            self.early.updateValue((block,), (list(waiting), list(waiting.values())))
        elif changed and self.early.containsKey((block,)):
            self.early.removeKey((block,))

    def close(self) -> None:
        pass

    def _load(self) -> tuple[int, StepPacker]:
        packer = StepPacker(self.seq_len, self.buffer)
        if not self.pool.exists():
            return 0, packer
        nxt, packer.row, packer.room, packer.at, packer.read, packer.dropped, ords, lengths = self.pool.get()
        for o, n in zip(ords, lengths, strict=True):
            packer.pool.add(int(n), int(o))
        begun = sorted((int(k[0]), v) for k, v in self.row.iterator())
        packer.used = [(packer.row, int(v[0]), at, int(v[1])) for at, v in begun]
        return nxt, packer

    def _save(self, nxt: int, packer: StepPacker) -> None:
        waiting = [(o, n) for n in packer.pool.lengths for o in packer.pool.queues[n]]  # of one length the oldest first
        self.pool.update((nxt, packer.row, packer.room, packer.at, packer.read, packer.dropped, [o for o, _ in waiting], [n for _, n in waiting]))
        self.row.clear()
        for row, doc, at, taken in packer.used:
            if row == packer.row:
                self.row.updateValue((at,), (doc, taken))


def stateful(spark: SparkSession) -> None:
    """Let the session's streams keep this kind of state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def best_fit(docs: DataFrame, seq_len: int, buffer: int = 1000) -> DataFrame:
    """Packed rows of a stream of documents (``shard``, ``ord``, ``n`` with the end token), as `packing.bos_best_fit` gives them."""
    stateful(docs.sparkSession)
    return docs.select("shard", "ord", "n").groupBy("shard").transformWithStateInPandas(BestFit(seq_len, buffer), ROWS, "append", "None")
