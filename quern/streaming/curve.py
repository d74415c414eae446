"""Structured Streaming: metric curves and packing with carried state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def curve(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """An append-only folder of JSON metric records as a stream."""
    return spark.readStream.schema(schema).json(folder)


def health(spark: SparkSession, folder: str, schema: str, column: str = "ts", every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Samples counted and averaged in windows, with a watermark."""
    rows = spark.readStream.schema(schema).option("header", True).csv(folder).withWatermark(column, late)
    numbers = [f.name for f in rows.schema.fields if f.dataType.typeName() == "double"]
    return rows.groupBy(F.window(column, every)).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in numbers])


def replay(rows: DataFrame, path: str, checkpoint: str):
    """Write a stream's rows once, as far as they are there (restarts go on from the checkpoint)."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hooked(rows: DataFrame, checkpoint: str, template: str, call: Callable[[str], None], step: str = "step", where: str = "ckpt"):
    """For each record that arrives, ``call`` the template with its {step} and {ckpt}; a failure is
    printed and doesn't end the stream. Records of a micro-batch are saves, a few at a time."""

    def run(batch: DataFrame, _: int) -> None:
        for r in batch.select(step, where).orderBy(step).toLocalIterator():
            try:
                call(template.replace("{step}", str(r[0])).replace("{ckpt}", str(r[1])))
            except Exception as e:  # noqa: BLE001 - a hook must not stop what it watches
                print(f"hook failed at step {r[0]}: {e}")

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stop_gracefully(query, wait: float = 60.0) -> bool:
    """Let a stream finish what it has begun, then stop it; its checkpoint goes on from there. True if it was idle in time."""
    end = time.monotonic() + wait
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(0.1)
    idle = not (query.isActive and query.status["isTriggerActive"])
    query.stop()
    return idle


PACKED = "shard long, row long, ids array<int>"
STATE = "rest array<int>, rows long"


def pack_stream(docs: DataFrame, seq_len: int, eos: int) -> DataFrame:
    """Full rows of a stream of documents (``shard``, ``ord``, ``ids``): joined end to end with an end
    token, in ``ord`` within what arrives together; less than a row is carried as state. What arrives
    together for a shard is sorted as a whole, so a trigger bounds it (`maxFilesPerTrigger`)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, rows = state.get if state.exists else ([], 0)
        rest, out = [int(x) for x in rest], []
        arrived = pd.concat(list(frames))  # a group comes in several frames
        for ids in arrived.sort_values("ord", kind="stable")["ids"]:
            rest += [*(int(x) for x in ids), eos]
            full = len(rest) // seq_len
            out += [(key[0], rows + i, rest[i * seq_len : (i + 1) * seq_len]) for i in range(full)]
            rest, rows = rest[full * seq_len :], rows + full
        if out:
            yield pd.DataFrame(out, columns=["shard", "row", "ids"])
        state.update((rest, rows))

    return docs.groupBy("shard").applyInPandasWithState(run, PACKED, STATE, "append", GroupStateTimeout.NoTimeout)
