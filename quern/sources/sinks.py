"""Sinks: packed rows, shards, manifests and metric curves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quern import storage
from quern.functions.text import uniform
from quern.operators import reports


def shuffled(rows: DataFrame, path: str, seed: int, key: list[str]) -> None:
    """All rows in one seeded order over range partitions; ids and masks stay together, being one row."""
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    rows.orderBy(order, *key).write.mode("errorifexists").parquet(path)


def sharded(rows: DataFrame, path: str) -> None:
    """One folder a source and shard, not shuffled; the reader does that."""
    rows.write.mode("errorifexists").partitionBy("source", "shard").parquet(path)


def blocked(rows: DataFrame, path: str, order: list[str], block_rows: int = 1 << 16) -> None:
    """Packed rows with their global ``index`` by ``order``, a folder a block of so many rows, sorted within it:
    `readers.rows_at` finds any of them. Places come from ranges; a row moves once."""
    placed = storage.running(storage.stage(rows.sparkSession, rows, "packed"), [], order, at="index")
    placed = placed.withColumn("block", F.floor(F.col("index") / block_rows).cast("long")).repartition("block").sortWithinPartitions("block", "index")
    placed.write.mode("errorifexists").partitionBy("block").parquet(path)
    manifest(rows.sparkSession.createDataFrame([(block_rows,)], "block_rows long"), f"{path}/_blocks")


def written(rows: DataFrame, path: str, names: list[str], by: str = "source", length: str = "n", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``rows`` and return what was written: ``by``, ``rows`` and ``tokens`` of each of ``names`` (the mix's sources,
    so a short list), and of all others under null. The totals are seen by the writing tasks (`observe`): no second pass."""
    seen = Observation(f"written-{uuid.uuid4().hex}")
    totals = []
    for i, name in enumerate([*names, None]):
        mine = ~F.coalesce(F.col(by).isin(*names), F.lit(False)) if name is None else F.col(by) == name
        totals += [F.count(F.when(mine, 1)).alias(f"rows_{i}"), F.coalesce(F.sum(F.when(mine, F.col(length))), F.lit(0)).cast("long").alias(f"tokens_{i}")]
    rows.observe(seen, *totals).write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    got = seen.get
    return rows.sparkSession.createDataFrame([(name, got[f"rows_{i}"], got[f"tokens_{i}"]) for i, name in enumerate([*names, None])], f"`{by}` string, rows long, tokens long")


def written_as_planned(rows: DataFrame, path: str, planned: dict[str, float], most: float = 0.01, **how) -> DataFrame:
    """The same for a mix of planned shares; a share that is off by more than ``most`` raises after the rows were written."""
    done = written(rows, path, list(planned), **how)
    by = done.columns[0]
    weights = rows.sparkSession.createDataFrame(list(planned.items()), f"`{by}` string, planned double")
    both = done.join(weights, by, "left").select(by, F.coalesce("planned", F.lit(0.0)).alias("planned"), F.col("tokens").alias("actual"))
    total = float(sum(planned.values())) or 1.0
    off = reports.shares(both.withColumn("planned", F.col("planned") * F.lit(1e9 / total)), by)
    reports.require_shares(off, most)
    return done


def manifest(rows: DataFrame, path: str) -> None:
    """A one-row JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def append_curve(rows: DataFrame, path: str) -> None:
    """Append metric records, failures included."""
    rows.write.mode("append").json(path)


def split_holdout(rows: DataFrame, share: float, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows by a hash of their key."""
    u = uniform(seed, F.col(key))
    return rows.where(u >= share), rows.where(u < share)
