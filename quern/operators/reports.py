"""Reconciliation, manifests and comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completion(actual: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned and actual tokens of each planned source, its completion and flags."""
    out = planned.join(actual, "source", "left").withColumn("actual", F.coalesce("actual", F.lit(0)).cast("long"))
    out = out.withColumn("done", F.col("actual") / F.greatest("planned", F.lit(1)))
    return out.withColumn("short", F.col("done") < 0.90).withColumn("slightly_short", F.col("done") < 0.99)


def shares(rows: DataFrame, by: str) -> DataFrame:
    """Planned and actual share of each group and their difference. ``rows``: by, planned, actual."""
    got = rows.groupBy(by).agg(F.sum("planned").alias("p"), F.sum("actual").alias("a"))
    total = rows.agg(F.greatest(F.sum("planned"), F.lit(1)).alias("tp"), F.greatest(F.sum("actual"), F.lit(1)).alias("ta"))
    return got.crossJoin(F.broadcast(total)).select(by, (F.col("p") / F.col("tp")).alias("planned_share"), (F.col("a") / F.col("ta")).alias("actual_share"), (F.col("a") / F.col("ta") - F.col("p") / F.col("tp")).alias("deviation"))


def require_shares(table: DataFrame, most: float = 0.01) -> None:
    """Raise if a share is off by more than ``most``."""
    worst = table.agg(F.max(F.abs("deviation"))).first()[0] or 0.0
    if worst > most:
        raise ValueError(f"a share deviates by {worst:.4f}; at most {most} is allowed")


def hash_verdicts(expected: DataFrame, *found: tuple[str, DataFrame]) -> DataFrame:
    """Registered digests beside others': ok, mismatch or skip (not there). All tables: file, sha."""
    out = expected
    for name, table in found:
        out = out.join(table.select("file", F.col("sha").alias(f"_{name}")), "file", "left")
        out = out.withColumn(name, F.when(F.col(f"_{name}").isNull(), "skip").when(F.col(f"_{name}") == F.col("sha"), "ok").otherwise("mismatch")).drop(f"_{name}")
    return out


def reconcile(want: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or unexpected."""
    return want.join(have, key, "left_anti").select(key, F.lit("missing").alias("state")).unionByName(have.join(want, key, "left_anti").select(key, F.lit("unexpected").alias("state")))


def preferred(rows: DataFrame, by: str, rank: str, value: str) -> DataFrame:
    """The value of the best-ranked row of each group."""
    return rows.groupBy(by).agg(F.min_by(value, rank).alias(value))


def grid(tags: DataFrame, tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Every tag with every task; blank where nothing was measured. Both lists are names of runs and tasks."""
    return tags.crossJoin(tasks).join(results, ["tag", "task"], "left")


def matrix_manifest(mix: str, seq_len: int, planned_total: int, planned: DataFrame, actual: DataFrame) -> DataFrame:
    """One row that describes a packed matrix. ``planned``: source, weight; ``actual``: source, tokens."""
    both = planned.join(actual, "source", "left").select("source", "weight", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    total = both.agg(F.sum("tokens").cast("long").alias("actual_total"), F.array_sort(F.collect_list(F.struct("source", "weight", "tokens"))).alias("x"))  # a row a source of the mix
    of = lambda value: F.map_from_entries(F.transform("x", lambda e: F.struct(e["source"], value(e))))
    return total.select(
        F.lit(mix).alias("mix"), F.lit(seq_len).cast("long").alias("seq_length"), F.lit(planned_total).cast("long").alias("planned_total"), "actual_total",
        of(lambda e: e["weight"]).alias("planned_weights"), of(lambda e: e["tokens"]).alias("actual_tokens"),
        of(lambda e: e["tokens"] / F.greatest("actual_total", F.lit(1))).alias("actual_weights"),
    )


def chat_manifest(mix: str, seq_len: int, packed: DataFrame, tasks: DataFrame, names: list[str]) -> DataFrame:
    """One row that describes packed conversations. ``packed``: mask; ``tasks``: task, rows, tokens."""
    supervised = F.sum(F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x)) / F.greatest(F.sum(F.size("mask")), F.lit(1))
    whole = packed.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.size("mask")), F.lit(0)).cast("long").alias("total_tokens"), supervised.alias("supervised_ratio"))
    each = tasks.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "rows")))).alias("rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "tokens")))).alias("actual_tokens"))
    head = [F.lit(mix).alias("mix"), F.lit(seq_len).cast("long").alias("seq_length")]
    return whole.crossJoin(each).select(*head, "chunks", "total_tokens", "supervised_ratio", F.array(*map(F.lit, names)).alias("tasks"), "rows", "actual_tokens")
