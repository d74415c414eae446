"""Quotas, shard plans, ordered cuts, epochs and seeded orders.

Orders are total and come from keys, never from partitions, so results don't
depend on how many tasks ran. Places and running sums come from sorted ranges
(`storage.running`), so neither a hot group nor the whole table is one task's work.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import storage


def quotas(weights: DataFrame, total: int, seq_len: int, cap: int, workers: int) -> DataFrame:
    """``source``, ``weight`` and ``files`` to tokens, shards and rows a shard."""
    out = weights.withColumn("tokens", F.floor(F.col("weight") * total).cast("long"))
    most = min(total // workers, cap)
    out = out.withColumn("shards", F.greatest(F.least(F.ceil(F.col("tokens") / most), F.col("files")), F.lit(1)).cast("long"))
    out = out.withColumn("shard_tokens", F.floor(F.col("tokens") / F.col("shards")).cast("long"))
    return out.withColumn("shard_rows", F.greatest(F.floor(F.col("shard_tokens") / seq_len), F.lit(1)).cast("long"))


def placed(rows: DataFrame, by: list[str], order: list[str], sums: tuple[str, ...] = (), at: str = "at") -> DataFrame:
    """Narrow ``rows`` with their place in their group, and running sums (see `storage.running`)."""
    return storage.running(storage.stage(rows.sparkSession, rows, "placed"), by, order, sums, at)


def round_robin(files: DataFrame, shards: int, by: str, order: str) -> DataFrame:
    """Files dealt in order to the shards of their source."""
    return placed(files, [by], [order], at="shard").withColumn("shard", (F.col("shard") % shards).cast("long"))


def token_budget(rows: DataFrame, by: str, order: str, length: Column, budget: int) -> DataFrame:
    """``by``, ``order``, ``n`` and ``before`` of the rows of each group until the budget is
    reached; the row that crosses it is the last."""
    out = placed(rows.select(by, order, length.cast("long").alias("n")), [by], [order], ("n",))
    return out.select(by, order, "n", F.col("n_before").alias("before")).where(F.col("before") < budget)


def first_of_each(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group (a window limit, so no group is gathered)."""
    return rows.withColumn("k", F.expr(f"row_number() over (partition by {by} order by {order})")).where(F.col("k") <= n)


def instances(parts: list[tuple[str, DataFrame, int | None]], order: str) -> DataFrame:
    """UNION ALL of tasks in list order; a task named twice is an epoch more. ``stop`` cuts each instance."""
    out = None
    for i, (name, rows, stop) in enumerate(parts):
        rows = rows.orderBy(order).limit(stop) if stop is not None else rows
        rows = rows.select(F.lit(i).cast("long").alias("instance"), F.lit(name).alias("task"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def seeded_key(seed, *key: str) -> Column:
    """The order of a seeded shuffle."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


#: Of `permuted`: rounds, the walk's steps and the round function's modulus and factor.
ROUNDS, WALK, PRIME, FACTOR = 6, 64, 2_147_483_647, 1_103_515_245


def round_keys(seed: int, epoch: int) -> list[int]:
    return [int(hashlib.md5(f"{seed}-{epoch}-{i}".encode()).hexdigest()[:7], 16) for i in range(ROUNDS)]


def permuted(index: Column, n: int, seed: int, epoch: int = 0, inverse: bool = False) -> Column:
    """The place of row ``index`` (0 to ``n`` - 1) in an epoch's order, or with ``inverse`` the row at a place.

    A keyed bijection, so no order is sorted or stored: an epoch, its resume and the rows
    of a place range are arithmetic. The index is split into x * b + y with a * b at
    least ``n``; rounds add a function of one half to the other, modulo a or b;
    a result beyond ``n`` goes through the rounds again (cycle walking), which
    ends within ``WALK`` steps (at most a results are beyond; larger tables are left with a chance below 1e-100).
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    keys = list(enumerate(round_keys(seed, epoch)))
    steps = F.array(*[F.struct(F.lit(i % 2 == 0).alias("x"), F.lit(k).cast("long").alias("key")) for i, k in (keys[::-1] if inverse else keys)])
    sign = -1 if inverse else 1

    def mixed(v: Column, key: Column) -> Column:
        h = (v * FACTOR + key) % PRIME
        return (h * h + key) % PRIME

    def turn(s: Column, k: Column) -> Column:
        x = F.when(k["x"], F.pmod(s["x"] + sign * mixed(s["y"], k["key"]), F.lit(a))).otherwise(s["x"])
        y = F.when(k["x"], s["y"]).otherwise(F.pmod(s["y"] + sign * mixed(s["x"], k["key"]), F.lit(b)))
        return F.struct(x.alias("x"), y.alias("y"))

    def once(v: Column) -> Column:
        start = F.struct(F.floor(v / b).cast("long").alias("x"), (v % b).cast("long").alias("y"))
        return F.aggregate(steps, start, turn, lambda s: s["x"] * b + s["y"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(index.cast("long")), lambda v, _: F.when(v >= n, once(v)).otherwise(v))
    return F.when(index.between(0, n - 1), F.when(walk < n, walk).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long")))


def epoch_rest(rows: DataFrame, index: str, n: int, seed: int, epoch: int, consumed: int, at: str = "at") -> DataFrame:
    """What an epoch still has to read of ``rows`` numbered by ``index``, with the place ``at``: a filter, nothing is shuffled."""
    return rows.withColumn(at, permuted(F.col(index), n, seed, epoch)).where(F.col(at) >= consumed)


def epoch_seed(seed: int, epoch: int) -> int:
    return seed * 1_000_003 + epoch


def resumed(rows: DataFrame, seed: int, epoch: int, consumed: int, key: str, held: int) -> DataFrame:
    """What an epoch still has to read: training rows (all but the last ``held`` by key) in the
    epoch's order, without the first ``consumed``."""
    train = rows.where(~tail(F.col(key), rows, key, held)).withColumn("_order", seeded_key(epoch_seed(seed, epoch), key))
    return placed(train, [], ["_order", key], at="_at").where(F.col("_at") >= consumed).drop("_order", "_at")


def after(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows without the first ``n`` by a unique key."""
    keys = placed(rows.select(key), [], [key], at="_at").where(F.col("_at") >= n)
    start = keys.agg(F.min(key)).first()[0]
    return rows.where(F.lit(False) if start is None else F.col(key) >= F.lit(start))


def tail(place: Column, rows: DataFrame, key: str, n: int) -> Column:
    """Whether a row is among the last ``n`` by key."""
    last = rows.orderBy(F.col(key).desc()).limit(n).agg(F.min(key)).first()[0]
    return place >= F.lit(last) if last is not None else F.lit(False)


def latest(steps: DataFrame, having: DataFrame, key: str = "step") -> DataFrame:
    """The largest step that also has its state."""
    return steps.join(having, key, "left_semi").agg(F.max(key).alias(key))


def batches(rows: DataFrame, key: str, length: str, size: int) -> DataFrame:
    """Rows with ``batch`` and ``width``: batches of ``size`` by length, as wide as their longest; the key gives the old order back."""
    out = placed(rows, [], [length, key], at="batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))
    return out.withColumn("width", F.max(length).over(Window.partitionBy("batch")))


def longest_first(rows: DataFrame, key: str, length: str, at: str = "turn") -> DataFrame:
    """The place of each row when the longest come first; the key gives the old order back."""
    return placed(rows, [], [f"-{length}", key], at=at)


def by_settings(requests: DataFrame, settings: list[str], key: str) -> DataFrame:
    """Requests of the same settings under one ``group`` number, in the order of their first request."""
    groups = requests.groupBy(*settings).agg(F.min(key).alias("_first"))
    groups = placed(groups, [], ["_first"], at="group")
    same = [requests[s].eqNullSafe(groups[s]) for s in settings]
    return requests.join(groups, same).select(*[requests[c] for c in requests.columns], groups["group"])
