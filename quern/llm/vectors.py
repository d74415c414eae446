"""What the vector operators share: which rows have a usable vector, and vectors as integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import storage


def finite(vec: Column) -> Column:
    """True where ``vec`` is neither null nor has a null, NaN or infinite component."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(whole, F.lit(False))


def scaled(table: DataFrame, keep: dict[str, str], vec_col: str, scale: int, largest: int, multiple: int = 1) -> tuple[DataFrame, int]:
    """The staged rows that have a usable vector, and its dimension: the columns of
    ``keep`` (new name to old) and ``x``, the components floor(scale * component).

    Usable are finite vectors of the dimension that most of them have (ties: the
    larger), among dimensions that ``multiple`` divides, zero not being one. A component whose
    integer is beyond ``largest`` stops the query with a message.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = table.where(finite(vec)).select(*[F.col(old).alias(new) for new, old in keep.items()], vec.alias("vec"))
    whole = lambda c: F.floor(F.lit(float(scale)) * c)
    refuse = F.raise_error(F.lit(f"a vector component is beyond {largest / scale:g}")).cast("long")
    ints = F.transform("vec", lambda c: F.when(F.abs(c) > F.lit(largest / scale), refuse).otherwise(whole(c)))
    rows = storage.stage(table.sparkSession, rows.select(*keep, ints.alias("x")), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().where((F.col("d") > 0) & (F.col("d") % multiple == 0))
    most = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.where(F.size("x") == d) if d else rows.where(F.lit(False)), d


def matrix(batch, d: int, name: str = "x") -> np.ndarray:
    """A batch's vectors as a matrix of 64-bit integers."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, d)


def nonempty(batches) -> Iterator:
    return (b for b in batches if b.num_rows)
