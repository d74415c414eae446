"""Shared scratch storage: tables that cut lineage and survive a lost executor.

Everything goes below the folder named by ``spark.checkpoint.dir``, which the
driver and all executors see. Only a local session that names none gets a
temporary folder of its own.
"""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []

#: A broadcast side is built only from rows whose weights add up to ``total``
#: and are each at least ``total / HOT_KEYS``, so it has at most this many rows.
HOT_KEYS = 2000

#: Rows of an Arrow batch at most where texts go through Python: a batch of ten
#: thousand texts takes a few hundred MB in the executor and its worker.
ARROW_ROWS = 500

#: Bits of a row's number within its file.
IN_FILE = 36


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one in local tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:  # qualified, so that other readers than Spark's find the same place
        path = spark._jvm.org.apache.hadoop.fs.Path(named)
        path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return re.sub(r"^file:/(?!/)", "file:///", path)
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quern-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, staged: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    roots = {f.rpartition("/")[0] for f in staged.inputFiles()}
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to ``ARROW_ROWS``, if they are more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, name: str = "_quern_row") -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and that column's name (a free one).

    The number is the file's place among the sorted files of the scan and the
    row's place in its file, so it is the same in every scan, however the files
    are split and whichever executors there are. What isn't a scan of Parquet
    files is written to the shared folder first.
    """
    spark, columns = docs.sparkSession, docs.columns
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema
    except AnalysisException:
        docs = stage(spark, docs, "rows")
    meta, name = docs.metadataColumn("_metadata"), free_name(columns, name)
    path, place = free_name([*columns, name], "_quern_file"), free_name([*columns, name], "_quern_at")
    short = lambda f: re.sub("^([^:/]+):///", r"\1:/", f)
    files = json.dumps(sorted({short(f) for f in docs.inputFiles()}))
    number = free_name([*columns, name, path, place], "_quern_no")
    table = spark.range(1).select(F.posexplode(F.from_json(F.lit(files), "array<string>")).alias(number, path))
    rows = docs.withColumns({path: F.regexp_replace(meta["file_path"], "^([^:/]+):///", "$1:/"), place: meta["row_index"]})
    rows = rows.join(F.broadcast(table), path, "left")  # a row a file, as the driver's own listing has
    known = F.when(F.col(number).isNotNull(), F.shiftleft(F.col(number).cast("long"), IN_FILE) + F.col(place))
    return rows.select(*[F.col(f"`{c}`") for c in columns], known.otherwise(F.raise_error(F.lit("a file that wasn't listed")).cast("long")).alias(name)), name


def running(rows: DataFrame, by: list[str], order: list[str], sums: tuple[str, ...] = (), at: str = "at", least: tuple[str, ...] = ()) -> DataFrame:
    """The staged ``rows`` with their place ``at`` (from 0) in their group, by ``order``
    (SQL expressions), ``<x>_before``, the sum of each ``x`` of ``sums`` over the rows before, and
    ``<x>_least``, the least ``x`` of ``least`` among them (null if there is none).

    Rows are sorted in ranges, numbered within a range, and ranges are told what
    precedes them, so no group is one task's work, not even if it has all rows.
    """
    spark, part = rows.sparkSession, free_name(rows.columns, "_quern_part")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(b) for b in by], *[F.expr(o) for o in order]]
    names = [free_name(rows.columns, f"_quern_o{i}") for i in range(len(order))]
    dealt = rows.withColumns({k: F.expr(o) for k, o in zip(names, order, strict=True)}).repartitionByRange(n, *keys)
    dealt = stage(spark, dealt.withColumn(part, F.spark_partition_id()), "ranges")  # written, as bounds are sampled
    groups = [part, *by]
    window = f"over (partition by {', '.join(f'`{g}`' for g in groups)} order by {', '.join(f'`{k}`' for k in names)} rows between unbounded preceding and current row)"
    inner = dealt.withColumns({at: F.expr(f"row_number() {window} - 1"), **{f"{x}_before": F.expr(f"sum(`{x}`) {window}") - F.col(x) for x in sums}})
    earlier = window.replace("current row", "1 preceding")
    inner = inner.withColumns({f"{x}_least": F.expr(f"min(`{x}`) {earlier}") for x in least})
    total = dealt.groupBy(*groups).agg(F.count("*").alias("_quern_n"), *[F.sum(x).alias(f"_quern_s_{x}") for x in sums], *[F.min(x).alias(f"_quern_l_{x}") for x in least])
    upto = f"over ({'partition by ' + ', '.join(f'`{b}`' for b in by) if by else ''} order by `{part}` rows between unbounded preceding and 1 preceding)"
    carried = lambda c: F.expr(f"min(`{c}`) {upto}" if c.startswith("_quern_l_") else f"coalesce(sum(`{c}`) {upto}, 0)").alias(c)
    first = total.select(*[F.col(g).alias(f"_quern_g{i}") for i, g in enumerate(groups)], *[carried(c) for c in total.columns[len(groups) :]])
    out = inner.join(first, [inner[g].eqNullSafe(first[f"_quern_g{i}"]) for i, g in enumerate(groups)])
    places = {at: F.col(at) + F.col("_quern_n"), **{f"{x}_before": F.col(f"{x}_before") + F.col(f"_quern_s_{x}") for x in sums}, **{f"{x}_least": F.least(f"{x}_least", f"_quern_l_{x}") for x in least}}
    return out.select(*rows.columns, *[c.alias(k) for k, c in places.items()])


def lookup(rows: DataFrame, table: DataFrame, key: str, total: int, weight: str, most: int = 100_000) -> DataFrame:
    """Left join of ``rows`` to the staged ``table`` (one narrow row a key) that
    no hot key slows. ``weight`` is null where no key matches.

    Up to ``most`` keys (counted first) are broadcast. Beyond that: ``weight``
    is how many of ``total`` rows have the key; keys with at least
    ``total / HOT_KEYS`` of them are at most ``HOT_KEYS`` and are broadcast,
    the rest are joined by shuffle.
    """
    if table.count() <= most:
        return rows.join(F.broadcast(table), key, "left")
    bar = max(2, total // HOT_KEYS)
    hot = rows.join(F.broadcast(table.where(F.col(weight) >= bar)), key, "left")
    cold = hot.where(F.col(weight).isNull()).select(rows.columns)
    return hot.where(F.col(weight).isNotNull()).unionByName(cold.join(table.where(F.col(weight) < bar), key, "left"))


def without(rows: DataFrame, key: str, drop: DataFrame, most: int = 500_000) -> DataFrame:
    """Rows whose ``key`` isn't in the staged one-column table ``drop``.

    Up to ``most`` keys (a few MB, counted first) are broadcast, so that wide
    rows stay where they are; beyond that both sides are shuffled.
    """
    few = drop.count() <= most
    return rows.join(F.broadcast(drop) if few else drop.hint("shuffle_hash"), key, "left_anti")
