"""Sources, mixes and their guards as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import glob_to_regex

SCHEMA = (
    "name string, kind string, repo_id string, subdir string, part_glob string, n_parts int, "
    "allow_patterns array<string>, lang string, fmt string, text_field string, note string"
)


def registry(spark: SparkSession, *groups: list[dict]) -> DataFrame:
    """All groups as one table; a name that comes twice raises."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    rows = [tuple(x.get(n) for n in names) for g in groups for x in g]
    seen = [r[0] for r in rows]
    if twice := sorted({n for n in seen if seen.count(n) > 1}):
        raise ValueError(f"sources named twice: {twice}")
    return spark.createDataFrame(rows, SCHEMA)


def get(sources: DataFrame, name: str):
    """One source; an unknown name raises and lists those known."""
    rows = sources.where(F.col("name") == name).collect()
    if not rows:
        known = [r.name for r in sources.select("name").orderBy("name").collect()]
        raise KeyError(f"unknown source {name!r}; known: {', '.join(known)}")
    return rows[0]


def weighted(mix: DataFrame, sources: DataFrame) -> DataFrame:
    """``mix`` (source, weight) with the registry's columns; a source not registered raises."""
    lost = mix.join(sources, mix["source"] == sources["name"], "left_anti").limit(20).collect()
    if lost:
        raise KeyError(f"not registered: {sorted(r.source for r in lost)}")
    return mix.join(sources, mix["source"] == sources["name"])


def selected(files: DataFrame, patterns: list[str], n_parts: int | None = None) -> DataFrame:
    """``path``s that match a pattern; the first ``n_parts`` in order, if given."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("path").rlike(glob_to_regex(p))
    out = files.where(hit).orderBy("path")
    return out.limit(n_parts) if n_parts is not None else out


def missing(wanted: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    """What is still to be fetched."""
    return wanted.join(present, key, "left_anti")


def status(sources: DataFrame, present: DataFrame) -> DataFrame:
    """``name``, ``present`` and ``needed`` parts of every source. ``present``: name, path."""
    got = present.groupBy("name").agg(F.count("*").alias("present"))
    return sources.join(got, "name", "left").select("name", F.coalesce("present", F.lit(0)).alias("present"), F.col("n_parts").alias("needed"))
