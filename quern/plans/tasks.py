"""Tasks and mixes: named builders of conversations, with stops, renderers and epochs.

A task builds a DataFrame of ``ord`` (its order) and ``turns``; a mix is a list of
tasks in which a task named twice is an epoch more. Both are looked up by name, and
a mix may be built with other arguments.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as t

#: Renderers of multiple-choice questions by name: question and choices to a prompt.
RENDERERS = {"after": t.render_choices_after, "before": t.render_choices_before}


@dataclass(frozen=True)
class Task:
    """``build(spark)`` gives ord and turns; ``stop`` keeps the first of them, after all filters."""

    name: str
    build: Callable[[SparkSession], DataFrame]
    lang: str = "en"
    stop: int | None = None

    def __post_init__(self):
        if self.stop is not None and self.stop <= 0:
            raise ValueError(f"stop must be positive, not {self.stop}")

    def stopped(self, stop: int | None) -> Task:
        return replace(self, stop=stop)

    def rows(self, spark: SparkSession) -> DataFrame:
        out = self.build(spark).select("ord", "turns")
        return out if self.stop is None else out.orderBy("ord").limit(self.stop)

    def __str__(self) -> str:
        return f"{self.name}({'all' if self.stop is None else self.stop})"


@dataclass(frozen=True)
class Mixture:
    tasks: tuple[Task, ...]

    def __post_init__(self):
        if not self.tasks:
            raise ValueError("a mix needs a task")

    def rows(self, spark: SparkSession) -> DataFrame:
        """``instance`` (place in the list), ``task``, ``lang``, ``ord`` and ``turns`` of all tasks, repeats included."""
        out = None
        for i, task in enumerate(self.tasks):
            one = task.rows(spark).select(F.lit(i).cast("long").alias("instance"), F.lit(task.name).alias("task"), F.lit(task.lang).alias("lang"), "ord", "turns")
            out = one if out is None else out.unionByName(one)
        return out

    def summary(self) -> dict[str, int]:
        """How often each task is named."""
        return dict(Counter(map(str, self.tasks)))


MIXES: dict[str, Callable[..., Mixture]] = {}


def mix(name: str):
    """Register a factory of a mix; its keyword arguments may be overridden by `build`."""

    def register(f: Callable[..., Mixture]):
        if name in MIXES:
            raise ValueError(f"mix {name!r} exists")
        MIXES[name] = f
        return f

    return register


def build(name: str, **how) -> Mixture:
    if name not in MIXES:
        raise KeyError(f"unknown mix {name!r}; known: {', '.join(sorted(MIXES))}")
    return MIXES[name](**how)


def totals(rows: DataFrame, tokens: Column) -> DataFrame:
    """Rows and tokens of each task over all its epochs."""
    return rows.groupBy("task").agg(F.count("*").alias("rows"), F.sum(tokens).cast("long").alias("tokens"))
