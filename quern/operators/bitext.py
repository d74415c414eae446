"""Pairs of sentences as documents: fixed groups in file order, formatted as blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import storage
from quern.functions.text import pick, uniform

# Directions, headers, labels and separators of a block.
DIRECTIONS = ["zh-en", "en-zh"]
HEADERS = {
    "zh-en": ["以下是中英对照。\n\n", "把下面的中文译成英文。\n\n", "Chinese–English bitext:\n\n", ""],
    "en-zh": ["以下是英中对照。\n\n", "把下面的英文译成中文。\n\n", "English–Chinese bitext:\n\n", ""],
}
LABELS = {
    "zh-en": [("中文", "英文"), ("原文", "译文"), ("zh", "en"), ("Source (Chinese)", "Target (English)")],
    "en-zh": [("英文", "中文"), ("原文", "译文"), ("en", "zh"), ("Source (English)", "Target (Chinese)")],
}
SEPARATORS = [": ", "：", "\t"]


def grouped(pairs: DataFrame, order: list[str], size: int = 14) -> DataFrame:
    """``grp`` and its ``pairs`` (array of zh, en in order): consecutive pairs over all files, the last group what is left."""
    rows = storage.running(storage.stage(pairs.sparkSession, pairs, "pairs"), [], order, at="_at")
    rows = rows.withColumn("grp", F.floor(F.col("_at") / size).cast("long"))
    got = rows.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("_at", "zh", "en"))).alias("x"))
    return got.select("grp", F.transform("x", lambda p: F.struct(p["zh"].alias("zh"), p["en"].alias("en"))).alias("pairs"))


def block(pairs: Column, seed: int, key: Column) -> Column:
    """One document of an array of pairs; direction, header, labels and separator are drawn once by ``key``."""
    u = lambda what: uniform(seed, what, key)
    direction, sep = pick(DIRECTIONS, u("direction")), pick(SEPARATORS, u("separator"))

    def by_direction(options: dict[str, list[str]], what: str) -> Column:
        return F.when(direction == "zh-en", pick(options["zh-en"], u(what))).otherwise(pick(options["en-zh"], u(what)))

    header = by_direction(HEADERS, "header")
    first = by_direction({d: [a for a, _ in x] for d, x in LABELS.items()}, "labels")
    second = by_direction({d: [b for _, b in x] for d, x in LABELS.items()}, "labels")

    def one(p: Column) -> Column:
        s = F.when(direction == "zh-en", p["zh"]).otherwise(p["en"])
        o = F.when(direction == "zh-en", p["en"]).otherwise(p["zh"])
        labelled = F.concat(first, sep, s, F.lit("\n"), second, sep, o, F.lit("\n\n"))
        return F.when(sep == "\t", F.concat(s, F.lit("\t"), o, F.lit("\n"))).otherwise(labelled)

    return F.concat(header, F.array_join(F.transform(pairs, one), ""))


def documents(pairs: DataFrame, order: list[str], seed: int = 0, size: int = 14) -> DataFrame:
    """``grp`` and ``text`` of every block."""
    return grouped(pairs, order, size).select("grp", block(F.col("pairs"), seed, F.col("grp")).alias("text"))
