"""Evaluation tables: choices, requests, result files, logs and run specs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which metrics of a task count, in order.
PREFER = {
    "lambada_openai": ["acc,none"],
    "piqa": ["acc_norm,none", "acc,none"],
    "arc_challenge": ["acc_norm,none", "acc,none"],
    "hellaswag": ["acc_norm,none", "acc,none"],
    "ceval-valid": ["acc,none"],
    "gsm8k": ["exact_match,strict-match", "exact_match,flexible-extract"],
}

# Prompt parts of each translation direction.
PROMPTS = {"zh-en": ("Translate Chinese to English.\n\n", "Chinese", "English"), "en-zh": ("Translate English to Chinese.\n\n", "English", "Chinese")}


def picked(letters: Column, scores: Column) -> Column:
    """The letter of the highest score, the first of equals."""
    best = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    return F.get(letters, best)


def choices_scored(rows: DataFrame, by: list[str], letters: str, scores: str, free: str, answer: str) -> DataFrame:
    """``accuracy`` over the letters, and ``follows``: how often the likeliest token of all (``free``) is a letter at all."""
    right = F.coalesce(picked(F.col(letters), F.col(scores)) == F.col(answer), F.lit(False))
    follows = F.coalesce(F.array_contains(letters, F.col(free)), F.lit(False))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(right.cast("int")).alias("accuracy"), F.avg(follows.cast("int")).alias("follows"))


def fewshot(direction: str, shots: DataFrame, tests: DataFrame, key: str) -> DataFrame:
    """``key`` and ``prompt`` of every test source: header, the few ``shots`` (ord, src, ref), the open question."""
    header, source, target = PROMPTS[direction]
    one = F.transform("s", lambda x: F.concat(F.lit(f"{source}: "), x["src"], F.lit(f"\n{target}: "), x["ref"], F.lit("\n\n")))
    head = shots.agg(F.array_sort(F.collect_list(F.struct("ord", "src", "ref"))).alias("s")).select(F.concat(F.lit(header), F.array_join(one, "")).alias("_head"))  # a handful of shots
    return tests.crossJoin(F.broadcast(head)).select(key, F.concat("_head", F.lit(f"{source}: "), "src", F.lit(f"\n{target}:")).alias("prompt"))


def specs(spark: SparkSession, text: str) -> DataFrame:
    """``ord``, ``task`` and ``shots`` (null if not said) of a list such as ``piqa:5,gsm8k``."""
    return specs_of(spark.createDataFrame([(text,)], "x string"), "x")


def specs_of(lists: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same of a column of such lists, with the ``keys`` of their rows."""
    rows = lists.select(*keys, F.posexplode(F.split(column, ",")).alias("ord", "s"))
    s = F.trim("s")
    return rows.select(*keys, "ord", F.substring_index(s, ":", 1).alias("task"), F.nullif(F.when(F.instr("s", ":") > 0, F.regexp_extract(s, "^[^:]*:(.*)$", 1)), F.lit("")).cast("int").alias("shots"))


def preferred_metric(results: DataFrame, prefer: dict[str, list[str]] | None = None) -> DataFrame:
    """``tag``, ``task`` and ``value`` of results (tag, place, task, metric, value): of several places
    the first (lowest) that has a preferred metric of the task counts, there the first of them; null
    if no place has one."""
    prefer = PREFER if prefer is None else prefer
    rank = F.lit(None).cast("int")
    for task, names in prefer.items():
        at = F.array_position(F.array(*map(F.lit, names)), F.col("metric")).cast("int")
        rank = F.when(F.col("task") == task, at).otherwise(rank)
    rank = F.when(F.col("task").isin(*prefer), rank).otherwise((F.col("metric") == "acc,none").cast("int"))
    best = F.when(rank > 0, F.struct("place", rank.alias("rank")))
    return results.groupBy("tag", "task").agg(F.min_by("value", best).alias("value"))


def newest_match(files: DataFrame, patterns: list[str]) -> DataFrame:
    """``tag`` and ``path``: the last path in order that fits the first pattern (SQL regular expressions over
    ``path``, in which {tag} is the row's tag) with any fit."""
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(patterns))):
        rule = F.replace(F.lit(patterns[i]), F.lit("{tag}"), F.col("tag"))
        rank = F.when(F.regexp_like("path", rule), F.lit(i)).otherwise(rank)
    got = files.withColumn("rank", rank).where("rank is not null")
    return got.groupBy("tag").agg(F.max_by("path", F.struct(-F.col("rank"), "path")).alias("path"))


def log_steps(lines: DataFrame, seconds_a_step: float, total: int | None = None) -> DataFrame:
    """``step``, ``total``, ``loss``, ``percent`` and ``days_left`` of lines like ``step 5/100 | loss 2.5``."""
    form = r"^step (\d+)/(\d+)\s*\|\s*loss ([0-9.]+)"
    got = lines.where(F.col("value").rlike(form)).select(*[F.regexp_extract("value", form, i).alias(n) for i, n in ((1, "step"), (2, "total"), (3, "loss"))])
    got = got.select(F.col("step").cast("long"), F.lit(total).cast("long").alias("total") if total else F.col("total").cast("long"), F.col("loss").cast("double"))
    return got.select("*", F.round(100 * F.col("step") / F.col("total"), 1).alias("percent"), F.round((F.col("total") - F.col("step")) * seconds_a_step / 86400, 1).alias("days_left"))


def checkpoint_step(name: Column) -> Column:
    """The step of a folder ``checkpoint-<step>``; null for other names."""
    return F.nullif(F.regexp_extract(name, r"^checkpoint-(\d+)$", 1), F.lit("")).cast("long")


def leaks(lines: DataFrame, needles: list[str], names: list[str] = ()) -> DataFrame:
    """Lines (file, ord, value) that hold one of the paths ``needles``, or one of ``names`` as a word of its own."""
    found = F.lit(False)
    for n in needles:
        found = found | F.contains("value", F.lit(n))
    for n in names:
        found = found | F.col("value").rlike(rf"(?<!\w)\Q{n}\E(?!\w)")
    return lines.where(found).select("file", "ord", F.substring(F.trim("value"), 1, 100).alias("value"))


def scaled_architecture(raw: dict, depth: int) -> dict:
    """A template's sizes for ``depth`` layers of width 64 a layer; head, group and hidden ratios stay."""
    if depth <= 0:
        return dict(raw)
    width, group = depth * 64, raw["num_attention_heads"] // raw["num_key_value_heads"]
    heads = round(raw["num_attention_heads"] / raw["hidden_size"] * width)
    if heads < group or heads % group:
        raise ValueError(f"{heads} heads of width {width} don't divide into groups of {group}")
    inner = math.floor(raw["intermediate_size"] / raw["hidden_size"] * width)
    return raw | {"num_hidden_layers": depth, "hidden_size": width, "intermediate_size": inner, "num_attention_heads": heads, "num_key_value_heads": heads // group}


def class_counts(rows: DataFrame, ids: str) -> DataFrame:
    """How many pieces map to one id, to several, and to none (fallback)."""
    kind = F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, "fallback").when(F.size(ids) == 1, "one").otherwise("several")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
