"""Named tasks over files in the registered formats, named mixes of them, and both as SQL table functions.

A library looks for the files of a task in a folder of its name. Rows are read by
`readers`, whatever store they are in; a task's order is its files' and their rows'.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import chat, generate
from quern.plans import tasks
from quern.plans.tasks import Mixture, Task
from quern.sources import readers

# Tasks of conversations with their language, format and files.
FILES = {
    "SmolTalk": ("en", "parquet_chat", "*.parquet"),
    "MMLU_AuxTrain": ("en", "parquet_mc", "*.parquet"),
    "ARC_Easy_Train": ("en", "parquet_arc", "*.parquet"),
    "ARC_Challenge_Train": ("en", "parquet_arc", "*.parquet"),
    "GSM8K_Train": ("en", "parquet_qa", "*.parquet"),
    "COIG_CQIA": ("zh", "jsonl_instruct", "*.jsonl"),
    "C3_Train": ("zh", "parquet_mc_zh", "*.parquet"),
    "Magpie_ZH": ("zh", "parquet_magpie", "*.parquet"),
    "Firefly_ZH": ("zh", "jsonl_firefly", "*.jsonl"),
    "AlpacaGPT4_ZH": ("zh", "json_alpaca", "*.json"),
}
WORDS = ("EnglishWords", "*.txt")

# Mixes as lists of tasks with their stops; a task named twice is an epoch more.
MIDTRAIN = [("SmolTalk", 100_000), ("MMLU_AuxTrain", None), ("GSM8K_Train", None), ("Identity", 1000), ("Identity", 1000), ("SimpleSpelling", 200_000), ("SpellingBee", 80_000), ("COIG_CQIA", None), ("C3_Train", None)]
SFT = [("ARC_Easy_Train", None), ("ARC_Challenge_Train", None), ("GSM8K_Train", None), ("SmolTalk", 10_000), ("Identity", 1000), ("SimpleSpelling", 300), ("SpellingBee", 300), ("COIG_CQIA", 10_000), ("C3_Train", 3400)]


def chat_mix(mmlu_epochs: int = 3, smoltalk: int | None = 172_000, firefly: int | None = 35_000, magpie: bool = True) -> list[tuple[str, int | None]]:
    """The mix of a single stage after pre-training."""
    # Tasks and stops.
    english = [("SmolTalk", smoltalk), *[("MMLU_AuxTrain", None)] * mmlu_epochs, ("ARC_Easy_Train", None), ("ARC_Challenge_Train", None), *[("GSM8K_Train", None)] * 4]
    made = [("Identity", 1000), ("Identity", 1000), ("SimpleSpelling", 200_000), ("SpellingBee", 80_000)]
    return [*english, *made, *[("Magpie_ZH", None)] * magpie, ("Firefly_ZH", firefly), ("AlpacaGPT4_ZH", None), ("COIG_CQIA", None), ("C3_Train", None)]


MIXES: dict[str, Callable[..., list[tuple[str, int | None]]]] = {
    "midtrain": lambda: MIDTRAIN,
    "sft": lambda: SFT,
    "chat_pretrain": lambda: MIDTRAIN,
    "chat": chat_mix,
    "chat_mmlu1": lambda **how: chat_mix(**{"mmlu_epochs": 1} | how),
    "chat_zhreal": lambda **how: chat_mix(**{"mmlu_epochs": 1, "magpie": False, "firefly": 235_000} | how),
    "chat_full": lambda **how: chat_mix(**{"mmlu_epochs": 1, "smoltalk": None, "firefly": 228_000} | how),
}


@dataclass(frozen=True)
class Library:
    """Tasks below ``base``. ``who`` gives the pairs of the identity task by language (without them mixes leave it
    out), ``prefixes`` what some of its questions begin with; ``render`` is how questions with choices are written."""

    base: str
    render: str = "after"
    who: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    prefixes: tuple[str, ...] = ("Hey, ", "So, ")

    def task(self, name: str, stop: int | None = None) -> Task:
        if name in FILES:
            return Task(name, lambda spark: self._files(spark, name), FILES[name][0], stop)
        makers = {"SimpleSpelling": self._spelling, "SpellingBee": self._counting, "Identity": self._identity}
        if name not in makers:
            raise KeyError(f"unknown task {name!r}; known: {', '.join(sorted([*FILES, *makers]))}")
        size = stop or 1000
        return Task(name, lambda spark: makers[name](spark, size), "zh+en" if name == "Identity" else "en", size)

    def mix(self, name: str, **how) -> Mixture:
        if name not in MIXES:
            raise KeyError(f"unknown mix {name!r}; known: {', '.join(sorted(MIXES))}")
        return Mixture(tuple(self.task(*x) for x in MIXES[name](**how) if x[0] != "Identity" or self.who))

    def register(self) -> None:
        """Enter the mixes where `tasks.build` finds them."""
        for name in MIXES:
            tasks.mix(name)(lambda name=name, **how: self.mix(name, **how))

    def _files(self, spark: SparkSession, name: str) -> DataFrame:
        _, fmt, files = FILES[name]
        rows = readers.read(spark, fmt, [f"{self.base}/{name}/{files}"])
        if fmt in readers.CHOICES:
            question = F.coalesce("question", F.lit(""))
            if "context" in rows.columns:
                question = F.concat_ws("\n", F.nullif(F.col("context"), F.lit("")), question)
            turns = chat.asked(tasks.RENDERERS[self.render](question, F.col("choices")), F.col("answer"))
        elif fmt in readers.ANSWERED:
            turns = chat.asked(F.col("question"), t.strip_calc_tags(F.col("answer")) if name == "GSM8K_Train" else F.col("answer"))
        else:
            turns = F.col("turns")
        return rows.select(_order(F.col("file"), F.col("ord")), turns.alias("turns"))

    def _words(self, spark: SparkSession) -> DataFrame:
        return readers.word_list(spark, [f"{self.base}/{WORDS[0]}/{WORDS[1]}"])

    def _spelling(self, spark: SparkSession, size: int) -> DataFrame:
        return _made(generate.spelling(self._words(spark), size, 42))

    def _counting(self, spark: SparkSession, size: int) -> DataFrame:
        return _made(generate.counting(self._words(spark), size, 0))

    def _identity(self, spark: SparkSession, size: int) -> DataFrame:
        return _made(generate.identity(spark, size, 7, self.who, list(self.prefixes)))


def _order(file, place):
    return F.struct(file.alias("file"), place.cast("long").alias("place")).alias("ord")


def _made(rows: DataFrame) -> DataFrame:
    return rows.select(_order(F.lit(""), F.col("id")), chat.asked(F.col("question"), F.col("answer")).alias("turns"))


def publish(spark: SparkSession, mixture: Mixture, prefix: str = "") -> list[str]:
    """Make each task of a mix a table function of SQL, named in lower case, of how many epochs are
    wanted (1 if not said), and return the names. Catalyst inlines them, so filters and columns reach the files."""
    names = []
    for task in {str(x): x for x in mixture.tasks}.values():
        name = f"{prefix}{task.name}".lower()
        if name in names:
            raise ValueError(f"{task.name} is in the mix with several stops")
        rows = task.rows(spark)
        rows.createOrReplaceTempView(f"{name}_rows")
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(epochs INT DEFAULT 1) RETURNS TABLE(epoch INT, task STRING, lang STRING, ord {kinds['ord']}, turns {kinds['turns']}) "
            f"RETURN SELECT explode(sequence(1, greatest(epochs, 1))) AS epoch, '{task.name}', '{task.lang}', r.ord, r.turns FROM {name}_rows r WHERE epochs > 0"
        )
        names.append(name)
    return names
