"""Synthetic rows from a range of numbers; every choice is a hash of seed and row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import storage
from quern.functions.text import pick, uniform

# The wordings of the letter-counting question.
QUESTIONS = [
    "How many {letter} are in the word {word}",
    "How many {letter} are in {word}",
    "Count the number of {letter} in {word}",
    "How many times does {letter} appear in {word}",
    "What's the count of {letter} in {word}",
    "In the word {word}, how many {letter} are there",
    "How many letter {letter} are in the word {word}",
    "Count how many {letter} appear in {word}",
    "Tell me the number of {letter} in {word}",
    "How many occurrences of {letter} are in {word}",
    "Find the count of {letter} in {word}",
    "Can you count the {letter} letters in {word}",
    "What is the frequency of {letter} in {word}",
    "How many {letter}s are in {word}",
    "How many {letter}'s are in {word}",
    "Count all the {letter} in {word}",
    "How many times is {letter} in {word}",
    "Number of {letter} in {word}",
    "Total count of {letter} in {word}",
    "How many {letter} does {word} have",
    "How many {letter} does {word} contain",
    "What's the number of {letter} in {word}",
    "{word} has how many {letter}",
    "In {word}, count the {letter}",
    "How many {letter} appear in {word}",
]
QUOTES = ["", "'", '"']
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def spelled(word: Column) -> Column:
    return F.array_join(F.filter(F.split(word, ""), lambda c: c != ""), ",")


def letter_count(word: Column, letter: Column) -> Column:
    return (F.char_length(word) - F.char_length(F.replace(word, letter, F.lit("")))).cast("long")


def running_hits(word: Column, letter: Column) -> Column:
    """``letter:count so far`` of every place of a word."""
    places = F.sequence(F.lit(1), F.char_length(word))
    return F.array_join(F.transform(places, lambda i: F.concat(F.substr(word, i, F.lit(1)), F.lit(":"), letter_count(F.substr(word, F.lit(1), i), letter).cast("string"))), " ")


def cycled(words: DataFrame, size: int, seed: int | None) -> DataFrame:
    """``id`` from 0 to ``size`` - 1 with the words in seeded order (their own, if there is no
    seed), again from the start when they run out."""
    spark = words.sparkSession
    order = ["word"] if seed is None else [f"md5(concat_ws('-', '{seed}', word))", "word"]
    ranked = storage.stage(spark, storage.running(storage.stage(spark, words.select("word"), "words"), [], order, at="r"), "ranked")
    rows = spark.range(size).withColumn("r", F.col("id") % max(ranked.count(), 1))
    return rows.join(ranked, "r").drop("r")


def spelling(words: DataFrame, size: int, seed: int) -> DataFrame:
    """Rows that ask for a word's letters."""
    return cycled(words, size, seed).select("id", "word", F.concat(F.lit("Spell the word: "), "word").alias("question"), F.concat("word", F.lit(":"), spelled(F.col("word"))).alias("answer"))


def counting(words: DataFrame, size: int, seed: int) -> DataFrame:
    """Rows that ask how often a letter is in a word, with the worked answer. Nine in ten ask for a
    letter of the word; 30 % of questions are lower-case, half end with a question mark."""
    spark = words.sparkSession
    ranked = storage.stage(spark, storage.running(storage.stage(spark, words.select("word"), "words"), [], ["word"], at="r"), "ranked")
    u = lambda what: uniform(seed, what, F.col("id"))
    rows = spark.range(size).withColumn("r", F.floor(u("word") * ranked.count()))
    rows = rows.join(ranked, "r").drop("r")
    own = F.substr("word", (F.floor(u("place") * F.char_length("word")) + 1).cast("int"), F.lit(1))
    rows = rows.withColumn("letter", F.when(u("own") < 0.9, own).otherwise(pick(list(ALPHABET), u("any"))))
    form = pick(QUESTIONS, u("form"))
    form = F.when(u("low") < 0.3, F.lower(form)).otherwise(form)
    lq, wq = pick(QUOTES, u("quote")), pick(QUOTES, u("word quote"))
    question = F.replace(F.replace(form, F.lit("{letter}"), F.concat(lq, "letter", lq)), F.lit("{word}"), F.concat(wq, "word", wq))
    question = F.concat(question, F.when(u("mark") < 0.5, "?").otherwise(""))
    return rows.select("id", "word", "letter", question.alias("question"), worked(F.col("word"), F.col("letter")).alias("answer"))


def worked(word: Column, letter: Column) -> Column:
    """The letter-by-letter answer of a counting question."""
    # The wording of the worked answer.
    head = F.concat(F.lit("We are asked to find the number '"), letter, F.lit("' in the word '"), word, F.lit("'. Let me try a manual approach first.\n\nFirst spell the word out:\n"), word, F.lit(":"), spelled(word), F.lit("\n\nThen count the occurrences of '"), letter, F.lit("':\n"))
    upto = lambda i: letter_count(F.substr(word, F.lit(1), i), letter).cast("string")
    char = lambda i: F.substr(word, i, F.lit(1))
    line = lambda i: F.concat(i.cast("string"), F.lit(":"), char(i), F.when(char(i) == letter, F.concat(F.lit(" hit! count="), upto(i))).otherwise(""), F.lit("\n"))
    count = letter_count(word, letter).cast("string")
    return F.concat(head, F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(word)), line), ""), F.lit("\nThis gives us "), count, F.lit(".\n\nMy final answer is:\n\n#### "), count)


def identity(spark: SparkSession, size: int, seed: int, pairs: dict[str, list[tuple[str, str]]], prefixes: list[str], share: float = 0.3) -> DataFrame:
    """Question and answer rows, half of them in each language, some with a prefix."""
    langs = sorted(pairs)
    rows = spark.range(size).withColumn("lang", pick(langs, uniform(seed, "lang", F.col("id"))))
    q, a = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang in langs:
        u = uniform(seed, "pair", F.col("id"))
        q = F.when(F.col("lang") == lang, pick([x for x, _ in pairs[lang]], u)).otherwise(q)
        a = F.when(F.col("lang") == lang, pick([x for _, x in pairs[lang]], u)).otherwise(a)
    before = F.when(uniform(seed, "has", F.col("id")) < share, pick(prefixes, uniform(seed, "prefix", F.col("id")))).otherwise("")
    return rows.select("id", "lang", F.concat(before, q).alias("question"), a.alias("answer"))
