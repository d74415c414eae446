"""Quality rules: a threshold table compiled into Spark projections.

``RULES`` names a measure, the bound it must keep and the side. ``judge``
compiles the table to column expressions over the words and lines of a text:
one narrow pass without shuffle and without user functions. Words, windows and
sorted windows are materialised once each, in projections that follow another.

Repeated passages: the 64-bit hash of every window of 8 words is taken, and texts
that have equal hashes sort them. Windows of one hash are then compared by their
words; should two differ, the text's windows are sorted by their words instead.

Defined cases: a null or empty text has no words, zero ratios and fails the base
rule; a text of any length is judged whole; repeated rows are judged alike; an
empty table gives an empty result; other columns, whatever their names, are
carried along (a column ``quality`` is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import storage

WINDOW = 8

# The most frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or from at an they which et la le les de des du un une que "
    "qui dans en est pour par sur pas plus au il elle der die das und ist nicht den von zu mit dem ein eine auf für sich im als auch el "
    "los las y con una su para es no se lo del al"
).split()
TRIM = ".,;:!?()\"'"


@dataclass(frozen=True)
class Rule:
    """``measure`` must be at least (``low``) or at most (``high``) the bound,
    in texts of ``from_words`` words or more."""

    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("n_words", low=20),
    Rule("n_words", high=200_000),
    Rule("mean_word", low=2.5, high=12.0),
    Rule("symbol_ratio", high=0.1),
    Rule("emphasis_ratio", high=0.5),
    Rule("stop_ratio", low=0.01, from_words=50),
    Rule("echo_ratio", high=0.2),
    Rule("dup_line_ratio", high=0.3),
)


def compile_rules(rules=RULES, measures: str = "m") -> Column:
    """True where every rule holds for the struct ``measures``."""
    out = F.lit(True)
    value = lambda x: F.col(f"{measures}.{x}")
    for r in rules:
        holds = F.lit(True)
        if r.low is not None:
            holds = holds & (value(r.measure) >= r.low)
        if r.high is not None:
            holds = holds & (value(r.measure) <= r.high)
        out = out & ((value("n_words") < r.from_words) | holds if r.from_words else holds)
    return out


def judge(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with ``quality``: a struct of all measures, ``base_failed`` and ``kept``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    a_words, a_win, a_tied, a_lines, a_c, a_m, a_f = (storage.free_name(docs.columns, f"_quern_{x}") for x in ("words", "win", "tied", "lines", "c", "m", "f"))
    words, n = F.col(a_words), F.size(a_words)
    out = docs.withColumn(a_words, F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != ""))
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn(a_win, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    win = F.col(a_win)
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    tied = F.when(F.size(F.array_distinct(win)) == F.size(win), none).otherwise(F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn(a_tied, tied)
    s = F.col(a_tied)
    again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    again = F.transform(again, lambda x: x["i"])
    window = lambda i: F.slice(words, i + 1, WINDOW)
    unlike = F.exists(F.transform(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) & (window(F.get(s, i - 1)["i"]) != window(x["i"]))), lambda x: F.coalesce(x, F.lit(False)))
    exact = F.sort_array(F.transform(starts, lambda i: F.struct(F.slice(words, i, WINDOW).alias("w"), (i - 1).alias("i"))))
    exactly = F.transform(F.filter(exact, lambda x, i: (F.get(exact, i - 1)["w"] == x["w"]) | (F.get(exact, i + 1)["w"] == x["w"])), lambda x: x["i"])
    covered = F.aggregate(
        F.sort_array(F.when(unlike, exactly).otherwise(again)),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), x - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    out = out.withColumn(a_lines, lines)
    per = lambda x: x / F.greatest(n, F.lit(1))
    measures = {
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(a_lines).cast("long"),
        "n_dup_lines": (F.size(a_lines) - F.size(F.array_distinct(a_lines))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_stop": F.size(F.filter(words, lambda w: F.lower(F.btrim(w, F.lit(TRIM))).isin(*STOP_WORDS))),
        "n_echo": F.size(F.filter(words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w))),
        "n_emphasis": F.regexp_count(text, F.lit("[!?]")),
    }
    out = out.withColumn(a_c, F.struct(*[v.alias(k) for k, v in measures.items()])).drop(a_words, a_win, a_tied, a_lines)
    c, n = F.col(a_c), F.col(f"{a_c}.n_words")
    ratios = {
        "mean_word": per(c["word_chars"]),
        "symbol_ratio": per(c["n_symbols"]),
        "emphasis_ratio": per(c["n_emphasis"]),
        "stop_ratio": per(c["n_stop"]),
        "echo_ratio": per(c["n_echo"]),
        "dup_line_ratio": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
    }
    out = out.withColumn(a_m, F.struct(f"{a_c}.*", *[v.alias(k) for k, v in ratios.items()])).drop(a_c)
    failed = (F.col(f"{a_m}.n_words") < 20) | (100 * F.col(f"{a_m}.n_repeat_words") > 30 * F.col(f"{a_m}.n_words"))
    out = out.withColumn(a_f, failed)
    return out.withColumn("quality", F.struct(f"{a_m}.*", F.col(a_f).alias("base_failed"), (~F.col(a_f) & compile_rules(rules, a_m)).alias("kept"))).drop(a_m, a_f)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs).select("doc_id", *[f"quality.{x}" for x in names])


OP10_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS k FROM win) WHERE k > 1
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(ws, lambda x: list_contains(['"""
    + "', '".join(STOP_WORDS)
    + r"""'], lower(trim(x, '.,;:!?()"'''))))) AS n_stop,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_echo,
         len(regexp_extract_all(text, '[!?]')) AS n_emphasis
  FROM d LEFT JOIN cover USING (doc_id)
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS n FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 200000 AND word_chars / n BETWEEN 2.5 AND 12 AND n_symbols / n <= 0.1 AND n_emphasis / n <= 0.5
       AND (n_words < 50 OR n_stop / n >= 0.01) AND n_echo / n <= 0.2 AND n_dup_lines / greatest(n_lines, 1) <= 0.3 AS kept
FROM f
"""
)
