"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[\\x{4E00}-\\x{9FFF}]"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Strings that end a translated line; the source's label is added in two forms.
STOPS = ["\n\n", "\n English:", "\n Chinese:", "\nEnglish:", "\nChinese:", "  English:", "  Chinese:"]

# Pairs of a traditional and a simplified character, for the script screen.
SCRIPTS = [("們", "们"), ("國", "国"), ("學", "学"), ("這", "这"), ("個", "个"), ("來", "来"), ("時", "时"), ("說", "说"), ("為", "为"), ("對", "对"), ("會", "会"), ("過", "过"), ("後", "后"), ("經", "经"), ("發", "发"), ("開", "开"), ("關", "关"), ("體", "体")]


def strip(c: Column) -> Column:
    """Unicode white space off both ends (``trim`` only knows the blank)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def n_tokens(c: Column) -> Column:
    """Number of white-space separated tokens; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def truncated(c: Column, chars: int = 100_000) -> Column:
    return F.substring(c, 1, chars)


def cjk_share(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CJK)) / F.greatest(F.char_length(c), F.lit(1))


def repetition(c: Column, n: int = 24) -> Column:
    """One minus the share of distinct n-character grams at every n-th place; 0 for under 2 n characters."""
    found = F.regexp_extract_all(c, F.lit("(?s).{%d}" % n), 0)  # one pass over the text
    grams = F.slice(found, 1, F.ceil((F.char_length(c) - n) / n).cast("int"))
    return F.when(F.char_length(c) < 2 * n, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(grams)) / F.size(grams))


def traditional_share(c: Column) -> Column:
    """Share of traditional forms among the characters of ``SCRIPTS``; null if there is none."""
    old = F.regexp_count(c, F.lit("[" + "".join(a for a, _ in SCRIPTS) + "]"))
    new = F.regexp_count(c, F.lit("[" + "".join(b for _, b in SCRIPTS) + "]"))
    return F.when(old + new > 0, old / (old + new))


def longform_ok(stopped: Column, tokens: Column, rep: Column) -> Column:
    """A long answer that ended by itself, is long enough and doesn't repeat."""
    return stopped & (tokens >= 150) & (rep < 0.2)


def cut_at_earliest(c: Column, stops: list[str]) -> Column:
    """Text before whichever stop string comes first, stripped."""
    at = F.least(*[F.nullif(F.instr(c, s), F.lit(0)) for s in stops], F.char_length(c) + 1)
    return strip(F.substr(c, F.lit(1), at - 1))


def trimmed_continuation(c: Column, source_label: str) -> Column:
    """A translation before the next header or blank line."""
    return cut_at_earliest(c, [*STOPS, f"  {source_label}:", f"\n{source_label}:"])


def cut_in_turn(c: Column, stops: list[str]) -> Column:
    """Text before the first occurrence of each stop string, one after another."""
    for s in stops:
        c = F.substring_index(c, s, 1)
    return c


def strip_calc_tags(c: Column) -> Column:
    """Calculator annotations ``<<...>>`` removed."""
    return F.regexp_replace(c, "<<[^>]*>>", "")


def answer_letter(index: Column) -> Column:
    """0 is A."""
    return F.char(F.lit(65) + index.cast("int"))


# The wording of both renderings of a multiple-choice question.


def render_choices_after(question: Column, choices: Column) -> Column:
    """Question, then a line ``- choice=letter`` for each choice."""
    lines = F.transform(choices, lambda x, i: F.concat(F.lit("- "), x, F.lit("="), F.char(F.lit(65) + i)))
    return F.concat(F.lit("Multiple Choice question: "), question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n\nRespond only with the letter of the correct answer."))


def render_choices_before(question: Column, choices: Column) -> Column:
    """Question, then a line ``A. choice`` for each choice."""
    lines = F.transform(choices, lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), x))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"))


def instruction(q: Column, extra: Column) -> Column:
    """Instruction with its input on the next line, if it has one."""
    return F.concat_ws("\n", strip(q), F.nullif(strip(extra), F.lit("")))


def uniform(*key) -> Column:
    """A number in [0, 1) that depends on the key alone (28 bits of its MD5)."""
    whole = F.md5(F.concat_ws("-", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]))
    return F.conv(F.substring(whole, 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))


def pick(options: list[str], u: Column) -> Column:
    """One of the options by a uniform number."""
    return F.get(F.array(*map(F.lit, options)), F.floor(u * len(options)).cast("int"))


def glob_to_regex(pattern: str) -> str:
    """``*`` and ``?`` stay within a path step, ``**`` crosses steps and takes a slash that follows it."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2 + pattern.startswith("/", i + 2)
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i]) or re.escape(pattern[i])
        i += 1
    return f"^{out}$"


def first_existing(present: Column, names: list[str]) -> Column:
    """The first of ``names`` that the array ``present`` holds; null if none."""
    return F.get(F.filter(F.array(*map(F.lit, names)), lambda x: F.array_contains(present, x)), F.lit(0))


def prefer(metrics: Column, names: list[str]) -> Column:
    """The value of the first of ``names`` that the map has; null if none."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in names])


def by_prefix(metrics: Column, name: str) -> Column:
    """The value of ``name``, or else of the first key that begins with its part before a comma."""
    base = name.split(",")[0]
    near = F.array_sort(F.filter(F.map_entries(metrics), lambda e: F.startswith(e["key"], F.lit(base)) & e["value"].isNotNull()))
    return F.coalesce(F.try_element_at(metrics, F.lit(name)), F.get(near, F.lit(0))["value"])


def right_padded(ids: Column, width: Column, pad: int) -> Column:
    """``ids`` filled up to ``width``."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def attention_mask(ids: Column, width: Column) -> Column:
    """1 for each id, 0 for the padding up to ``width``."""
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def left_truncated(ids: Column, most: int) -> Column:
    """The last ``most`` elements."""
    return F.when(F.size(ids) <= most, ids).otherwise(F.slice(ids, -most, most))


def scored_input(context: Column, continuation: Column, most: int) -> tuple[Column, Column]:
    """The last ``most`` ids of context and continuation, and how many of them are context."""
    whole = F.concat(context, continuation)
    return left_truncated(whole, most), F.size(context) - F.greatest(F.size(whole) - most, F.lit(0))


def without_ids(ids: Column, special: list[int]) -> Column:
    return F.filter(ids, lambda x: ~x.isin(*special))


def labels_from_mask(ids: Column, mask: Column) -> Column:
    """The id where the mask is 1, else -100."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(-100))
