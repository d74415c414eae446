"""Readers: every registered format to rows of text, turns or items.

All read lazily with column projection. Order, where it matters, is the pair
(``file``, ``ord``) that Parquet and text scans give each row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import storage
from quern.functions import text as t
from quern.operators import bitext as blocks
from quern.operators import chat

PLACE = ["_metadata.file_path as file", "_metadata.row_index as ord"]
TURNS = "array<struct<role string, content string>>"


def _parquet(spark: SparkSession, paths: list[str], *columns: str) -> DataFrame:
    return spark.read.parquet(*paths).selectExpr(*PLACE, *columns)


def plain(spark: SparkSession, paths: list[str], field: str = "text") -> DataFrame:
    return _parquet(spark, paths, f"`{field}` as text").where("text is not null and text <> ''")


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with their place; gzip by file name, bad bytes replaced."""
    return spark.read.text(paths).selectExpr("_metadata.file_path as file", "monotonically_increasing_id() as ord", "value")


def jsonl(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """One object a line; blank and malformed lines are left out."""
    rows = lines(spark, paths).where(t.strip(F.col("value")) != "")
    rows = rows.withColumn("x", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.where("x is not null and x._bad is null").select("file", "ord", "x.*").drop("_bad")


def jsonl_text(spark: SparkSession, paths: list[str], field: str = "text") -> DataFrame:
    return jsonl(spark, paths, f"`{field}` string").select("file", "ord", F.col(field).alias("text")).where("text is not null and text <> ''")


def bitext(spark: SparkSession, paths: list[str], field: str = "translation", most: int = 1000) -> DataFrame:
    out = _parquet(spark, paths, f"`{field}`.en as en", f"`{field}`.zh as zh")
    return pair_filter(out, most)


def pair_filter(rows: DataFrame, most: int = 1000) -> DataFrame:
    """Both sides stripped, not empty and of at most ``most`` characters."""
    rows = rows.withColumn("en", t.strip(F.col("en"))).withColumn("zh", t.strip(F.col("zh")))
    good = (F.col("en") != "") & (F.col("zh") != "") & (F.char_length("en") <= most) & (F.char_length("zh") <= most)
    return rows.where(good)


def question_answer(spark: SparkSession, paths: list[str], q: str = "question", a: str = "answer") -> DataFrame:
    return _parquet(spark, paths, f"`{q}` as question", f"`{a}` as answer").where("question <> '' and answer <> ''")


def instructions(rows: DataFrame, q: str = "instruction", extra: str = "input", a: str = "output") -> DataFrame:
    """``question`` (with its input) and ``answer``, both stripped and not empty."""
    extra_col = F.col(extra) if extra in rows.columns else F.lit(None).cast("string")
    out = rows.select("file", "ord", t.instruction(F.col(q), extra_col).alias("question"), t.strip(F.col(a)).alias("answer"), t.strip(F.col(q)).alias("_q"))
    return out.where("_q <> '' and answer <> ''").drop("_q")


def jsonl_instruct(spark: SparkSession, paths: list[str]) -> DataFrame:
    return instructions(jsonl(spark, paths, "instruction string, input string, output string"))


# The kinds whose answers are long enough to teach.
KINDS = ["BELLE", "Cot", "ProductDesc", "AncientPoem", "OpenQA", "MusicComment", "TextCorrection", "Composition", "Translation", "JinYongGeneration", "LyricGeneration", "Dictionary", "StoryGeneration", "Program", "ProseGeneration"]


def jsonl_kinds(spark: SparkSession, paths: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Kind, input and target; the kinds listed, ``KINDS`` if None, all if the list is empty."""
    rows = jsonl(spark, paths, "kind string, input string, target string")
    kinds = KINDS if kinds is None else kinds
    rows = rows.where(F.col("kind").isin(*kinds)) if kinds else rows
    return rows.select("file", "ord", "kind", t.strip(F.col("input")).alias("question"), t.strip(F.col("target")).alias("answer")).where("question <> '' and answer <> ''")


def json_array(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A file that is one JSON array of instructions."""
    rows = spark.read.schema("instruction string, input string, output string").option("multiLine", True).json(paths)
    return instructions(rows.selectExpr("_metadata.file_path as file", "monotonically_increasing_id() as ord", "*"))


def chats(spark: SparkSession, paths: list[str], field: str = "messages", role: str = "role", content: str = "content", names: dict[str, str] | None = None) -> DataFrame:
    """``turns`` of known roles; other formats' roles by ``names``; empty conversations are left out."""
    rows = _parquet(spark, paths, f"`{field}` as raw")
    turns = F.transform("raw", lambda x: F.struct(chat.remapped(x[role], names or {}).alias("role"), x[content].alias("text")))
    return rows.select("file", "ord", chat.known_roles(turns).alias("turns")).where("size(turns) > 0")


def sharegpt(spark: SparkSession, paths: list[str], field: str = "conversations") -> DataFrame:
    return chats(spark, paths, field, "from", "value", {"human": "user", "gpt": "assistant"})


def choices_nested(spark: SparkSession, paths: list[str], field: str = "train") -> DataFrame:
    rows = _parquet(spark, paths, f"`{field}`.question as question", f"`{field}`.choices as choices", f"`{field}`.answer as answer")
    return rows.where("answer between 0 and size(choices) - 1").withColumn("answer", t.answer_letter(F.col("answer")))


def choices_labelled(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Labels and texts beside each other; a key that is no label drops the row."""
    rows = _parquet(spark, paths, "question", "choices.label as letters", "choices.text as choices", "answerKey as answer")
    return rows.where("array_contains(letters, answer) and size(letters) = size(choices)")


def choices_literal(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The answer is one of the options' text; the context's lines come first."""
    rows = _parquet(spark, paths, "array_join(context, '\n') as context", "question", "choice as choices", "array_position(choice, answer) as at").where("at > 0")
    return rows.withColumn("answer", t.answer_letter(F.col("at") - 1)).drop("at")


def word_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines that are one alphabetic word."""
    return lines(spark, paths).select(t.strip(F.col("value")).alias("word")).where(F.col("word").rlike("^\\p{L}+$"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ord`` (from 0) and ``value`` of the lines of one file, which is read in as many splits as it has."""
    rows = storage.stage(spark, lines(spark, [path]).select("ord", "value"), "lines")
    return storage.running(rows, [], ["ord"], at="line").select(F.col("line").alias("ord"), "value")


def line_pairs(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Two files line by line, as far as both go."""
    pairs = numbered_lines(spark, source).withColumnRenamed("value", "src").join(numbered_lines(spark, target).withColumnRenamed("value", "ref"), "ord")
    return pairs.select("ord", t.strip(F.col("src")).alias("src"), t.strip(F.col("ref")).alias("ref"))


def choices_flat(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Columns A to D and the letter of the answer, as test sets have them."""
    return _parquet(spark, paths, "question", "array(A, B, C, D) as choices", "array('A', 'B', 'C', 'D') as letters", "answer").where("array_contains(letters, answer)")


def choices_indexed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Choices and the answer's place from 0, as test sets have them."""
    rows = _parquet(spark, paths, "question", "choices", "answer as at").where("at between 0 and size(choices) - 1")
    return rows.withColumn("letters", F.transform("choices", lambda x, i: t.answer_letter(i))).withColumn("answer", t.answer_letter(F.col("at"))).drop("at")


def packed(spark: SparkSession, ids: list[str], masks: list[str] | None = None) -> DataFrame:
    """Packed rows (``ids``) of several shards as one table with a global ``index`` in shard order; with
    ``masks``, a shard for each, ``labels`` too. Shards of unequal number, length or width raise."""
    if masks is not None and len(masks) != len(ids):
        raise ValueError(f"{len(masks)} mask files for {len(ids)} data files")

    def shards(paths: list[str], name: str) -> DataFrame:
        out = None
        for i, p in enumerate(paths):
            rows, number = storage.numbered(spark.read.parquet(p))
            one = rows.select(F.lit(i).alias("shard"), F.col(number).alias("at"), name)
            out = one if out is None else out.unionByName(one)
        return storage.running(storage.stage(spark, out, "shards"), [], ["shard", "at"], at="index").select("index", "shard", name)

    rows = shards(ids, "ids")
    widths = rows.agg(F.min(F.size("ids")), F.max(F.size("ids"))).first()
    if widths[0] != widths[1]:
        raise ValueError(f"rows of {widths[0]} and {widths[1]} tokens")
    if masks is None:
        return rows
    found = shards(masks, "mask")
    count = lambda f: {r.shard: r.n for r in f.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    if count(rows) != count(found):
        raise ValueError("data and mask shards differ in their rows")
    return rows.join(found.select("index", "mask"), "index").withColumn("labels", t.labels_from_mask(F.col("ids"), F.col("mask")))


#: Indices at most that a scan is told of; more of them are joined.
NAMED = 10_000


def rows_at(spark: SparkSession, path: str, wanted: DataFrame | list[int]) -> DataFrame:
    """The rows of `sinks.blocked` with these global indices (a list, or a column ``index``), each once.

    Up to ``NAMED`` of them name the blocks to open (partition pruning) and, within a block,
    the range that Parquet's footers are asked for; more are joined block by block, and a
    scan of all blocks is what they need anyway."""
    rows = spark.read.parquet(path)
    size = spark.read.json(f"{path}/_blocks").first()["block_rows"]
    if isinstance(wanted, list):
        named = sorted(set(wanted))
    else:
        wanted = wanted.select("index").where("index is not null").distinct()
        named = sorted(r[0] for r in wanted.limit(NAMED + 1).collect())
    if len(named) <= NAMED:
        blocks: dict[int, list[int]] = {}
        for i in named:
            blocks.setdefault(i // size, []).append(i)
        if len(blocks) <= 16:  # few blocks: each with its own range
            parts = [rows.where((F.col("block") == b) & F.col("index").between(min(i), max(i)) & F.col("index").isin(*i)) for b, i in blocks.items()]
            return reduce(DataFrame.unionByName, parts).drop("block") if parts else rows.where(F.lit(False)).drop("block")
        return rows.where(F.col("block").isin(*blocks) & F.col("index").isin(*named)).drop("block")
    if isinstance(wanted, list):
        wanted = spark.createDataFrame([(i,) for i in named], "index long")
    keyed = wanted.select("index", F.floor(F.col("index") / size).cast("long").alias("block"))
    return rows.join(keyed, ["block", "index"], "left_semi").drop("block")


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """``task``, ``metric``, ``value`` of JSON results below a folder; the first file of a task wins."""
    rows = spark.read.schema("results map<string,map<string,double>>").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(folder)
    rows = rows.selectExpr("_metadata.file_path as file", "explode(results) as (task, metrics)")
    first = rows.withColumn("k", F.expr("row_number() over (partition by task order by file)")).where("k = 1")
    return first.selectExpr("task", "explode(metrics) as (metric, value)")


FORMATS = {
    "parquet": plain,
    "parquet_text": plain,
    "jsonl": jsonl_text,
    "jsonl_gz": jsonl_text,
    "parquet_pair": bitext,
    "parquet_qa": question_answer,
    "jsonl_instruct": jsonl_instruct,
    "jsonl_firefly": jsonl_kinds,
    "json_alpaca": json_array,
    "parquet_chat": chats,
    "parquet_chat_sharegpt": sharegpt,
    "parquet_magpie": sharegpt,
    "parquet_mc": choices_nested,
    "parquet_arc": choices_labelled,
    "parquet_mc_zh": choices_literal,
    "txt_wordlist": word_list,
    "parquet_mc_flat": choices_flat,
    "parquet_mc_test": choices_indexed,
}

#: What a format's rows are, for `read_text`.
PLAIN = ("parquet", "parquet_text", "jsonl", "jsonl_gz")
ANSWERED = ("parquet_qa", "jsonl_instruct", "jsonl_firefly", "json_alpaca")
CHOICES = ("parquet_mc", "parquet_arc", "parquet_mc_zh", "parquet_mc_flat", "parquet_mc_test")


def read_text(spark: SparkSession, fmt: str, paths: list[str], field: str | None = None, seed: int = 0, labels: dict[str, str] | None = None) -> DataFrame:
    """One ``text`` column of any registered format: plain texts as they are, conversations, questions and choices
    rendered with role labels, sentence pairs as blocks of 14."""
    how = {"field": field} if field else {}
    if fmt == "parquet_chat":  # roles that aren't known are kept, by name
        rows = _parquet(spark, sorted(paths), f"`{field or 'messages'}` as raw")
        turns = F.transform("raw", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("text")))
    elif fmt in ("parquet_chat_sharegpt", "parquet_magpie"):
        rows = _parquet(spark, sorted(paths), f"`{field or 'conversations'}` as raw")
        turns = F.transform("raw", lambda x: F.struct(x["from"].alias("role"), x["value"].alias("text")))
    else:
        rows = read(spark, fmt, paths, **how)
        if fmt in PLAIN:
            return rows.select("text")
        if fmt == "parquet_pair":
            return blocks.documents(rows, ["file", "ord"], seed).select("text")
        question = F.col("question")
        if fmt in CHOICES:
            if "context" in rows.columns:
                question = F.concat_ws("\n", F.nullif(F.col("context"), F.lit("")), question)
            question = t.render_choices_before(question, F.col("choices"))
        elif fmt not in ANSWERED:
            raise ValueError(f"{fmt!r} has no text form")
        turns = chat.asked(question, F.col("answer"))
    return rows.select(chat.rendered(turns, labels).alias("text")).where("text is not null")


def parts(spark: SparkSession, patterns: list[str], need: bool = True) -> list[str]:
    """The files that patterns of the file system match, sorted; none raises if they are needed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: set[str] = set()
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found |= {str(s.getPath()) for s in (path.getFileSystem(conf).globStatus(path) or [])}
    if need and not found:
        raise FileNotFoundError(f"nothing matches {patterns}")
    return sorted(found)


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file`` and ``sha`` of whole files."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha"))


def read(spark: SparkSession, fmt: str, paths: list[str], **how) -> DataFrame:
    """Rows of a registered format; an unknown one raises."""
    if fmt not in FORMATS:
        raise KeyError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    if not paths:
        raise FileNotFoundError("no files")
    return FORMATS[fmt](spark, sorted(paths), **how)


def probe(rows: DataFrame, column: str = "text", most: int = 20) -> tuple[int, float]:
    """Count and mean characters of the first rows; none raises."""
    n, mean = rows.limit(most).agg(F.count("*"), F.avg(F.char_length(column))).first()
    if not n:
        raise ValueError("the source has no rows")
    return n, mean
