"""Queries that write files of each format to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import storage
from quern.functions import text as t
from quern.operators import chat
from quern.plans import library
from quern.plans.queries import query
from quern.plans.tasks import Mixture
from quern.sources import readers, registry, sinks


def put(d, rows, kind: str) -> list[str]:
    """The files of ``rows`` written as ``kind``."""
    path = storage.new_path(d.spark, kind)
    getattr(rows.write, kind)(path)
    return [path]


def turns(d, *names: str):
    """A conversation a row: ``conv_id`` and an array of structs with these field names."""
    convs = chat.conversations(d.conversations)
    return convs.select("conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias(names[0]), x["text"].alias(names[1]))).alias("x"))


CHAT_SQL = """SELECT md5(string_agg({role} || ':' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE {where} AND coalesce(text, '') <> '' GROUP BY conv_id"""
SAID = "CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' WHEN 'system' THEN '系统' ELSE role END"


@query(CHAT_SQL.format(role="role", where="role IN ('system', 'user', 'assistant')"))
def read_chats(d):
    got = readers.read(d.spark, "parquet_chat", put(d, turns(d, "role", "content").select(F.col("x").alias("messages")), "parquet"))
    return got.select(F.md5(chat.rendered(F.col("turns"), {})).alias("digest"))


@query(CHAT_SQL.format(role="role", where="role IN ('user', 'assistant')"))
def read_sharegpt(d):
    rows = turns(d, "from", "value").select(F.transform("x", lambda m: F.struct(F.when(m["from"] == "user", "human").when(m["from"] == "assistant", "gpt").otherwise("tool").alias("from"), m["value"].alias("value"))).alias("conversations"))
    got = readers.read(d.spark, "parquet_chat_sharegpt", put(d, rows, "parquet"))
    return got.select(F.md5(chat.rendered(F.col("turns"), {})).alias("digest"))


@query(CHAT_SQL.format(role=SAID, where="true"))
def text_of_chats(d):
    got = readers.read_text(d.spark, "parquet_chat", put(d, turns(d, "role", "content").select(F.col("x").alias("messages")), "parquet"))
    return got.select(F.md5("text").alias("digest"))


@query("SELECT text FROM documents WHERE text IS NOT NULL AND text <> ''")
def text_of_jsonl(d):
    return readers.read_text(d.spark, "jsonl", put(d, d.documents.select("text"), "json"))


@query("SELECT '用户:' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'more ' || item_id ELSE '' END || chr(10) || chr(10) || '助手:' || 'a' || item_id AS text FROM benchmark WHERE item_id % 5 > 0")
def text_of_instructions(d):
    extra = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" more "), F.col("item_id").cast("string")))
    rows = d.benchmark.select(F.col("text").alias("instruction"), extra.alias("input"), F.when(F.col("item_id") % 5 > 0, F.concat(F.lit("a"), F.col("item_id").cast("string"))).otherwise(" ").alias("output"))
    return readers.read_text(d.spark, "jsonl_instruct", put(d, rows, "json"))


@query("SELECT '用户:' || text || chr(10) || 'A. x' || chr(10) || 'B. ' || item_id || chr(10) || chr(10) || '助手:' || CASE WHEN item_id % 2 = 0 THEN 'A' ELSE 'B' END AS text FROM benchmark WHERE item_id % 3 < 2")
def text_of_choices(d):
    answer = F.when(F.col("item_id") % 3 < 2, F.col("item_id") % 2).otherwise(7).cast("int")
    train = F.struct(F.col("text").alias("question"), F.array(F.lit("x"), F.col("item_id").cast("string")).alias("choices"), answer.alias("answer")).alias("train")
    return readers.read_text(d.spark, "parquet_mc", put(d, d.benchmark.select(train), "parquet"))


@query("SELECT text AS question, 'B' AS answer, CAST(2 AS BIGINT) AS n FROM benchmark WHERE item_id % 4 > 1")
def read_labelled_choices(d):
    label = F.when(F.col("item_id") % 4 == 0, F.array(F.lit("A"), F.lit("C"))).when(F.col("item_id") % 4 == 1, F.array(F.lit("A"), F.lit("B"), F.lit("C"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    rows = d.benchmark.select(F.col("text").alias("question"), F.struct(label.alias("label"), F.array(F.lit("x"), F.lit("y")).alias("text")).alias("choices"), F.lit("B").alias("answerKey"))
    got = readers.read(d.spark, "parquet_arc", put(d, rows, "parquet"))
    return got.select("question", "answer", F.size("letters").cast("long").alias("n"))


@query("SELECT 'l1' || chr(10) || item_id AS context, CASE WHEN item_id % 3 = 0 THEN 'A' ELSE 'B' END AS answer FROM benchmark WHERE item_id % 3 < 2")
def read_literal_choices(d):
    answer = F.when(F.col("item_id") % 3 == 0, "x").when(F.col("item_id") % 3 == 1, "y").otherwise("z")
    rows = d.benchmark.select(F.array(F.lit("l1"), F.col("item_id").cast("string")).alias("context"), F.col("text").alias("question"), F.array(F.lit("x"), F.lit("y")).alias("choice"), answer.alias("answer"))
    return readers.read(d.spark, "parquet_mc_zh", put(d, rows, "parquet")).select("context", "answer")


@query("SELECT text AS question, ['B', 'C', 'D'][item_id % 3 + 1] AS answer FROM benchmark UNION ALL SELECT text, ['A', 'B'][item_id % 2 + 1] FROM benchmark")
def choice_loaders(d):
    flat = d.benchmark.select(F.col("text").alias("question"), *[F.lit(x).alias(x) for x in "ABCD"], F.get(F.array(*map(F.lit, "BCD")), (F.col("item_id") % 3).cast("int")).alias("answer"))
    indexed = d.benchmark.select(F.col("text").alias("question"), F.array(F.lit("x"), F.lit("y")).alias("choices"), (F.col("item_id") % 2).cast("int").alias("answer"))
    one = readers.read(d.spark, "parquet_mc_flat", put(d, flat, "parquet")).select("question", "answer")
    return one.unionByName(readers.read(d.spark, "parquet_mc_test", put(d, indexed, "parquet")).select("question", "answer"))


@query("SELECT CASE WHEN item_id % 3 = 0 THEN 'Program' ELSE 'OpenQA' END AS kind, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS question FROM benchmark WHERE item_id % 3 < 2")
def read_kinds(d):
    kind = F.when(F.col("item_id") % 3 == 0, "Program").when(F.col("item_id") % 3 == 1, "OpenQA").otherwise("Couplet")
    rows = d.benchmark.select(kind.alias("kind"), F.col("text").alias("input"), F.lit("yes").alias("target"))
    return readers.read(d.spark, "jsonl_firefly", put(d, rows, "json"), kinds=readers.KINDS).select("kind", "question")


@query("SELECT text AS question, CAST(item_id AS VARCHAR) AS answer FROM benchmark WHERE item_id % 7 > 0")
def read_questions(d):
    rows = d.benchmark.select(F.col("text").alias("question"), F.when(F.col("item_id") % 7 > 0, F.concat(F.col("item_id").cast("string"), F.lit("<<1+1=2>>"))).otherwise("").alias("answer"))
    got = readers.read(d.spark, "parquet_qa", put(d, rows, "parquet"))
    return got.select("question", t.strip_calc_tags(F.col("answer")).alias("answer"))


@query("SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS en, 'z' || item_id AS zh FROM benchmark WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) BETWEEN 1 AND 1000 AND item_id % 4 > 0")
def read_pairs(d):
    zh = F.when(F.col("item_id") % 4 > 0, F.concat(F.lit("　z"), F.col("item_id").cast("string"))).otherwise("　 ")
    rows = d.benchmark.select(F.struct(F.col("text").alias("en"), zh.alias("zh")).alias("translation"))
    return readers.read(d.spark, "parquet_pair", put(d, rows, "parquet")).select("en", "zh")


@query("SELECT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE regexp_matches(w, '^[A-Za-zÀ-ÖØ-öø-ÿ]+$')")
def read_word_list(d):
    rows = d.benchmark.select(F.explode(F.split("text", " ")).alias("value")).where(~F.contains("value", F.lit("\n")))
    return readers.read(d.spark, "txt_wordlist", put(d, rows, "text"))


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS ord, 's' || item_id AS src, 'r' || item_id AS ref FROM benchmark")
def read_line_pairs(d):
    """Two line-aligned files of one part each."""
    rows = d.benchmark.coalesce(1).sortWithinPartitions("item_id")
    src, ref = (put(d, rows.select(F.concat(F.lit(x), F.col("item_id").cast("string"), F.lit(" ")).alias("value")), "text")[0] for x in ("s", "r"))
    return readers.line_pairs(d.spark, src, ref)


@query("SELECT source, CAST(count(*) AS BIGINT) AS docs, md5(string_agg(text, '' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def sharded_sink(d):
    path = storage.new_path(d.spark, "sharded")
    sinks.sharded(d.documents.withColumn("shard", F.col("doc_id") % 3), path)
    back = d.spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("docs"), F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    return back.select("source", "docs", F.md5(F.array_join(F.transform("x", lambda r: r["text"]), "")).alias("digest"))


@query("SELECT row_number() OVER (ORDER BY s, vec_id) - 1 AS index, CAST(s AS BIGINT) AS shard, CAST(CASE WHEN label % 3 = 0 THEN -100 ELSE label END AS INT) AS label FROM (SELECT *, CAST(vec_id % 2 AS INT) AS s FROM embeddings)")
def packed_by_index(d):
    """Two shards with their masks, one file each, by global index."""
    ids, masks = [], []
    for s in (0, 1):
        rows = d.embeddings.where(F.col("vec_id") % 2 == s).coalesce(1).sortWithinPartitions("vec_id")
        ids += put(d, rows.select(F.array("label").alias("ids")), "parquet")
        masks += put(d, rows.select(F.array(F.when(F.col("label") % 3 == 0, 0).otherwise(1)).alias("mask")), "parquet")
    got = readers.packed(d.spark, ids, masks)
    return got.select("index", F.col("shard").cast("long").alias("shard"), F.col("labels")[0].alias("label"))


@query("SELECT source AS name, CAST(count(*) FILTER (doc_id % 3 = 0 AND lang <> 'de') AS BIGINT) AS present, CAST(count(*) FILTER (lang = 'en') + 1 AS INT) AS needed FROM documents GROUP BY source")
def source_status(d):
    """Sources of documents, their parts that are there and those that they need."""
    sources = d.documents.groupBy(F.col("source").alias("name")).agg((F.count(F.when(F.col("lang") == "en", 1)) + 1).cast("int").alias("n_parts"))
    present = d.documents.where("doc_id % 3 = 0 and lang <> 'de'").select(F.col("source").alias("name"), F.col("doc_id").cast("string").alias("path"))
    return registry.status(sources, present)


@query("SELECT DISTINCT url AS path FROM pages WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0 AND url IS NOT NULL)")
def missing_files(d):
    path = lambda k: d.pages.where(F.col("page_id") % 2 == k).select(F.col("url").alias("path")).distinct()
    return registry.missing(path(1), path(0))


@query("SELECT source, sha256(string_agg(doc_id || ' ' || md5(coalesce(text, '')), chr(10) ORDER BY doc_id) || chr(10)) AS sha FROM documents WHERE source IS NOT NULL GROUP BY source")
def file_digests(d):
    """A file a source with a line a document, and the digests of these files."""
    path = storage.new_path(d.spark, "listed")
    lines = F.concat_ws(" ", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))).alias("value")
    dealt = d.documents.where("source is not null").select("source", "doc_id", lines).repartition("source").sortWithinPartitions("source", "doc_id")
    dealt.select("source", "value").write.partitionBy("source").text(path)
    found = readers.parts(d.spark, [f"{path}/source=*/part-*"])
    return readers.digests(d.spark, found).select(F.regexp_extract("file", "source=([^/]*)/", 1).alias("source"), "sha")


@query("""WITH c AS (SELECT conv_id, sum(length(text)) AS n FROM conversations WHERE role IN ('system', 'user', 'assistant') AND coalesce(text, '') <> '' GROUP BY conv_id),
q AS (SELECT item_id, length(text) + length('7 ' || item_id) AS n FROM benchmark WHERE coalesce(text, '') <> ''),
m AS (SELECT item_id, length('Multiple Choice question: ' || text || chr(10) || '- x=A' || chr(10) || '- ' || item_id || '=B' || chr(10) || chr(10) || 'Respond only with the letter of the correct answer.') + 1 AS n FROM benchmark WHERE item_id % 3 < 2),
e AS (SELECT 'SmolTalk' AS task, 'en' AS lang, n FROM c, range(2) UNION ALL SELECT 'GSM8K_Train', 'en', n FROM q, range(4) UNION ALL SELECT 'MMLU_AuxTrain', 'en', n FROM m)
SELECT task, lang, CAST(count(*) AS BIGINT) AS rows, CAST(sum(n) AS BIGINT) AS chars FROM e GROUP BY task, lang""")
def mix_by_sql(d):
    """Named tasks over files, read as table functions: two epochs of conversations, four of questions, one of choices."""
    base = storage.new_path(d.spark, "library")
    answer = F.when(F.col("item_id") % 3 < 2, F.col("item_id") % 2).otherwise(7).cast("int")
    train = F.struct(F.col("text").alias("question"), F.array(F.lit("x"), F.col("item_id").cast("string")).alias("choices"), answer.alias("answer")).alias("train")
    turns(d, "role", "content").select(F.col("x").alias("messages")).write.parquet(f"{base}/SmolTalk")
    d.benchmark.select(F.col("text").alias("question"), F.concat(F.lit("<<3+4=7>>7 "), F.col("item_id").cast("string")).alias("answer")).write.parquet(f"{base}/GSM8K_Train")
    d.benchmark.select(train).write.parquet(f"{base}/MMLU_AuxTrain")
    named = library.Library(base)
    library.publish(d.spark, Mixture(tuple(named.task(x) for x in ("SmolTalk", "GSM8K_Train", "MMLU_AuxTrain"))))
    return d.spark.sql("""SELECT task, lang, count(*) AS rows, sum(aggregate(turns, 0L, (a, x) -> a + char_length(x.text))) AS chars
        FROM (SELECT * FROM smoltalk(2) UNION ALL SELECT * FROM gsm8k_train(epochs => 4) UNION ALL SELECT * FROM mmlu_auxtrain()) GROUP BY task, lang""")
