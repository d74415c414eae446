"""Queries over tokens, masks, tasks and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import bitext, chat, generate, metrics, mix, packing, tokens
from quern.plans import tasks
from quern.plans.queries import SEQ, WORDS, query, r6

TOK = tokens.Bytes()
IDS = "list_transform(range(0, strlen({0})), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS INT), 2) AS INT) + 8)"


@query(f"SELECT item_id, {IDS.format('text')} AS ids FROM benchmark")
def encode_ids(d):
    return d.benchmark.select("item_id", TOK.encode(F.col("text")).alias("ids"))


@query("SELECT item_id, text FROM benchmark")
def decode_ids(d):
    ids = F.concat(F.array(F.lit(1)), TOK.encode(F.col("text")), F.array(F.lit(2)))
    return d.benchmark.select("item_id", TOK.decode(ids).alias("text"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {IDS.format('text')} AS ids, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
p AS (SELECT conv_id, turn, CASE WHEN role = 'system' AND k = 1 THEN ids || [6] WHEN role = 'user' THEN [3] || ids WHEN role = 'assistant' THEN [4] || ids || [5] ELSE [] END AS part FROM t)
SELECT conv_id, md5(array_to_string([1] || flatten(list(part ORDER BY turn)) || [4], ',')) AS digest, CAST(len(flatten(list(part ORDER BY turn))) + 2 AS BIGINT) AS n FROM p GROUP BY conv_id""")
def chat_template_ids(d):
    got = chat.conversations(d.conversations).select("conv_id", tokens.template(F.col("turns"), TOK, prompt=True).alias("ids"))
    return got.select("conv_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"), F.size("ids").cast("long").alias("n"))


ENCODED_SQL = f"""WITH w AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
sys AS (SELECT conv_id, CASE WHEN role = 'system' AND text <> '' THEN {IDS.format('text')} END AS s FROM w WHERE k = 1),
p AS (SELECT conv_id, turn, [3] || {IDS.format('text')} AS u, CASE WHEN next_role = 'assistant' THEN [4] ELSE [] END AS m, CASE WHEN next_role = 'assistant' THEN {IDS.format('next_text')} || [5] ELSE [] END AS a FROM w WHERE role = 'user'),
q AS (SELECT conv_id, turn, s, u || m || a AS ids, list_transform(u || m, lambda x: 0) || list_transform(a, lambda x: 1) AS mask FROM p JOIN sys USING (conv_id)),
r AS (SELECT * FROM q WHERE 1 + CASE WHEN s IS NULL THEN 0 ELSE len(s) + 1 END + len(ids) <= ROOM),
e0 AS (SELECT conv_id, [1] || coalesce(any_value(s), []) || [3] AS head, flatten(list(ids ORDER BY turn)) AS ids, flatten(list(mask ORDER BY turn)) AS mask FROM r GROUP BY conv_id),
e AS (SELECT conv_id, head || ids AS ids, list_transform(head, lambda x: 0) || mask AS mask FROM e0 WHERE len(head) + len(ids) <= ROOM AND list_contains(mask, 1))"""


@query(ENCODED_SQL.replace("ROOM", "2048") + " SELECT conv_id, md5(array_to_string(ids, ',')) AS ids, md5(array_to_string(mask, ',')) AS mask FROM e")
def encode_turns_ids(d):
    got = chat.encoded(d.conversations, TOK, 2048)
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return got.select("conv_id", digest("ids"), digest("mask"))


@query(ENCODED_SQL.replace("ROOM", "2048") + " SELECT conv_id, md5(array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN mask[i] = 1 THEN ids[i] ELSE -100 END), ',')) AS labels FROM e")
def labels_from_mask(d):
    """What a model is to predict in every encoded conversation: its supervised ids, -100 elsewhere."""
    labels = t.labels_from_mask(F.col("ids"), F.col("mask"))
    return chat.encoded(d.conversations, TOK, 2048).select("conv_id", F.md5(F.array_join(labels.cast("array<string>"), ",")).alias("labels"))


@query(ENCODED_SQL.replace("ROOM", "2048") + """, f AS (SELECT conv_id, conv_id % 4 AS task, unnest(ids) AS id, unnest(mask) AS m, unnest(range(len(ids))) AS i FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY conv_id, i) - 1 AS p, count(*) OVER (PARTITION BY task) AS n FROM f)
SELECT task, p // 1024 AS row, md5(string_agg(id, ',' ORDER BY p)) AS ids, CAST(sum(m) AS BIGINT) AS supervised FROM g WHERE p // 1024 < n // 1024 GROUP BY task, p // 1024""")
def pack_chat_stream(d):
    got = chat.encoded(d.conversations, TOK, 2048).withColumn("task", F.col("conv_id") % 4)
    off = packing.range_offsets(got, ["task"], "conv_id", F.size("ids"))
    pieces = packing.stream_pieces(off, SEQ)
    ids, mask = packing.stream_rows(pieces, ["task"], "ids"), packing.stream_rows(pieces, ["task"], "mask").withColumnRenamed("ids", "mask")
    out = ids.join(mask, ["task", "row"])
    return out.select("task", "row", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("supervised"))


@query(f"""SELECT conv_id, CAST(ceil(max(n) OVER (PARTITION BY b) / 1) AS BIGINT) AS width, CAST(b AS BIGINT) AS batch, n FROM (
  SELECT conv_id, n, (row_number() OVER (ORDER BY n, conv_id) - 1) // 8 AS b FROM (SELECT conv_id, CAST(sum({WORDS}) AS BIGINT) AS n FROM conversations GROUP BY conv_id))""")
def length_batches(d):
    rows = d.conversations.groupBy("conv_id").agg(F.sum(t.n_tokens(F.col("text"))).alias("n"))
    return mix.batches(rows, "conv_id", "n", 8).select("conv_id", "width", "batch", "n")


@query(f"""SELECT item_id, array_to_string({IDS.format('text')} || list_transform(range(0, w - strlen(text)), lambda i: 0), ',') AS ids,
  repeat('1', CAST(strlen(text) AS INT)) || repeat('0', CAST(w - strlen(text) AS INT)) AS attention
FROM (SELECT *, max(strlen(text)) OVER (PARTITION BY b) AS w FROM (SELECT *, (row_number() OVER (ORDER BY strlen(text), item_id) - 1) // 8 AS b FROM benchmark))""")
def right_pad(d):
    rows = d.benchmark.select("item_id", F.octet_length("text").alias("n"))
    wide = mix.batches(rows, "item_id", "n", 8).select("item_id", "width")
    got = d.benchmark.join(wide, "item_id").select("item_id", "width", TOK.encode(F.col("text")).alias("ids"))
    text = lambda c, by: F.array_join(c.cast("array<string>"), by)
    return got.select("item_id", text(t.right_padded(F.col("ids"), F.col("width"), 0), ",").alias("ids"), text(t.attention_mask(F.col("ids"), F.col("width")), "").alias("attention"))


@query(f"""SELECT batch, CAST(count(*) AS BIGINT) AS rows, round(1 - sum(n) / (count(*) * max(n)), 6) AS padding FROM (
  SELECT n, (row_number() OVER (ORDER BY n, conv_id) - 1) // 8 AS batch FROM (SELECT conv_id, CAST(sum({WORDS}) AS BIGINT) AS n FROM conversations GROUP BY conv_id HAVING sum({WORDS}) > 0)) GROUP BY batch""")
def padding_ratio(d):
    rows = d.conversations.groupBy("conv_id").agg(F.sum(t.n_tokens(F.col("text"))).alias("n")).where("n > 0")
    got = mix.batches(rows, "conv_id", "n", 8).groupBy("batch").agg(F.count("*").alias("rows"), r6(metrics.padding(F.col("n"), F.col("width"))).alias("padding"))
    return got.select("batch", "rows", "padding")


@query(f"""WITH e AS (SELECT item_id, {IDS.format('text')} AS c, [9, 10, 11] AS k FROM benchmark)
SELECT item_id, array_to_string((c || k)[greatest(len(c) - 60, 0) + 1:], ',') AS ids, CAST(len(c) - greatest(len(c) + 3 - 63, 0) AS INT) AS context FROM e""")
def scored_inputs(d):
    rows = d.benchmark.select("item_id", TOK.encode(F.col("text")).alias("c"))
    ids, context = t.scored_input(F.col("c"), F.array(*map(F.lit, (9, 10, 11))), 63)
    return rows.select("item_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"), context.alias("context"))


@query("SELECT conv_id, row_number() OVER (ORDER BY n DESC, conv_id) - 1 AS turn FROM (SELECT conv_id, sum(length(text)) AS n FROM conversations GROUP BY conv_id)")
def longest_first(d):
    rows = d.conversations.groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("n"))
    return mix.longest_first(rows, "conv_id", "n").select("conv_id", "turn")


@query("SELECT event_id, dense_rank() OVER (ORDER BY f) - 1 AS \"group\" FROM (SELECT event_id, min(event_id) OVER (PARTITION BY event_type, user_id % 3) AS f FROM events)")
def group_by_settings(d):
    rows = d.events.select("event_id", "event_type", (F.col("user_id") % 3).alias("k"))
    return mix.by_settings(rows, ["event_type", "k"], "event_id").select("event_id", "group")


# Generators

U = "CAST(('0x' || substring(md5({0}), 1, 7))::BIGINT / 268435456.0 AS DOUBLE)"
LIST_WORDS = "SELECT DISTINCT w AS word FROM (SELECT lower(unnest(string_split(text, ' '))) AS w FROM benchmark) WHERE regexp_matches(w, '^[a-z]+$')"


def word_list(d):
    return d.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where(F.col("word").rlike("^[a-z]+$")).distinct()


def _literal(options: list[str]) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for o in options) + "]"


@query(f"""WITH w AS (SELECT word, row_number() OVER (ORDER BY md5('42-' || word), word) - 1 AS r, count(*) OVER () AS n FROM ({LIST_WORDS}))
SELECT id, word, 'Spell the word: ' || word AS question, word || ':' || array_to_string(string_split(word, ''), ',') AS answer FROM (SELECT unnest(range(1000)) AS id) JOIN w ON w.r = id % w.n""")
def spelling_words(d):
    return generate.spelling(word_list(d), 1000, 42)


@query(f"""WITH w AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS r, count(*) OVER () AS n FROM ({LIST_WORDS})),
i AS (SELECT unnest(range(500)) AS id), a AS (SELECT id, word, {U.format("'0-own-' || id")} < 0.9 AS own, substr(word, CAST(floor({U.format("'0-place-' || id")} * length(word)) AS INT) + 1, 1) AS mine,
  substr('{generate.ALPHABET}', CAST(floor({U.format("'0-any-' || id")} * 26) AS INT) + 1, 1) AS other FROM i JOIN w ON w.r = floor({U.format("'0-word-' || id")} * w.n)),
b AS (SELECT id, word, CASE WHEN own THEN mine ELSE other END AS letter, {_literal(generate.QUESTIONS)}[CAST(floor({U.format("'0-form-' || id")} * 25) AS INT) + 1] AS form,
  {_literal(generate.QUOTES)}[CAST(floor({U.format("'0-quote-' || id")} * 3) AS INT) + 1] AS lq, {_literal(generate.QUOTES)}[CAST(floor({U.format("'0-word quote-' || id")} * 3) AS INT) + 1] AS wq FROM a),
c AS (SELECT *, CASE WHEN {U.format("'0-low-' || id")} < 0.3 THEN lower(form) ELSE form END AS f, CAST(length(word) - length(replace(word, letter, '')) AS VARCHAR) AS k FROM b)
SELECT id, word, letter, replace(replace(f, '{{letter}}', lq || letter || lq), '{{word}}', wq || word || wq) || CASE WHEN {U.format("'0-mark-' || id")} < 0.5 THEN '?' ELSE '' END AS question,
  'We are asked to find the number ''' || letter || ''' in the word ''' || word || '''. Let me try a manual approach first.' || chr(10) || chr(10) || 'First spell the word out:' || chr(10) || word || ':' || array_to_string(string_split(word, ''), ',')
  || chr(10) || chr(10) || 'Then count the occurrences of ''' || letter || ''':' || chr(10) || array_to_string(list_transform(range(1, length(word) + 1), lambda i: i || ':' || word[i] || CASE WHEN word[i] = letter THEN ' hit! count=' || (length(word[1:i]) - length(replace(word[1:i], letter, ''))) ELSE '' END || chr(10)), '')
  || chr(10) || 'This gives us ' || k || '.' || chr(10) || chr(10) || 'My final answer is:' || chr(10) || chr(10) || '#### ' || k AS answer FROM c""")
def counting_questions(d):
    return generate.counting(word_list(d), 500, 0)


WHO = {"en": [("Who are you?", "A small model."), ("Which languages do you speak?", "Two.")], "zh": [("你是谁?", "一个小模型。"), ("你会说哪些语言?", "两种。")]}


@query(f"""WITH i AS (SELECT unnest(range((SELECT count(*) FROM conversations))) AS id), a AS (SELECT id, ['en', 'zh'][CAST(floor({U.format("'7-lang-' || id")} * 2) AS INT) + 1] AS lang, CAST(floor({U.format("'7-pair-' || id")} * 2) AS INT) + 1 AS p,
  CASE WHEN {U.format("'7-has-' || id")} < 0.3 THEN ['Hey, ', 'So, '][CAST(floor({U.format("'7-prefix-' || id")} * 2) AS INT) + 1] ELSE '' END AS before FROM i)
SELECT id, lang, before || CASE lang WHEN 'en' THEN {_literal([q for q, _ in WHO['en']])}[p] ELSE {_literal([q for q, _ in WHO['zh']])}[p] END AS question,
  CASE lang WHEN 'en' THEN {_literal([a for _, a in WHO['en']])}[p] ELSE {_literal([a for _, a in WHO['zh']])}[p] END AS answer FROM a""")
def identity_rows(d):
    """As many rows as there are turns of conversations that they are to be mixed with."""
    return generate.identity(d.spark, d.conversations.count(), 7, WHO, ["Hey, ", "So, "])


# Pairs of sentences

PAIRS = """SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS en, regexp_replace(lead(text) OVER (ORDER BY doc_id), '^\\s+|\\s+$', '', 'g') AS zh FROM documents"""


@query(f"""WITH p AS ({PAIRS}), k AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 14 AS grp FROM p WHERE en <> '' AND zh <> '' AND length(en) <= 1000 AND length(zh) <= 1000),
g AS (SELECT *, CASE WHEN {U.format("'5-direction-' || grp")} < 0.5 THEN 'zh-en' ELSE 'en-zh' END AS dir, {_literal(bitext.SEPARATORS).replace(chr(9), "' || chr(9) || '")}[CAST(floor({U.format("'5-separator-' || grp")} * 3) AS INT) + 1] AS sep,
  CAST(floor({U.format("'5-header-' || grp")} * 4) AS INT) + 1 AS hd, CAST(floor({U.format("'5-labels-' || grp")} * 4) AS INT) + 1 AS lb FROM k),
f AS (SELECT *, CASE dir WHEN 'zh-en' THEN {_literal(bitext.HEADERS['zh-en'])}[hd] ELSE {_literal(bitext.HEADERS['en-zh'])}[hd] END AS header,
  CASE dir WHEN 'zh-en' THEN {_literal([a for a, _ in bitext.LABELS['zh-en']])}[lb] ELSE {_literal([a for a, _ in bitext.LABELS['en-zh']])}[lb] END AS l1,
  CASE dir WHEN 'zh-en' THEN {_literal([b for _, b in bitext.LABELS['zh-en']])}[lb] ELSE {_literal([b for _, b in bitext.LABELS['en-zh']])}[lb] END AS l2,
  CASE dir WHEN 'zh-en' THEN zh ELSE en END AS s, CASE dir WHEN 'zh-en' THEN en ELSE zh END AS o FROM g)
SELECT grp, any_value(header) || string_agg(CASE WHEN sep = chr(9) THEN s || chr(9) || o || chr(10) ELSE l1 || sep || s || chr(10) || l2 || sep || o || chr(10) || chr(10) END, '' ORDER BY doc_id) AS text FROM f GROUP BY grp""")
def bitext_format(d):
    from quern.sources.readers import pair_filter

    # each text beside the next, by places that come from ranges
    rows = mix.placed(d.documents.select("doc_id"), [], ["doc_id"])
    texts = rows.join(d.documents.select("doc_id", "text"), "doc_id")
    following = texts.select((F.col("at") - 1).alias("at"), F.col("text").alias("zh"))
    pairs = texts.select("doc_id", "at", F.col("text").alias("en")).join(following, "at").drop("at")
    return bitext.documents(pair_filter(pairs), ["doc_id"], 5)


# Tasks and mixes


def _task(d, name: str, lang: str, stop: int | None = None) -> tasks.Task:
    def build(spark):
        convs = chat.conversations(d.conversations).where((F.col("conv_id") % 2) == (0 if name == "even" else 1))
        return convs.select(F.col("conv_id").alias("ord"), chat.known_roles(F.col("turns")).alias("turns")).where("size(turns) > 0")

    return tasks.Task(name, build, lang, stop)


@query(f"""WITH c AS (SELECT conv_id, CAST(sum({WORDS}) AS BIGINT) AS tokens FROM conversations WHERE role IN ('system', 'user', 'assistant') AND coalesce(text, '') <> '' GROUP BY conv_id),
e AS (SELECT 'even' AS task, tokens FROM c WHERE conv_id % 2 = 0 UNION ALL SELECT 'odd', tokens FROM (SELECT * FROM c WHERE conv_id % 2 = 1 ORDER BY conv_id LIMIT 20) UNION ALL SELECT 'even', tokens FROM c WHERE conv_id % 2 = 0)
SELECT task, CAST(count(*) AS BIGINT) AS rows, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY task""")
def mix_totals(d):
    mixed = tasks.Mixture((_task(d, "even", "en"), _task(d, "odd", "en", 20), _task(d, "even", "en")))
    size = F.aggregate(F.transform("turns", lambda x: t.n_tokens(x["text"])), F.lit(0).cast("long"), lambda a, x: a + x)
    return tasks.totals(mixed.rows(d.spark), size)


@query("SELECT round(sum(CAST(abs(x) AS DOUBLE)) FILTER (x > 0) / greatest(count(*) FILTER (x > 0), 1), 6) AS loss, CAST(count(*) FILTER (x > 0) AS BIGINT) AS valid FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def masked_loss(d):
    rows = d.embeddings.select(F.explode("embedding").alias("x"))
    return rows.agg(r6(metrics.masked_loss(F.abs(F.col("x").cast("double")), F.col("x") > 0)).alias("loss"), F.count(F.when(F.col("x") > 0, 1)).alias("valid"))


@query(f"SELECT lang, round(sum({WORDS}) / greatest(sum(length(text)), 1), 6) AS ratio FROM documents GROUP BY lang")
def tokens_per_char(d):
    return d.documents.groupBy("lang").agg(r6(metrics.tokens_per_char(t.n_tokens(F.col("text")), F.col("text"))).alias("ratio"))
