"""Every query over the driver tables, each with its DuckDB counterpart.

A query is registered by ``@query(sql)``; its function takes a loader of tables.
Sources of ``documents`` stand for corpus sources, ``conversations`` for chats,
``labels`` for gold labels and ``events`` for metric series. Queries over files,
evaluation and tokens are in the modules imported at the end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import storage
from quern.functions import text as t
from quern.operators import chat, generate, metrics, mix, packing, reports
from quern.plans.queries import ORACLE_SQL, QUERIES, SEQ, WORDS, query, r6


# Scans, filters and scalar functions


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''")
def scan_nonempty(d):
    return d.documents.select("doc_id", "text").where("text is not null and text <> ''")


@query("SELECT doc_id, substring(text, 1, 500) AS text, CAST(length(substring(text, 1, 500)) AS BIGINT) AS chars FROM documents")
def truncate_chars(d):
    cut = t.truncated(F.col("text"), 500)
    return d.documents.select("doc_id", cut.alias("text"), F.char_length(cut).cast("long").alias("chars"))


@query(r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) BETWEEN 20 AND 400")
def length_band(d):
    return d.documents.where(F.char_length(t.strip(F.col("text"))).between(20, 400)).select("doc_id")


@query(f"SELECT lang, source, CAST(count(*) AS BIGINT) AS n, CAST(sum({WORDS}) AS BIGINT) AS tokens FROM documents GROUP BY lang, source")
def tokens_by_source(d):
    return d.documents.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(t.n_tokens(F.col("text"))).alias("tokens"))


@query("SELECT doc_id, round(len(regexp_extract_all(text, '[一-鿿]')) / greatest(length(text), 1), 6) AS share FROM documents")
def cjk_ratio(d):
    return d.documents.select("doc_id", r6(t.cjk_share(F.col("text"))).alias("share"))


REP_SQL = """WITH g AS (
  SELECT doc_id, length(text) AS n, list_transform(range(0, length(text) - 24, 24), lambda i: substring(text, i + 1, 24)) AS gs FROM documents)
SELECT doc_id, CASE WHEN n < 48 THEN 0.0 ELSE round(1 - len(list_distinct(gs)) / len(gs), 6) END AS rep FROM g"""


@query(REP_SQL)
def repetition_ratio(d):
    return d.documents.select("doc_id", r6(t.repetition(F.col("text"))).alias("rep"))


@query(f"""WITH g AS (
  SELECT doc_id, text, length(text) AS n, list_transform(range(0, length(text) - 24, 24), lambda i: substring(text, i + 1, 24)) AS gs FROM documents)
SELECT doc_id, ends_with(text, '.') AND {WORDS} >= 150 AND (n < 48 OR 1 - len(list_distinct(gs)) / len(gs) < 0.2) AS ok FROM g""")
def longform_ok(d):
    ok = t.longform_ok(F.endswith("text", F.lit(".")), t.n_tokens(F.col("text")), t.repetition(F.col("text")))
    return d.documents.select("doc_id", ok.alias("ok"))


@query(r"""SELECT doc_id, regexp_replace(substring(text, 1, least(coalesce(nullif(instr(text, ','), 0), 1 << 30), coalesce(nullif(instr(text, chr(10)), 0), 1 << 30), length(text) + 1) - 1), '^\s+|\s+$', '', 'g') AS first
FROM documents""")
def trim_continuation(d):
    return d.documents.select("doc_id", t.cut_at_earliest(F.col("text"), [",", "\n"]).alias("first"))


@query("SELECT doc_id, split_part(split_part(text, '. ', 1), ', ', 1) AS cut FROM documents")
def cut_at_stops(d):
    return d.documents.select("doc_id", t.cut_in_turn(F.col("text"), [". ", ", "]).alias("cut"))


@query("SELECT item_id, regexp_replace('<<1+1=2>>' || text || '<<x>>', '<<[^>]*>>', '', 'g') AS text FROM benchmark")
def strip_calc_tags(d):
    return d.benchmark.select("item_id", t.strip_calc_tags(F.concat(F.lit("<<1+1=2>>"), "text", F.lit("<<x>>"))).alias("text"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, props IS NOT NULL AND json_valid(props) AS valid FROM events")
def json_tolerant(d):
    got = F.from_json("props", "page string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return d.events.select("event_id", got.alias("x"), "props").select("event_id", F.col("x.page").alias("page"), (F.col("props").isNotNull() & F.col("x._bad").isNull()).alias("valid"))


@query("SELECT DISTINCT regexp_extract(url, '://([^/?#]*)(/[^?#]*)', 2) AS path FROM pages WHERE regexp_matches(regexp_extract(url, '://([^/?#]*)(/[^?#]*)', 2), '^/en/[^/]*\\.html$')")
def file_glob_filter(d):
    path = F.regexp_extract("url", "://([^/?#]*)(/[^?#]*)", 2).alias("path")
    return d.pages.select(path).where(F.col("path").rlike(t.glob_to_regex("/en/*.html"))).distinct()


# Registry, quotas, shards

MIX = [("src0", 0.3), ("src1", 0.2), ("src2", 0.1), ("nowhere", 0.4)]
MIX_SQL = "(VALUES " + ", ".join(f"('{s}', {w})" for s, w in MIX) + ") AS m(source, weight)"


def recipe(d):
    return d.spark.createDataFrame(MIX, "source string, weight double")


@query(f"SELECT source, CAST(weight AS DOUBLE) AS weight, CAST(count(*) AS BIGINT) AS docs FROM {MIX_SQL} JOIN documents USING (source) GROUP BY source, weight")
def mix_weight_join(d):
    return d.documents.join(F.broadcast(recipe(d)), "source").groupBy("source", "weight").agg(F.count("*").alias("docs"))


@query(f"SELECT source FROM {MIX_SQL} WHERE source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def missing_source_anti(d):
    return recipe(d).join(d.documents, "source", "left_anti").select("source")


@query("""WITH f AS (SELECT source, CAST(count(*) AS BIGINT) AS files FROM documents GROUP BY source),
w AS (SELECT source, files, files / sum(files) OVER () AS weight FROM f),
q AS (SELECT source, files, CAST(floor(weight * 1000000) AS BIGINT) AS tokens FROM w),
s AS (SELECT *, greatest(least(CAST(ceil(tokens / 20000) AS BIGINT), files), 1) AS shards FROM q)
SELECT source, files, tokens, shards, tokens // shards AS shard_tokens, greatest(tokens // shards // 1024, 1) AS shard_rows FROM s""")
def quota_plan(d):
    files = d.documents.groupBy("source").agg(F.count("*").alias("files"))
    total = files.agg(F.sum("files").alias("all"))
    weights = files.crossJoin(F.broadcast(total)).select("source", "files", (F.col("files") / F.col("all")).alias("weight"))
    return mix.quotas(weights, 1_000_000, SEQ, 20_000, 4).select("source", "files", "tokens", "shards", "shard_tokens", "shard_rows")


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS shard FROM documents")
def shard_round_robin(d):
    return mix.round_robin(d.documents.select("doc_id", "source"), 4, "source", "doc_id").select("doc_id", "shard")


@query(f"""SELECT doc_id, source, n, CAST(b AS BIGINT) AS before FROM (
  SELECT doc_id, source, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS b FROM (SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS n FROM documents)) WHERE b < 5000""")
def token_budget_cut(d):
    return mix.token_budget(d.documents, "source", "doc_id", t.n_tokens(F.col("text")), 5000)


# Continuous packing

SHARD_TOKENS = 10_000  # of a shard as planned; a production plan has hundreds of millions

LENGTHS = f"SELECT doc_id, source, CAST({WORDS} + 1 AS BIGINT) AS n FROM documents WHERE text IS NOT NULL AND text <> ''"
OFFSETS_SQL = f"""WITH l0 AS ({LENGTHS}), plan AS (SELECT source, greatest(CAST(ceil(sum(n - 1) / {SHARD_TOKENS}) AS BIGINT), 1) AS shards FROM l0 GROUP BY source),
l AS (SELECT doc_id, source, doc_id % shards AS shard, n FROM l0 JOIN plan USING (source)),
o AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source, shard) AS BIGINT) AS total, CAST(sum(n) OVER (PARTITION BY source, shard ORDER BY doc_id) - n AS BIGINT) AS off FROM l)"""


def sharded(d):
    docs = d.documents.where("text is not null and text <> ''").select("doc_id", "source", t.n_tokens(F.col("text")).alias("size"))
    return packing.planned_shards(docs, "source", "doc_id", F.col("size"), SHARD_TOKENS)


def offsets(d):
    return packing.stream_offsets(sharded(d), ["source", "shard"], "doc_id", F.col("size"))


@query(OFFSETS_SQL + " SELECT doc_id, source, shard, n, off, total FROM o")
def pack_stream_offsets(d):
    return offsets(d).select("doc_id", "source", "shard", "n", "off", "total")


PIECES_SQL = OFFSETS_SQL + f""", p AS (SELECT *, unnest(range(off // {SEQ}, (off + n - 1) // {SEQ} + 1)) AS row FROM o),
q AS (SELECT doc_id, source, shard, row, greatest(row * {SEQ} - off, 0) AS lo, least((row + 1) * {SEQ} - off, n) AS hi, off FROM p WHERE row < total // {SEQ})"""


@query(PIECES_SQL + " SELECT doc_id, source, shard, row, lo, hi FROM q")
def pack_stream_pieces(d):
    return packing.stream_pieces(offsets(d), SEQ).select("doc_id", "source", "shard", "row", "lo", "hi")


@query(PIECES_SQL + " SELECT source, shard, row, CAST(count(*) AS BIGINT) AS pieces, CAST(sum(hi - lo) AS BIGINT) AS tokens, min(doc_id) AS first_doc FROM q GROUP BY source, shard, row")
def pack_stream_rows(d):
    got = packing.stream_pieces(offsets(d), SEQ).groupBy("source", "shard", "row")
    return got.agg(F.count("*").alias("pieces"), F.sum(F.col("hi") - F.col("lo")).alias("tokens"), F.min("doc_id").alias("first_doc"))


@query(PIECES_SQL.replace("row < total // {SEQ}".format(SEQ=SEQ), "row < least(total // {SEQ}, 3)".format(SEQ=SEQ)) + " SELECT source, shard, row, CAST(count(*) AS BIGINT) AS pieces, CAST(sum(hi - lo) AS BIGINT) AS tokens FROM q GROUP BY source, shard, row")
def pack_stream_target(d):
    """At most three rows a shard, as a shard's row target asks for."""
    got = packing.stream_pieces(offsets(d), SEQ, 3).groupBy("source", "shard", "row")
    return got.agg(F.count("*").alias("pieces"), F.sum(F.col("hi") - F.col("lo")).alias("tokens"))


@query()
def pack_bos_bestfit(d):
    docs = sharded(d).withColumn("no", F.xxhash64("source", "shard"))
    return packing.bos_best_fit(docs, "no", "doc_id", "size", SEQ)


@query()
def pack_bos_target(d):
    docs = sharded(d).withColumn("no", F.xxhash64("source", "shard"))
    return packing.bos_best_fit(docs, "no", "doc_id", "size", SEQ, target=4)


@query()
def pack_drop_rate(d):
    got = pack_bos_bestfit(d).where("row = -1")
    return got.agg(F.sum("ord").alias("tokens_in"), F.sum("at").alias("dropped"), (F.sum("at") / F.sum("ord")).alias("rate"))


# Conversations


def convs(d):
    return chat.conversations(d.conversations)


TURNS_SQL = "SELECT conv_id, turn, text, CASE WHEN next_role = 'assistant' THEN next_text END AS answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'"


@query(TURNS_SQL)
def turn_pairs(d):
    return chat.pairs(d.conversations)


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' AND before IS DISTINCT FROM 'user' THEN 'orphan' WHEN role = 'user' AND next IS DISTINCT FROM 'assistant' THEN 'open' WHEN role IN ('user', 'assistant') THEN 'paired' ELSE 'other' END AS state
FROM (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def orphan_turns(d):
    return chat.turn_states(d.conversations)


@query("""SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' WHEN 'system' THEN '系统' ELSE role END || ':' || text, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations WHERE coalesce(text, '') <> '' GROUP BY conv_id""")
def render_chat_text(d):
    return convs(d).select("conv_id", chat.rendered(F.col("turns")).alias("text")).where("text is not null")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns FROM conversations WHERE role IN ('system', 'user', 'assistant') AND coalesce(text, '') <> '' GROUP BY conv_id")
def role_filter(d):
    return convs(d).select("conv_id", F.size(chat.known_roles(F.col("turns"))).cast("long").alias("turns")).where("turns > 0")


@query("SELECT CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS role, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1")
def role_remap(d):
    return d.conversations.groupBy(chat.remapped(F.col("role"), {"user": "human", "assistant": "gpt"}).alias("role")).agg(F.count("*").alias("n"))


LENGTHS_SQL = f"""WITH p AS ({TURNS_SQL}), f AS (SELECT conv_id, arg_min(role, turn) AS role, arg_min(coalesce(text, ''), turn) AS text FROM conversations GROUP BY conv_id),
h AS (SELECT conv_id, role = 'system' AND text <> '' AS opened, CASE WHEN role = 'system' THEN {WORDS} ELSE 0 END AS h FROM f),
n AS (SELECT conv_id, opened, h, 1 + coalesce({WORDS}, 0) + CASE WHEN answer IS NOT NULL THEN 2 + {WORDS.replace('text', 'answer', 1)} ELSE 0 END AS n,
  CASE WHEN answer IS NOT NULL THEN 1 + {WORDS.replace('text', 'answer', 1)} ELSE 0 END AS s FROM p JOIN h USING (conv_id)),
k AS (SELECT *, 1 + CASE WHEN opened THEN h + 1 ELSE 0 END + n <= ROOM AS fits FROM n),
l0 AS (SELECT conv_id, CAST(2 + max(h) + coalesce(sum(n) FILTER (fits), 0) AS BIGINT) AS total, CAST(coalesce(sum(s) FILTER (fits), 0) AS BIGINT) AS supervised, count(*) FILTER (NOT fits) AS skipped FROM k GROUP BY conv_id),
l AS (SELECT *, total > ROOM AS overflow, total <= ROOM AND supervised > 0 AS emitted FROM l0)"""


@query(LENGTHS_SQL.replace("ROOM", "128") + " SELECT conv_id, total, supervised, skipped, overflow, emitted FROM l")
def encode_turns_lengths(d):
    return chat.pair_lengths(d.conversations, 128)


@query(LENGTHS_SQL.replace("ROOM", "128") + " SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (overflow) AS BIGINT) AS overflowed, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(count(*) FILTER (NOT emitted) AS BIGINT) AS dropped FROM l")
def conversation_overflow_drop(d):
    got = chat.pair_lengths(d.conversations, 128)
    return got.agg(F.count("*").alias("n"), F.count(F.when(F.col("overflow"), 1)).alias("overflowed"), F.sum("skipped").alias("skipped"), F.count(F.when(~F.col("emitted"), 1)).alias("dropped"))


@query(LENGTHS_SQL.replace("ROOM", "512") + " SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (NOT emitted) AS BIGINT) AS dropped, round(sum(supervised) FILTER (emitted) / sum(total) FILTER (emitted), 6) AS supervised_ratio FROM l")
def supervised_ratio(d):
    got = chat.pair_lengths(d.conversations, 512)
    fits = F.when(F.col("emitted"), 1)
    return got.agg(F.count("*").alias("n"), F.count(F.when(~F.col("emitted"), 1)).alias("dropped"), r6(F.sum(fits * F.col("supervised")) / F.sum(fits * F.col("total"))).alias("supervised_ratio"))


@query()
def pack_chat_bestfit(d):
    got = chat.pair_lengths(d.conversations, SEQ).where("emitted").select("conv_id", (F.col("conv_id") % 4).alias("task"), "total")
    return packing.chat_best_fit(got, ["task"], "conv_id", "total", SEQ)


# Orders, epochs, holdouts


@query("SELECT * FROM (SELECT 0 AS instance, 'en' AS task, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 1, 'fr', doc_id FROM documents WHERE lang = 'fr' UNION ALL SELECT 2, 'en', doc_id FROM documents WHERE lang = 'en')")
def task_union_epochs(d):
    docs = d.documents.select("doc_id", "lang")
    one = lambda x: docs.where(F.col("lang") == x).select("doc_id")
    return mix.instances([("en", one("en"), None), ("fr", one("fr"), None), ("en", one("en"), None)], "doc_id")


@query("SELECT doc_id, lang, k FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE length(text) >= 500) WHERE k <= 10")
def take_first_n(d):
    kept = d.documents.where(F.char_length("text") >= 500).select("doc_id", "lang")
    return mix.first_of_each(kept, "lang", "doc_id", 10).withColumn("k", F.col("k").cast("long"))


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS k FROM documents) WHERE k > 100 AND length(text) BETWEEN 20 AND 400 ORDER BY doc_id LIMIT 50")
def holdout_prompts(d):
    later = mix.after(d.documents.select("doc_id", "text"), "doc_id", 100)
    return later.where(F.char_length("text").between(20, 400)).orderBy("doc_id").limit(50)


@query("SELECT doc_id, md5('42-' || doc_id) AS place FROM documents")
def seeded_shuffle(d):
    return d.documents.select("doc_id", mix.seeded_key(42, "doc_id").alias("place")).orderBy("place", "doc_id")


EPOCH = mix.epoch_seed(42, 1)


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('{EPOCH}-' || doc_id), doc_id) AS k FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS b FROM documents) WHERE b > 20) WHERE k > 50")
def epoch_order_resume(d):
    return mix.resumed(d.documents.select("doc_id"), 42, 1, 50, "doc_id", 20)


@query("SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 20")
def tail_validation(d):
    docs = d.documents.select("doc_id")
    return docs.where(mix.tail(F.col("doc_id"), docs, "doc_id", 20))


@query("SELECT item_id FROM benchmark ORDER BY md5('7-' || item_id), item_id LIMIT 5")
def fewshot_pick(d):
    return d.benchmark.select("item_id").orderBy(mix.seeded_key(7, "item_id"), "item_id").limit(5)


# Bitext and multiple choice

PAIR_SQL = """WITH p AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(lead(text) OVER (PARTITION BY source ORDER BY doc_id), '^\\s+|\\s+$', '', 'g') AS b, source FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM p WHERE a <> '' AND b <> '' AND length(a) <= 1000 AND length(b) <= 1000)"""


@query(PAIR_SQL + " SELECT source, i // 14 AS grp, CAST(count(*) AS BIGINT) AS pairs, string_agg(a || chr(9) || b, chr(10) ORDER BY doc_id) AS text FROM k GROUP BY source, i // 14")
def bitext_group14(d):
    from quern.sources.readers import pair_filter

    # places of ids alone, from ranges: no source is one task's work, and texts move only to meet
    places = storage.stage(d.spark, mix.placed(d.documents.select("doc_id", "source"), ["source"], ["doc_id"]), "places")
    later = places.select(F.col("source").alias("s"), (F.col("at") - 1).alias("before"), F.col("doc_id").alias("next_id"))
    beside = places.join(later, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("before"))).select("doc_id", "source", "next_id")
    texts = d.documents.select("doc_id", F.col("text").alias("en"))
    pairs = beside.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("next_id"), F.col("en").alias("zh")), "next_id")
    pairs = storage.stage(d.spark, pair_filter(pairs), "pairs")
    group = mix.placed(pairs.select("doc_id", "source"), ["source"], ["doc_id"]).select("doc_id", F.floor(F.col("at") / 14).cast("long").alias("grp"))
    got = pairs.join(group, "doc_id").groupBy("source", "grp").agg(F.count("*").alias("pairs"), F.array_sort(F.collect_list(F.struct("doc_id", "en", "zh"))).alias("x"))
    return got.select("source", "grp", "pairs", F.array_join(F.transform("x", lambda p: F.concat_ws("\t", p["en"], p["zh"])), "\n").alias("text"))


def four_choices():
    return F.array(*[F.concat(F.lit(f"c{i} "), F.col("item_id").cast("string")) for i in range(4)])


@query("SELECT item_id, 'Multiple Choice question: ' || text || chr(10) || '- c0 ' || item_id || '=A' || chr(10) || '- c1 ' || item_id || '=B' || chr(10) || '- c2 ' || item_id || '=C' || chr(10) || '- c3 ' || item_id || '=D' || chr(10) || chr(10) || 'Respond only with the letter of the correct answer.' AS prompt FROM benchmark")
def mc_render_a(d):
    return d.benchmark.select("item_id", t.render_choices_after(F.col("text"), four_choices()).alias("prompt"))


@query("SELECT item_id, text || chr(10) || 'A. c0 ' || item_id || chr(10) || 'B. c1 ' || item_id || chr(10) || 'C. c2 ' || item_id || chr(10) || 'D. c3 ' || item_id AS prompt, chr(CAST(65 + item_id % 4 AS INTEGER)) AS answer FROM benchmark")
def mc_render_b(d):
    return d.benchmark.select("item_id", t.render_choices_before(F.col("text"), four_choices()).alias("prompt"), t.answer_letter(F.col("item_id") % 4).alias("answer"))


# Metrics


@query("""SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(ends_with(text, '.') AS INT)), 6) AS share,
round(sqrt(avg(CAST(ends_with(text, '.') AS INT)) * (1 - avg(CAST(ends_with(text, '.') AS INT))) / count(*)), 6) AS se FROM documents GROUP BY ROLLUP (lang)""")
def stop_rate_by_lang(d):
    got = metrics.proportion(d.documents, "lang", F.endswith("text", F.lit(".")))
    return got.select(F.coalesce("lang", F.lit("all")).alias("lang"), "n", r6(F.col("share")).alias("share"), r6(F.col("se")).alias("se"))


@query("SELECT least(length(text) // 1000, 10) AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(median(length(text)) AS DOUBLE) AS mid FROM documents GROUP BY 1")
def length_buckets(d):
    return d.documents.groupBy(F.least(F.floor(F.char_length("text") / 1000), F.lit(10)).alias("bucket")).agg(F.count("*").alias("n"), F.median(F.char_length("text")).alias("mid"))


@query("SELECT source FROM documents GROUP BY source HAVING median(length(text)) >= 1400")
def kind_median_filter(d):
    return d.documents.groupBy("source").agg(F.median(F.char_length("text")).alias("m")).where("m >= 1400").select("source")


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, round(avg(CAST((length(text) < 3000) = (quality = 1) AS INT)), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def mc_accuracy(d):
    right = (F.char_length("text") < 3000) == (F.col("quality") == 1)
    return d.documents.join(d.labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg(right.cast("int"))).alias("accuracy"))


@query("SELECT event_type, round(exp(sum(value) / greatest(sum(n), 1)), 6) AS ppl FROM (SELECT event_type, value, 40 + user_id % 7 AS n FROM events) GROUP BY event_type")
def ppl_from_loss(d):
    rows = d.events.select("event_type", "value", (40 + F.col("user_id") % 7).alias("n"))
    return rows.groupBy("event_type").agg(r6(metrics.perplexity(F.col("value"), F.col("n"))).alias("ppl"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS ll, list_aggregate(list_transform(embedding, lambda x: x > -0.3), 'bool_and') AS greedy FROM embeddings""")
def loglikelihood_greedy(d):
    part = F.transform("embedding", lambda x: x.cast("double"))
    top = F.transform("embedding", lambda x: (x > F.lit(-0.3)).cast("int"))
    total, greedy = metrics.log_likelihood(part, top, F.transform(part, lambda x: F.lit(1)))
    return d.embeddings.select("vec_id", F.round(total, 5).alias("ll"), greedy.alias("greedy"))


NORM = "least(value / 1000.0, 0.05)"


@query(f"""WITH e AS (SELECT event_type, event_id, value / sum(value) OVER (PARTITION BY event_type) AS p FROM events WHERE value > 0),
w AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY event_type ORDER BY p DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT event_type, CAST(count(*) AS BIGINT) AS kept FROM w WHERE before < 0.5 GROUP BY event_type""")
def nucleus_keep(d):
    rows = d.events.where("value > 0").select("event_type", "event_id", "value")
    return metrics.nucleus(rows, "event_type", "value", "event_id", 0.5).groupBy("event_type").agg(F.count("*").alias("kept"))


BLEU_SQL = r"""WITH w AS (SELECT conv_id * 1000 + turn AS key, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS r FROM conversations WHERE role = 'user'),
p AS (SELECT key, r, r[2:] AS h FROM w),
hg AS (SELECT key, n, array_to_string(h[i:i + n - 1], ' ') AS g FROM (SELECT key, h, n, unnest(range(1, greatest(len(h) - n + 2, 1))) AS i FROM p, (VALUES (1), (2), (3), (4)) AS o(n)) WHERE i + n - 1 <= len(h)),
rg AS (SELECT key, n, array_to_string(r[i:i + n - 1], ' ') AS g FROM (SELECT key, r, n, unnest(range(1, greatest(len(r) - n + 2, 1))) AS i FROM p, (VALUES (1), (2), (3), (4)) AS o(n)) WHERE i + n - 1 <= len(r)),
hc AS (SELECT key, n, g, count(*) AS c FROM hg GROUP BY ALL), rc AS (SELECT key, n, g, count(*) AS c FROM rg GROUP BY ALL),
m AS (SELECT hc.n, sum(least(hc.c, coalesce(rc.c, 0))) AS m, sum(hc.c) AS t FROM hc LEFT JOIN rc ON hc.key = rc.key AND hc.n = rc.n AND hc.g = rc.g GROUP BY hc.n),
z AS (SELECT sum(len(h)) AS hl, sum(len(r)) AS rl FROM p)
SELECT round(100 * CASE WHEN hl >= rl THEN 1 ELSE exp(1 - rl / greatest(hl, 1)) END * exp((SELECT avg(ln(m / t)) FROM m)), 6) AS bleu, CAST(hl AS BIGINT) AS hyp_len, CAST(rl AS BIGINT) AS ref_len FROM z"""


@query(BLEU_SQL)
def corpus_bleu(d):
    rows = d.conversations.where("role = 'user'").select(t.words(F.col("text")).alias("ref"))
    got = metrics.bleu(rows.withColumn("hyp", F.slice("ref", F.lit(2), F.greatest(F.size("ref"), F.lit(1)))), "hyp", "ref")
    return got.withColumn("bleu", r6(F.col("bleu")))


MARKS_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([\{{-~\[-` -&\(-+:-@/])', ' \1 ', 'g'), '([^0-9])([.,])', '\1 \2 ', 'g'), '([.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g')"""
UNMARKED_SQL = "' ' || replace(replace(replace(replace(replace(replace(replace({0}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' '"
SCORED_SQL = r"""WITH s AS (SELECT conv_id * 1000 + turn AS key, {ref} AS ref, {hyp} AS hyp FROM conversations WHERE role = 'user'),
p AS (SELECT key, regexp_extract_all({ref_words}, '[^\x20\x09-\x0D]+') AS r, regexp_extract_all({hyp_words}, '[^\x20\x09-\x0D]+') AS h FROM s),"""


def scored_sql(ref: str, hyp: str, words) -> str:
    """The scoring SQL with its words made by a tokenisation."""
    return SCORED_SQL.format(ref=ref, hyp=hyp, ref_words=words("ref"), hyp_words=words("hyp")) + BLEU_SQL.partition("FROM w),")[2]


#: Sentences with marks, numbers and entities on the one side, and the same without some of their letters on the other.
TO_EN = "replace(coalesce(text, ''), ' the ', ' \"the\", &amp; 3.5-4, ')"


@query(scored_sql(TO_EN, f"replace({TO_EN}, ' a', ' e')", lambda c: MARKS_SQL.format(UNMARKED_SQL.format(c))))
def corpus_bleu_13a(d):
    ref = F.replace(F.coalesce("text", F.lit("")), F.lit(" the "), F.lit(' "the", &amp; 3.5-4, '))
    rows = d.conversations.where("role = 'user'").select(ref.alias("ref"), F.replace(ref, F.lit(" a"), F.lit(" e")).alias("hyp"))
    got = metrics.bleu(rows.select(*[metrics.words_13a(F.col(c)).alias(c) for c in ("ref", "hyp")]), "hyp", "ref")
    return got.withColumn("bleu", r6(F.col("bleu")))


#: The same texts with some letters written as Chinese characters and marks.
TO_ZH = ("aeiou", "的一，—〇")


@query(scored_sql(f"translate(coalesce(text, ''), '{TO_ZH[0]}', '{TO_ZH[1]}')", f"translate(coalesce(text, ''), '{TO_ZH[0]}', '{TO_ZH[1][1:] + TO_ZH[1][-1]}')",
    lambda c: MARKS_SQL.format(f"regexp_replace({c}, '([" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in metrics.CHINESE) + "])', ' \\1 ', 'g')")))
def corpus_bleu_zh(d):
    text = F.coalesce("text", F.lit(""))
    rows = d.conversations.where("role = 'user'").select(F.translate(text, *TO_ZH).alias("ref"), F.translate(text, TO_ZH[0], TO_ZH[1][1:] + TO_ZH[1][-1]).alias("hyp"))
    got = metrics.bleu(rows.select(*[metrics.words_zh(F.col(c)).alias(c) for c in ("ref", "hyp")]), "hyp", "ref")
    return got.withColumn("bleu", r6(F.col("bleu")))


@query("SELECT b.item_id, string_agg(e.text, chr(10) ORDER BY e.item_id) || chr(10) || b.text AS prompt FROM benchmark b, (SELECT * FROM benchmark ORDER BY item_id LIMIT 3) e GROUP BY b.item_id, b.text")
def fewshot_prompt(d):
    shots = d.benchmark.orderBy("item_id").limit(3).agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("s"))
    shots = shots.select(F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("shots"))
    return d.benchmark.crossJoin(F.broadcast(shots)).select("item_id", F.concat_ws("\n", "shots", "text").alias("prompt"))


@query("""WITH RECURSIVE s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
e AS (SELECT event_type, k, value AS ema FROM s WHERE k = 1 UNION ALL SELECT s.event_type, s.k, 0.9 * e.ema + (1 - 0.9) * s.value FROM e JOIN s ON s.event_type = e.event_type AND s.k = e.k + 1)
SELECT event_type, round(arg_max(ema, k), 6) AS ema FROM e GROUP BY event_type""")
def loss_ema(d):
    return metrics.ema(d.events.select("event_type", "event_id", "value"), "event_type", "event_id", "value").select("event_type", r6(F.col("ema")).alias("ema"))


@query("SELECT event_id, best, value = best AND coalesce(best < before, true) AS new_low FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)")
def best_so_far(d):
    by = "over (partition by user_id order by event_id rows between unbounded preceding and %s)"
    got = d.events.select("event_id", "value", F.expr("min(value) " + by % "current row").alias("best"), F.expr("min(value) " + by % "1 preceding").alias("before"))
    return got.select("event_id", "best", ((F.col("value") == F.col("best")) & F.coalesce(F.col("best") < F.col("before"), F.lit(True))).alias("new_low"))


@query("SELECT o_orderkey AS step FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 3) OR o_orderkey % 500 = 0")
def checkpoint_retention(d):
    return metrics.retained(d.orders.select(F.col("o_orderkey").alias("step")), 3, 500)


RATE = """CASE WHEN step < 50 THEN step / 50 ELSE {} END"""
SHARE = "least(1.0, (step - 50) / 950)"


@query(f"""SELECT step, round({RATE.format(f"0.1 + 0.9 * 0.5 * (1 + cos(3.141592653589793 * {SHARE}))")}, 6) AS cosine, round({RATE.format(f"greatest(0.1, 1 - {SHARE} * 0.9)")}, 6) AS linear,
round({RATE.format("CASE WHEN step < 900 THEN 1 ELSE 0.1 + 0.9 * (1 - least(1.0, (step - 900) / 100)) END")}, 6) AS wsd, round(0.85 + least(1.0, step / 300) * 0.1, 6) AS momentum FROM (SELECT o_orderkey AS step FROM orders)""")
def lr_schedule(d):
    rate = lambda shape: r6(metrics.learning_rate(F.col("id"), 50, 1000, 0.1, shape)).alias(shape)
    return d.orders.select(F.col("o_orderkey").alias("id")).select(F.col("id").alias("step"), rate("cosine"), rate("linear"), rate("wsd"), r6(metrics.momentum(F.col("id"), 300, 0.85, 0.95)).alias("momentum"))


# Reports


@query(f"""WITH a AS (SELECT source, CAST(sum({WORDS}) AS BIGINT) AS actual FROM documents GROUP BY source), p AS (SELECT source, CAST(weight * 20000 AS BIGINT) AS planned FROM {MIX_SQL})
SELECT source, planned, coalesce(actual, 0) AS actual, round(coalesce(actual, 0) / greatest(planned, 1), 6) AS done, coalesce(actual, 0) / greatest(planned, 1) < 0.9 AS short FROM p LEFT JOIN a USING (source)""")
def source_completion(d):
    actual = d.documents.groupBy("source").agg(F.sum(t.n_tokens(F.col("text"))).alias("actual"))
    planned = recipe(d).select("source", F.round(F.col("weight") * 20000).cast("long").alias("planned"))
    return reports.completion(actual, planned).select("source", "planned", "actual", r6(F.col("done")).alias("done"), "short")


@query(f"""WITH g AS (SELECT lang, count(*) AS p, sum({WORDS}) AS a FROM documents GROUP BY lang), s AS (SELECT sum(p) AS tp, sum(a) AS ta FROM g)
SELECT lang, round(p / tp, 6) AS planned_share, round(a / ta, 6) AS actual_share, round(a / ta - p / tp, 6) AS deviation FROM g, s""")
def lang_share_deviation(d):
    rows = d.documents.groupBy("lang").agg(F.count("*").alias("planned"), F.sum(t.n_tokens(F.col("text"))).alias("actual"))
    return reports.shares(rows, "lang").select("lang", *[r6(F.col(c)).alias(c) for c in ("planned_share", "actual_share", "deviation")])


@query("""WITH e AS (SELECT doc_id AS file, sha256(text) AS sha FROM documents), r AS (SELECT doc_id AS file, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS sha FROM documents WHERE doc_id % 3 > 0)
SELECT file, CASE WHEN r.sha IS NULL THEN 'skip' WHEN r.sha = e.sha THEN 'ok' ELSE 'mismatch' END AS remote FROM e LEFT JOIN r USING (file)""")
def sha_three_way(d):
    want = d.documents.select(F.col("doc_id").alias("file"), F.sha2("text", 256).alias("sha"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    have = d.documents.where("doc_id % 3 > 0").select(F.col("doc_id").alias("file"), F.sha2(changed, 256).alias("sha"))
    return reports.hash_verdicts(want, ("remote", have)).select("file", "remote")


@query("SELECT doc_id, 'missing' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def reconcile_keys(d):
    return reports.reconcile(d.documents.select("doc_id"), d.labels.select("doc_id"), "doc_id")


@query("PIVOT (SELECT source, lang, doc_id FROM documents) ON lang IN ('de', 'en', 'es', 'fr') USING CAST(count(doc_id) AS BIGINT) GROUP BY source")
def result_pivot(d):
    return d.documents.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count("doc_id")).fillna(0)


@query("SELECT source, arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def first_file_wins(d):
    rows = d.documents.select("source", F.struct("doc_id", "lang").alias("x"), "doc_id")
    return reports.preferred(rows, "source", "doc_id", "x").select("source", "x.doc_id", "x.lang")


# Generators


@query("SELECT doc_id, CAST(('0x' || substring(md5('3-' || doc_id), 1, 7))::BIGINT / 268435456.0 AS DOUBLE) < 0.3 AS chosen FROM documents")
def seeded_choice(d):
    return d.documents.select("doc_id", (t.uniform(3, F.col("doc_id")) < 0.3).alias("chosen"))


@query("SELECT DISTINCT w AS word, array_to_string(string_split(w, ''), ',') AS spelled, CAST(length(w) - length(replace(w, 'e', '')) AS BIGINT) AS hits FROM (SELECT lower(unnest(string_split(text, ' '))) AS w FROM benchmark) WHERE regexp_matches(w, '^[a-z]+$')")
def spelling_rows(d):
    got = d.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where(F.col("word").rlike("^[a-z]+$")).distinct()
    return got.select("word", generate.spelled(F.col("word")).alias("spelled"), generate.letter_count(F.col("word"), F.lit("e")).alias("hits"))


@query("SELECT DISTINCT w AS word, array_to_string(list_transform(range(1, length(w) + 1), lambda i: w[i] || ':' || (length(w[1:i]) - length(replace(w[1:i], 'e', '')))), ' ') AS trace FROM (SELECT lower(unnest(string_split(text, ' '))) AS w FROM benchmark) WHERE regexp_matches(w, '^[a-z]+$')")
def spelling_bee(d):
    got = d.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where(F.col("word").rlike("^[a-z]+$")).distinct()
    return got.select("word", generate.running_hits(F.col("word"), F.lit("e")).alias("trace"))


# Vectors


@query("SELECT label, p AS place, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM embeddings) GROUP BY label, p")
def piece_embedding_mean(d):
    got = d.embeddings.select("label", F.posexplode("embedding").alias("place", "v"))
    return got.groupBy("label", F.col("place").cast("long").alias("place")).agg(r6(F.avg(F.col("v").cast("double"))).alias("mean"))


@query("""SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i])) /
sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(d):
    one = d.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    two = d.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return one.join(two, "vec_id").select("vec_id", F.round(dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b")), 5).alias("cosine"))


from quern.plans import evaluation, files, scale, training, vocabularies  # noqa: E402, F401 - they register their queries
