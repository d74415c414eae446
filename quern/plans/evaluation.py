"""Queries over results, runs, logs and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import evaluate, metrics, mix, reports
from quern.plans.queries import WORDS, query, r6

SCORES = "[doc_id % 7, doc_id % 5, doc_id % 3, doc_id % 2]"


def scored(d):
    scores = F.array(*[(F.col("doc_id") % k).cast("double") for k in (7, 5, 3, 2)])
    letters = F.array(*map(F.lit, "ABCD"))
    free = F.get(F.array(*map(F.lit, "ABXY")), (F.col("doc_id") % 4).cast("int"))
    rows = d.documents.join(d.labels, "doc_id")
    return rows.select("doc_id", "lang", scores.alias("scores"), letters.alias("letters"), free.alias("free"), F.when(F.col("quality") == 1, "A").otherwise("B").alias("answer"))


PICK_SQL = f"""WITH s AS (SELECT doc_id, lang, {SCORES} AS s, ['A', 'B', 'X', 'Y'][doc_id % 4 + 1] AS free, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS answer FROM documents JOIN labels USING (doc_id)),
p AS (SELECT *, ['A', 'B', 'C', 'D'][list_position(s, list_max(s))] AS pick FROM s)"""


@query(PICK_SQL + " SELECT doc_id, pick FROM p")
def choice_argmax(d):
    return scored(d).select("doc_id", evaluate.picked(F.col("letters"), F.col("scores")).alias("pick"))


@query(PICK_SQL + " SELECT lang, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(pick = answer AS INT)), 6) AS accuracy, round(avg(CAST(free IN ('A', 'B', 'C', 'D') AS INT)), 6) AS follows FROM p GROUP BY lang")
def format_follow(d):
    got = evaluate.choices_scored(scored(d), ["lang"], "letters", "scores", "free", "answer")
    return got.select("lang", "n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("follows")).alias("follows"))


@query(f"""SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CAST(count(*) AS BIGINT) AS n, round(avg({WORDS}), 6) AS mean_length FROM documents GROUP BY ROLLUP (lang)""")
def mean_answer_length(d):
    got = metrics.proportion(d.documents, "lang", F.endswith("text", F.lit(".")), t.n_tokens(F.col("text")))
    return got.select(F.coalesce("lang", F.lit("all")).alias("lang"), "n", r6(F.col("mean_length")).alias("mean_length"))


@query(f"""SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(ends_with(text, '.') AS INT)) AS BIGINT) AS stopped,
CAST(sum(CAST(ends_with(text, '.') <> ({WORDS} < 300 OR doc_id % 3 = 0) AS INT)) AS BIGINT) AS disagree FROM documents GROUP BY lang""")
def stop_disagreement(d):
    return metrics.stop_check(d.documents, "lang", F.endswith("text", F.lit(".")), t.n_tokens(F.col("text")), 300, F.col("doc_id") % 3 == 0)


@query("SELECT doc_id, CASE WHEN o + n > 0 THEN o / (o + n) END AS share FROM (SELECT doc_id, len(regexp_extract_all(x, '[" + "".join(a for a, _ in t.SCRIPTS) + "]')) AS o, len(regexp_extract_all(x, '[" + "".join(b for _, b in t.SCRIPTS) + "]')) AS n FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || '這個国学' WHEN 1 THEN '說' || text ELSE text END AS x FROM documents))")
def script_ratio(d):
    x = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("這個国学"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("說"), "text")).otherwise(F.col("text"))
    return d.documents.select("doc_id", t.traditional_share(x).alias("share"))


def results(d):
    """Runs of six tasks in two places, made from the events."""
    names = ["piqa", "gsm8k", "arc_challenge", "other"]
    kinds = ["acc,none", "acc_norm,none", "exact_match,strict-match", "exact_match,flexible-extract"]
    pick = lambda options, by: F.get(F.array(*map(F.lit, options)), by.cast("int"))
    u = F.col("user_id")
    rows = d.events.select(F.concat(F.lit("run"), (u % 5).cast("string")).alias("tag"), (F.col("event_id") % 2).alias("place"), pick(names, u % 4).alias("task"), pick(kinds, F.floor(u / 4) % 4).alias("metric"), "value")
    return rows.groupBy("tag", "place", "task", "metric").agg(F.max("value").alias("value"))


RESULTS_SQL = """WITH r AS (SELECT 'run' || (user_id % 5) AS tag, event_id % 2 AS place, ['piqa', 'gsm8k', 'arc_challenge', 'other'][user_id % 4 + 1] AS task,
  ['acc,none', 'acc_norm,none', 'exact_match,strict-match', 'exact_match,flexible-extract'][(user_id // 4) % 4 + 1] AS metric, max(value) AS value FROM events GROUP BY ALL)"""


@query(RESULTS_SQL + """, k AS (SELECT tag, task, place, value, CASE task WHEN 'piqa' THEN nullif(list_position(['acc_norm,none', 'acc,none'], metric), 0) WHEN 'arc_challenge' THEN nullif(list_position(['acc_norm,none', 'acc,none'], metric), 0)
  WHEN 'gsm8k' THEN nullif(list_position(['exact_match,strict-match', 'exact_match,flexible-extract'], metric), 0) WHEN 'other' THEN CASE WHEN metric = 'acc,none' THEN 1 END END AS rank FROM r)
SELECT tag, task, arg_min(value, 10 * place + rank) FILTER (rank IS NOT NULL) AS value FROM k GROUP BY tag, task""")
def metric_fallback(d):
    return evaluate.preferred_metric(results(d))


@query(RESULTS_SQL + """, m AS (SELECT tag, task, map_from_entries(list((metric, value) ORDER BY metric)) AS m FROM r WHERE place = 0 GROUP BY tag, task)
SELECT tag, task, coalesce(m['acc,all'], list_filter(map_entries(m), lambda e: starts_with(e.key, 'acc'))[1].value) AS value, coalesce(m['acc,none'], m['acc_norm,none']) AS preferred FROM m""")
def metric_by_prefix(d):
    m = results(d).where("place = 0").groupBy("tag", "task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m"))
    return m.select("tag", "task", t.by_prefix(F.col("m"), "acc,all").alias("value"), t.prefer(F.col("m"), ["acc,none", "acc_norm,none"]).alias("preferred"))


@query(RESULTS_SQL + ", v AS (SELECT tag, task, max(value) AS value FROM r WHERE place = 1 AND task <> 'piqa' GROUP BY ALL) SELECT a.tag, b.task, v.value FROM (SELECT DISTINCT tag FROM r) a CROSS JOIN (SELECT DISTINCT task FROM r) b LEFT JOIN v ON v.tag = a.tag AND v.task = b.task")
def result_grid(d):
    r = results(d)
    best = r.where("place = 1 and task <> 'piqa'").groupBy("tag", "task").agg(F.max("value").alias("value"))
    return reports.grid(r.select("tag").distinct(), r.select("task").distinct(), best)


FILES = "SELECT 'run' || (user_id % 5) AS tag, 'run' || (user_id % 5) || CASE user_id % 3 WHEN 0 THEN '_vllm_1000_comet.json' WHEN 1 THEN '_' || (event_id % 50) || 'comet.json' ELSE '.json' END AS path FROM events WHERE user_id % 5 > 1 OR user_id % 3 = 2"


@query(f"WITH f AS ({FILES}), k AS (SELECT tag, path, CASE WHEN regexp_matches(path, '^' || tag || '_vllm_1000_comet\\.json$') THEN 0 WHEN regexp_matches(path, '^' || tag || '_.*comet\\.json$') THEN 1 WHEN regexp_matches(path, '^' || tag || '\\.json$') THEN 2 END AS r FROM f) SELECT tag, max(path) AS path FROM (SELECT *, min(r) OVER (PARTITION BY tag) AS best FROM k) WHERE r = best GROUP BY tag")
def translation_file(d):
    tag = F.concat(F.lit("run"), (F.col("user_id") % 5).cast("string"))
    name = F.when(F.col("user_id") % 3 == 0, "_vllm_1000_comet.json").when(F.col("user_id") % 3 == 1, F.concat(F.lit("_"), (F.col("event_id") % 50).cast("string"), F.lit("comet.json"))).otherwise(".json")
    files = d.events.where("user_id % 5 > 1 or user_id % 3 = 2").select(tag.alias("tag"), F.concat(tag, name).alias("path"))
    return evaluate.newest_match(files, [r"^{tag}_vllm_1000_comet\.json$", r"^{tag}_.*comet\.json$", r"^{tag}\.json$"])


@query("SELECT CAST(max(o_orderkey) AS BIGINT) AS step FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def latest_resumable(d):
    steps = d.orders.select(evaluate.checkpoint_step(F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string"))).alias("step"))
    return mix.latest(steps, d.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("step")))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS runs, round(max(value) - min(value), 6) AS range, round(stddev(value), 6) AS sd FROM events GROUP BY event_type")
def run_spread(d):
    return metrics.spread(d.events, "event_type", "value").select("event_type", "runs", r6(F.col("range")).alias("range"), r6(F.col("sd")).alias("sd"))


@query("SELECT event_type, units, round(us / 1e6, 3) AS seconds, round(units / (us / 1e6), 6) AS rate FROM (SELECT event_type, CAST(count(*) AS BIGINT) AS units, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY event_type)")
def step_throughput(d):
    got = metrics.throughput(d.events, "event_type", "ts", F.lit(1))
    return got.select("event_type", "units", F.round("seconds", 3).alias("seconds"), r6(F.col("rate")).alias("rate"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM (SELECT * FROM events ORDER BY event_id LIMIT 640) GROUP BY event_type")
def capped_evaluation(d):
    got = metrics.first_batches(d.events.select("event_id", "event_type", "value"), "event_id", 64, 10)
    return got.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("SELECT event_id AS step, CAST(10000 AS BIGINT) AS total, round(CAST(user_id AS DOUBLE) / 7, 3) AS loss, round(CAST(100 * event_id AS DOUBLE) / 10000, 1) AS percent, round((10000 - event_id) * CAST(12.66 AS DOUBLE) / 86400, 1) AS days_left FROM events")
def log_progress(d):
    form = "step %d/10000 | loss %.3f | lr 0.1"
    lines = d.events.select(F.format_string(form, "event_id", F.round(F.col("user_id") / 7.0, 3)).alias("value"))
    return evaluate.log_steps(lines, 12.66)


@query("""SELECT doc_id, 0 AS ord, source AS task, CAST(doc_id % 7 AS INT) AS shots FROM documents UNION ALL SELECT doc_id, 1, lang, NULL FROM documents UNION ALL SELECT doc_id, 2, 'n', CAST(n_chars AS INT) FROM documents""")
def task_specs(d):
    """Run specifications written as lists, a list a document."""
    lists = d.documents.select("doc_id", F.format_string("%s:%d, %s,n:%d", "source", F.col("doc_id") % 7, "lang", "n_chars").alias("x"))
    return evaluate.specs_of(lists, "x", ("doc_id",))


@query(r"SELECT page_id AS ord, substring(trim(url), 1, 100) AS value FROM pages WHERE contains(url, '/en/1') OR regexp_matches(url, '(^|[^A-Za-z0-9_])example([^A-Za-z0-9_]|$)')")
def path_leaks(d):
    lines = d.pages.select(F.lit("pages").alias("file"), F.col("page_id").alias("ord"), F.col("url").alias("value"))
    return evaluate.leaks(lines, ["/en/1"], ["example"]).select("ord", "value")


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'a' WHEN item_id % 2 = 0 THEN 'b' END AS first FROM benchmark")
def first_existing(d):
    present = F.array_compact(F.array(F.when(F.col("item_id") % 2 == 0, "b"), F.when(F.col("item_id") % 3 == 0, "a"), F.lit("z")))
    return d.benchmark.select("item_id", t.first_existing(present, ["a", "b", "c"]).alias("first"))


@query("SELECT vec_id, CASE WHEN label % 5 = 0 THEN NULL WHEN label % 5 = 1 THEN ' ' ELSE ' w' || label END AS text FROM embeddings")
def piece_texts(d):
    from quern.operators.tokens import piece_text

    piece = F.when(F.col("label") % 5 == 0, "<s>").when(F.col("label") % 5 == 1, "▁▁").otherwise(F.concat(F.lit("▁w"), F.col("label").cast("string")))
    return d.embeddings.select("vec_id", piece_text(piece, ["<unk>", "<s>", "</s>"]).alias("text"))


@query("""WITH e AS (SELECT doc_id AS file, sha256(text) AS sha FROM documents), r AS (SELECT doc_id AS file, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS sha FROM documents WHERE doc_id % 3 > 0),
l AS (SELECT doc_id AS file, sha256(text) AS sha FROM documents WHERE doc_id % 2 = 0)
SELECT file, CASE WHEN r.sha IS NULL THEN 'skip' WHEN r.sha = e.sha THEN 'ok' ELSE 'mismatch' END AS remote, CASE WHEN l.sha IS NULL THEN 'skip' WHEN l.sha = e.sha THEN 'ok' ELSE 'mismatch' END AS local FROM e LEFT JOIN r USING (file) LEFT JOIN l USING (file)""")
def sha_verdicts(d):
    want = d.documents.select(F.col("doc_id").alias("file"), F.sha2("text", 256).alias("sha"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    remote = d.documents.where("doc_id % 3 > 0").select(F.col("doc_id").alias("file"), F.sha2(changed, 256).alias("sha"))
    local = d.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("file"), F.sha2("text", 256).alias("sha"))
    return reports.hash_verdicts(want, ("remote", remote), ("local", local))[["file", "remote", "local"]]


@query("SELECT b.item_id, 'Translate Chinese to English.' || chr(10) || chr(10) || (SELECT string_agg('Chinese: ' || text || chr(10) || 'English: ' || upper(text) || chr(10) || chr(10), '' ORDER BY item_id) FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 2)) || 'Chinese: ' || b.text || chr(10) || 'English:' AS prompt FROM benchmark b")
def fewshot_translation(d):
    shots = d.benchmark.orderBy("item_id").limit(2).select(F.col("item_id").alias("ord"), F.col("text").alias("src"), F.upper("text").alias("ref"))
    return evaluate.fewshot("zh-en", shots, d.benchmark.select("item_id", F.col("text").alias("src")), "item_id")


@query(r"""WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, '. ', '. ' || chr(10) || 'English: ') WHEN 1 THEN replace(text, ', ', '  Chinese: ') ELSE text END AS x FROM documents),
c AS (SELECT doc_id, x, list_min(list_filter(list_transform([chr(10) || chr(10), chr(10) || ' English:', chr(10) || ' Chinese:', chr(10) || 'English:', chr(10) || 'Chinese:', '  English:', '  Chinese:'], lambda s: instr(x, s)), lambda i: i > 0)) AS cut FROM x)
SELECT doc_id, regexp_replace(CASE WHEN cut IS NULL THEN x ELSE substring(x, 1, cut - 1) END, '^\s+|\s+$', '', 'g') AS first FROM c""")
def trimmed_translation(d):
    x = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(". "), F.lit(". \nEnglish: "))).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit(", "), F.lit("  Chinese: "))).otherwise(F.col("text"))
    return d.documents.select("doc_id", t.trimmed_continuation(x, "Chinese").alias("first"))


@query("""WITH p AS (SELECT * FROM (VALUES ('src0', 0.25), ('src1', 0.5), ('nowhere', 0.25)) AS v(source, weight)),
a AS (SELECT source, weight, coalesce(tokens, 0) AS tokens FROM p LEFT JOIN (SELECT source, sum(length(text)) AS tokens FROM documents GROUP BY source) USING (source))
SELECT 'demo' AS mix, CAST(1024 AS BIGINT) AS seq_length, CAST(5000 AS BIGINT) AS planned_total, CAST(sum(tokens) AS BIGINT) AS actual_total, CAST(max(tokens) FILTER (source = 'src1') AS BIGINT) AS src1, round(max(tokens) FILTER (source = 'src1') / greatest(sum(tokens), 1), 6) AS src1_share FROM a""")
def mix_manifest(d):
    planned = d.spark.createDataFrame([("src0", 0.25), ("src1", 0.5), ("nowhere", 0.25)], "source string, weight double")
    actual = d.documents.groupBy("source").agg(F.sum(F.char_length("text")).alias("tokens"))
    got = reports.matrix_manifest("demo", 1024, 5000, planned, actual)
    return got.select("mix", "seq_length", "planned_total", "actual_total", F.col("actual_tokens")["src1"].alias("src1"), r6(F.col("actual_weights")["src1"]).alias("src1_share"))
