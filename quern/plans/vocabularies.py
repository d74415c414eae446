"""Queries over subword vocabularies and conversations cut into segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chat, evaluate, metrics, subwords
from quern.plans.queries import WORDS, query, r6
from quern.plans.training import ENCODED_SQL, LIST_WORDS, TOK, word_list

#: A byte-level vocabulary of the installed package; None if it isn't there.
BPE_FILE = "byte_bpe_50k.json"


def bpe(d, path: str | None = None):
    if path is None:
        import public_tokenizers

        path = "file://" + str(public_tokenizers.path(BPE_FILE))
    return subwords.BytePairs.load(d.spark, path)


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes, strlen(coalesce(text, '')) >= 1 AS has_ids FROM documents")
def subword_round_trip(d):
    """Every document to ids of a byte-level BPE vocabulary and back."""
    vocabulary = bpe(d)
    docs = d.documents.select("doc_id", "text")
    back = vocabulary.decode(vocabulary.encode(docs, "doc_id", F.coalesce("text", F.lit("")))).select("doc_id", "ids", "decoded")
    return back.select("doc_id", F.md5("decoded").alias("digest"), F.octet_length("decoded").cast("long").alias("bytes"), (F.size("ids") > 0).alias("has_ids"))


@query()
def subword_fertility(d):
    """Tokens of that vocabulary a word and a character, by language."""
    coded = bpe(d).encode(d.documents.select("doc_id", "lang", "text"), "doc_id", F.coalesce("text", F.lit("")))
    words = F.regexp_count("text", F.lit("[^ \\t-\\r]+"))
    got = coded.groupBy("lang").agg(F.sum(F.size("ids")).alias("tokens"), r6(F.sum(F.size("ids")) / F.greatest(F.sum(words), F.lit(1))).alias("per_word"), r6(metrics.tokens_per_char(F.size("ids"), F.col("text"))).alias("per_char"))
    return got.select("lang", "tokens", "per_word", "per_char")


# An old vocabulary: the beginnings of the benchmark's words, of one to three letters, numbered in order, as far as there are vectors.
OLD_SQL = f"""WITH RECURSIVE w AS MATERIALIZED ({LIST_WORDS}),
o AS MATERIALIZED (SELECT p AS piece, row_number() OVER (ORDER BY p) - 1 AS id FROM (SELECT DISTINCT substr(word, 1, unnest([1, 2, 3])) AS p FROM w)),
v AS MATERIALIZED (SELECT o.piece, o.id, e.embedding FROM o JOIN embeddings e ON e.vec_id = o.id),
s AS (SELECT word, 1 AS here, CAST([] AS BIGINT[]) AS ids, false AS bad FROM w UNION ALL
  SELECT word, here + coalesce(len3, len2, len1, 1), CASE WHEN coalesce(len3, len2, len1) IS NULL THEN [] ELSE ids || [coalesce(id3, id2, id1)] END, bad OR coalesce(len3, len2, len1) IS NULL FROM (
    SELECT s.*, CASE WHEN c.id IS NOT NULL AND length(substr(word, here, 3)) = 3 THEN 3 END AS len3, CASE WHEN b.id IS NOT NULL AND length(substr(word, here, 2)) = 2 THEN 2 END AS len2, CASE WHEN a.id IS NOT NULL THEN 1 END AS len1,
      CASE WHEN length(substr(word, here, 3)) = 3 THEN c.id END AS id3, CASE WHEN length(substr(word, here, 2)) = 2 THEN b.id END AS id2, a.id AS id1
    FROM s LEFT JOIN v a ON a.piece = substr(word, here, 1) LEFT JOIN v b ON b.piece = substr(word, here, 2) LEFT JOIN v c ON c.piece = substr(word, here, 3) WHERE here <= length(word) AND NOT bad)),
f AS MATERIALIZED (SELECT word, CASE WHEN bad THEN [] ELSE ids END AS ids FROM s WHERE here > length(word) OR bad),
k AS MATERIALIZED (SELECT word, ids, CASE len(ids) WHEN 0 THEN 'fallback' WHEN 1 THEN 'one' ELSE 'several' END AS kind FROM f)"""


def mapping(d):
    words = word_list(d)
    starts = words.select(F.explode(F.array(*[F.substring("word", 1, k) for k in (1, 2, 3)])).alias("piece")).distinct()
    # a vocabulary numbered in order is a sorted list of some hundred entries
    old = starts.select("piece", (F.expr("row_number() over (order by piece)") - 1).cast("int").alias("id"))
    vectors = d.embeddings.select(F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("vector"))
    old = old.join(vectors, "id")
    known = subwords.Longest.load(old, "piece", "id")
    return subwords.mapped(words.select(F.col("word").alias("id"), F.col("word").alias("piece")), known, old.select("id", "vector"))


@query(OLD_SQL + """, a AS (SELECT pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM v) GROUP BY pos),
u AS (SELECT word, unnest(ids) AS id FROM k), m AS (SELECT word, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT word, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM u JOIN v USING (id)) GROUP BY ALL)
SELECT k.word, k.kind, CAST(len(ids) AS INT) AS n_ids, a.pos AS place, round(coalesce(m.m, a.m), 6) AS mean FROM k CROSS JOIN a LEFT JOIN m ON m.word = k.word AND m.pos = a.pos""")
def vocabulary_mapping(d):
    got = mapping(d).select(F.col("id").alias("word"), "kind", F.size("ids").alias("n_ids"), F.posexplode("vector").alias("place", "mean"))
    return got.select("word", "kind", "n_ids", F.col("place").cast("long").alias("place"), r6(F.col("mean")).alias("mean"))


@query(OLD_SQL + " SELECT kind, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY kind")
def map_class_counts(d):
    return evaluate.class_counts(mapping(d), "ids")


# Conversations cut between their pairs

ROOM = 1200
SPLIT_SQL = ENCODED_SQL.partition("e0 AS")[0].replace("WITH w AS", "WITH RECURSIVE w AS").replace("ROOM", str(ROOM)) + f"""
h AS (SELECT *, [1] || coalesce(s, []) || [3] AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM r),
g AS (SELECT conv_id, k, CAST(CASE WHEN len(head) + len(ids) > {ROOM} THEN 1 ELSE 0 END AS BIGINT) AS seg, CAST(len(head) + len(ids) AS BIGINT) AS used FROM h WHERE k = 1 UNION ALL
  SELECT h.conv_id, h.k, CASE WHEN g.used + len(h.ids) > {ROOM} THEN g.seg + 1 ELSE g.seg END, CASE WHEN g.used + len(h.ids) > {ROOM} THEN len(h.head) ELSE g.used END + len(h.ids) FROM g JOIN h ON h.conv_id = g.conv_id AND h.k = g.k + 1),
x AS (SELECT conv_id, seg, [1] || coalesce(any_value(s), []) || [3] AS head, flatten(list(ids ORDER BY turn)) AS ids, flatten(list(mask ORDER BY turn)) AS mask FROM h JOIN g USING (conv_id, k) GROUP BY conv_id, seg),
e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seg) - 1 AS segment, head || ids AS ids, list_transform(head, lambda i: 0) || mask AS mask FROM x WHERE list_contains(mask, 1))"""


@query(SPLIT_SQL + " SELECT conv_id, segment, md5(array_to_string(ids, ',')) AS ids, md5(array_to_string(mask, ',')) AS mask FROM e")
def encode_turns_split(d):
    got = chat.encoded_split(d.conversations, TOK, ROOM)
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return got.select("conv_id", "segment", digest("ids"), digest("mask"))


@query(SPLIT_SQL + """, n AS (SELECT conv_id, count(*) AS segments FROM e GROUP BY conv_id)
SELECT CAST(count(DISTINCT p.conv_id) AS BIGINT) AS convs, CAST((SELECT count(*) FROM n WHERE segments > 1) AS BIGINT) AS split, CAST((SELECT sum(segments) FROM n) AS BIGINT) AS segments,
CAST(count(DISTINCT p.conv_id) - (SELECT count(*) FROM n) AS BIGINT) AS dropped, CAST(count(*) - (SELECT count(*) FROM r) AS BIGINT) AS pairs_dropped FROM p""")
def split_counts(d):
    return chat.split_counts(d.conversations, TOK, ROOM)
