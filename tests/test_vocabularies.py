"""Subword vocabularies, vocabulary mapping, split conversations and scoring at length, against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern import storage
from quern.operators import chat, evaluate, metrics, packing, subwords
from quern.operators.tokens import Bytes
from quern.plans.catalogue import QUERIES
from quern.sources import readers

TEXTS = ["Hello world, it's 12.5% naïve!", "  two  blanks\n\n\tand tabs ", "", None, "日本語 テキスト 한국어", "don't we'll I've", "a" * 3000, " " * 700 + "x", "é́ combining", "🙂🙂 emoji's", " wide blank", "x\r\ny", "١٢٣ ½ ²"]


@pytest.fixture(scope="module")
def vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_50k.json"))
    return subwords.BytePairs.load(spark, "file://" + path), path


def test_ids_equal_the_library(spark, sf, vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    ours, path = vocabulary
    theirs = tokenizers.Tokenizer.from_file(path)
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    coded = ours.encode(spark.createDataFrame(rows, "key long, text string"), "key", F.coalesce("text", F.lit("")))
    got = {r.key: r for r in ours.decode(coded).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        assert got[key].ids == theirs.encode(text or "", add_special_tokens=False).ids, text
        assert got[key].decoded == (text or "")


def test_merging_equals_the_plain_loop():
    rng = random.Random(1)
    for _ in range(300):
        pairs = [(a, b) for a in ("a", "b", "ab", "ba", "aa") for b in ("a", "b", "ab", "ba", "aa")]
        rng.shuffle(pairs)
        ranks = {p: i for i, p in enumerate(pairs[: rng.randint(0, 20)])}
        symbols = [rng.choice("ab") for _ in range(rng.randint(0, 14))]
        want = list(symbols)
        while found := [(ranks[p], i) for i, p in enumerate(zip(want, want[1:])) if p in ranks]:
            _, i = min(found)
            want[i : i + 2] = [want[i] + want[i + 1]]
        assert subwords.merged(symbols, ranks) == want
    began = time.time()
    subwords.merged(["a"] * 200_000, {("a", "a"): 0, ("aa", "aa"): 1})
    assert time.time() - began < 20


def test_short_merging_equals_the_heap(vocabulary):
    ours, _ = vocabulary
    rng = random.Random(7)
    real = subwords.Merger(ours.vocabulary, ours.ranks)
    for _ in range(2000):
        piece = "".join(rng.choice("aeinrst hoödé語🙂 '1\n") for _ in range(rng.randint(0, subwords.SHORT + 6)))
        assert real(piece) == real.long(piece), piece
    for _ in range(300):
        parts = ("a", "b", "ab", "ba", "aa", "aab")
        pairs = [(x, y) for x in parts for y in parts]
        rng.shuffle(pairs)
        ranks = {p: i for i, p in enumerate(pairs[: rng.randint(0, 36)])}
        names = {*parts, *(x + y for x, y in ranks)}
        some = subwords.Merger({x: i for i, x in enumerate(sorted(names))}, ranks)
        piece = "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
        assert some.short(piece) == some.long(piece), (piece, ranks)


def test_encoding_shuffles_and_writes_nothing(spark, vocabulary, monkeypatch):
    ours, path = vocabulary
    theirs = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    monkeypatch.setattr(storage, "stage", lambda *_: pytest.fail("a table is written"))
    texts = [*TEXTS, *TEXTS, "one word", None]  # equal texts, under repeated and null keys
    rows = spark.createDataFrame([(i % 3 or None, x) for i, x in enumerate(texts)], "key long, text string").coalesce(1)
    coded = ours.encode(rows, "key", F.col("text"))
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("Coalesce", "") and "Join" not in plan
    got = [(r.key, r.text, r.ids) for r in coded.collect()]
    assert got == [(i % 3 or None, x, theirs.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)]


def test_fertility_equals_the_library(spark, sf, vocabulary):
    theirs = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary[1])
    want: dict = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect():
        x = want.setdefault(r.lang, [0, 0, 0])
        x[0] += len(theirs.encode(r.text or "", add_special_tokens=False).ids)
        x[1] += len(re.findall(r"[^ \t-\r]+", r.text or ""))
        x[2] += len(r.text or "")
    got = {r.lang: (r.tokens, r.per_word, r.per_char) for r in QUERIES["subword_fertility"](spark, sf).collect()}
    assert got == {k: (n, pytest.approx(n / max(w, 1), abs=1e-6), pytest.approx(n / max(c, 1), abs=1e-6)) for k, (n, w, c) in want.items()}


def test_round_trip_reads_texts_once_and_shuffles_nothing(spark, sf, vocabulary):
    got = QUERIES["subword_round_trip"](spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1 and plan.count("regexp_extract_all") == 1
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {tuple(r) for r in got.collect()} == {(i, hashlib.md5(x).hexdigest(), len(x), len(x) > 0) for i, x in texts.items()}


def test_longest_and_mapping(spark):
    table = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "ab", [3.0, 4.0]), (2, "c", [5.0, 2.0]), (3, " ", [7.0, 2.0])], "id int, piece string, vector array<double>")
    old = subwords.Longest.load(table, "piece", "id")
    pieces = spark.createDataFrame([(0, "abc"), (1, "ab"), (2, "aab"), (3, "xyz"), (4, "▁"), (5, "▁▁c"), (6, "<s>"), (7, None), (8, "cc"), (9, "")], "id int, piece string")
    got = {r.id: (r.kind, r.ids, r.vector) for r in subwords.mapped(pieces, old, table, special=["<s>"]).collect()}
    assert got == {
        0: ("several", [1, 2], [4.0, 3.0]),
        1: ("one", [1], [3.0, 4.0]),
        2: ("several", [0, 1], [2.0, 2.0]),
        3: ("fallback", [], [4.0, 2.0]),
        4: ("one", [3], [7.0, 2.0]),
        5: ("several", [3, 3, 2], [19 / 3, 2.0]),
        8: ("several", [2, 2], [5.0, 2.0]),
        9: ("one", [3], [7.0, 2.0]),  # nothing but blanks is one blank
    }
    counts = {r.kind: r.n for r in evaluate.class_counts(subwords.mapped(pieces, old, table, special=["<s>"]), "ids").collect()}
    assert counts == {"several": 4, "one": 3, "fallback": 1}


def test_split_equals_the_plain_loop(spark):
    rng = random.Random(2)
    rows, want = [], {}
    tok = Bytes()
    for conv in range(120):
        turns = []
        for k in range(rng.randint(0, 20)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system"]) if k or rng.random() < 0.6 else "system"
            turns.append((role, "x" * rng.choice([0, 1, 3, 8, 20, 40])))
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
        got = chat.encode_turns(turns, tok.encode_text, tok.marks, 48, split=True)
        want |= {(conv, i): (ids, mask) for i, (ids, mask) in enumerate(got)}
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.segment): (r.ids, r.mask) for r in chat.encoded_split(table, tok, 48).collect()}
    assert got == want and max(k for _, k in want) >= 2
    counts = chat.split_counts(table, tok, 48).first()
    per = Counter(c for c, _ in want)
    users = {r[0] for r in rows if r[2] == "user"}
    assert (counts.convs, counts.split, counts.segments, counts.dropped) == (len(users), sum(k > 1 for k in per.values()), len(want), len(users - set(per)))


def plain_bleu(pairs):
    m, t, hl, rl = [0] * 4, [0] * 4, 0, 0
    for h, r in pairs:
        hl, rl = hl + len(h), rl + len(r)
        for n in range(1, 5):
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
            m[n - 1] += sum((a & b).values())
            t[n - 1] += sum(a.values())
    smooth, logs = 1.0, 0.0
    for k, n in zip(m, t, strict=True):
        if k == 0:
            smooth *= 2
        logs += math.log(k / n if k else 1 / (smooth * max(n, 1)))
    return 100 * (1 if hl >= rl else math.exp(1 - rl / max(hl, 1))) * math.exp(logs / 4)


def test_bleu_of_random_and_of_very_long_rows(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 30))], [rng.choice("abcd") for _ in range(rng.randint(0, 30))]) for _ in range(60)]
    got = metrics.bleu(spark.createDataFrame(pairs, "h array<string>, r array<string>"), "h", "r").first()
    assert got.bleu == pytest.approx(plain_bleu(pairs))
    nothing = spark.createDataFrame([(["a"], ["b"]), (None, ["c"])], "h array<string>, r array<string>")
    assert metrics.bleu(nothing, "h", "r").first().bleu == pytest.approx(plain_bleu([(["a"], ["b"]), ([], ["c"])]))
    long = [f"w{rng.randint(0, 5000)}" for _ in range(100_000)]
    other = [w if rng.random() < 0.8 else "x" for w in long]
    table = spark.createDataFrame([(long, other)], "h array<string>, r array<string>")
    began = time.time()
    got = metrics.bleu(table, "h", "r").first()
    assert time.time() - began < 60 and got.bleu == pytest.approx(plain_bleu([(long, other)]))


def test_tokenisations(spark):
    rows = spark.createDataFrame([('He said: "3.5% of 1,000-odd" &amp; left.<skipped>\nEnd-\nless 10-year',)], "x string")
    assert rows.select(metrics.words_13a(F.col("x"))).first()[0] == ["He", "said", ":", '"', "3.5", "%", "of", "1,000", "-", "odd", '"', "&", "left", ".", "Endless", "10", "-", "year"]
    rows = spark.createDataFrame([("我说“好”，—— ok 3.5。〇２é",)], "x string")
    assert rows.select(metrics.words_zh(F.col("x"))).first()[0] == ["我", "说", "“", "好", "”", "，", "—", "—", "ok", "3.5", "。", "〇", "２", "é"]


def test_results_fall_through_to_the_next_place(spark):
    rows = [("t", "other", 0, "f1", 0.1), ("t", "other", 1, "acc,none", 0.9), ("t", "piqa", 0, "acc,none", 0.3), ("t", "piqa", 0, "acc_norm,none", 0.4), ("t", "piqa", 1, "acc_norm,none", 0.5), ("t", "gsm8k", 0, "acc,none", 1.0)]
    got = {r.task: r.value for r in evaluate.preferred_metric(spark.createDataFrame(rows, "tag string, task string, place int, metric string, value double")).collect()}
    assert got == {"other": 0.9, "piqa": 0.4, "gsm8k": None}


def test_kinds_by_default(spark, tmp_path):
    rows = [(k, "q", "a") for k in ("Cot", "NLI", "Program")]
    spark.createDataFrame(rows, "kind string, input string, target string").write.json(str(tmp_path / "k"))
    kinds = lambda **how: sorted(r.kind for r in readers.jsonl_kinds(spark, [str(tmp_path / "k")], **how).collect())
    assert kinds() == ["Cot", "Program"] and kinds(kinds=[]) == ["Cot", "NLI", "Program"] and kinds(kinds=["NLI"]) == ["NLI"]


def test_nucleus_of_one_large_group(spark):
    rows = [("a", i, float(i % 50)) for i in range(3000)] + [(None, 1, 2.0), (None, 2, 1.0)]
    table = spark.createDataFrame(rows, "g string, id int, w double")
    got = metrics.nucleus(table, "g", "w", "id", 0.5)
    for g in ("a", None):
        mine = sorted(((-w, i) for h, i, w in rows if h == g))
        total, before, want = sum(-w for w, _ in mine), 0.0, set()
        for w, i in mine:
            if before < 0.5 - 1e-12:
                want.add(i)
            before -= w / total
        assert {r.id for r in got.where(F.col("g").eqNullSafe(F.lit(g))).collect()} == want


def test_offsets_in_ranges(spark):
    rows = [(i % 3, i, [i] * (i % 5 + 1)) for i in range(60)]
    table = spark.createDataFrame(rows, "shard int, ord int, ids array<int>")
    got = packing.stream_rows(packing.stream_pieces(packing.range_offsets(table, ["shard"], "ord", F.size("ids")), 7), ["shard"], "ids").collect()
    for s in range(3):
        whole = [x for h, _, ids in rows if h == s for x in ids]
        want = [whole[k : k + 7] for k in range(0, len(whole) - 6, 7)]
        assert [r.ids for r in sorted((r for r in got if r.shard == s), key=lambda r: r.row)] == want
