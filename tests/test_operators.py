"""Packers, masks, readers and metrics against small specifications."""

import gzip
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import chat, generate, metrics, packing, reports
from quern.sources import readers, registry, sinks


def bos_spec(docs, seq_len, size):
    """The packer, one document at a time over a plain list."""
    source, buffer, rows, dropped = list(docs), [], [], 0
    take = lambda: [buffer.append(source.pop(0)) for _ in range(size - len(buffer)) if source]
    take()
    while buffer:
        row, room = [], seq_len
        while room and buffer:
            fits = [x for x in buffer if x[1] <= room]
            if fits:
                pick = max(fits, key=lambda x: x[1])
                row.append(pick)
                room -= pick[1]
            else:
                pick = min(buffer, key=lambda x: x[1])
                row.append((pick[0], room))
                dropped += pick[1] - room
                room = 0
            buffer.remove(pick)
            take()
        if room:
            return rows, dropped, seq_len - room
        rows.append(row)
    return rows, dropped, 0


def test_bos_best_fit_equals_spec():
    rng = random.Random(5)
    for _ in range(100):
        docs = [(i, rng.randint(1, 30)) for i in range(rng.randint(0, 40))]
        stats = {"in": 0, "dropped": 0, "partial": 0}
        got = list(packing.bos_rows(iter(docs), 16, 5, stats))
        want, dropped, partial = bos_spec(docs, 16, 5)
        assert got == want and stats["dropped"] == dropped and stats["partial"] == partial
        assert all(sum(n for _, n in r) == 16 for r in got)
        assert stats["in"] == sum(sum(n for _, n in r) for r in got) + dropped + partial


@pytest.mark.parametrize("parts", ["1", "4", "16"])
def test_packers_dont_depend_on_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.range(120).select(F.col("id").alias("doc"), (F.col("id") % 3).alias("shard"), (F.col("id") * 7 % 23).alias("n"))
        got = packing.bos_best_fit(docs, "shard", "doc", "n", 32, 10).collect()
        rows = {}
        for r in got:
            if r.row >= 0:
                rows.setdefault((r.shard, r.row), []).append((r["at"], r.ord, r.taken))
        for shard in range(3):
            want, _, _ = bos_spec([(i, i * 7 % 23 + 1) for i in range(120) if i % 3 == shard], 32, 10)
            assert [[(d, n) for _, d, n in sorted(rows[shard, k])] for k in range(len(want))] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_rows_are_a_prefix_of_the_stream(spark):
    docs = spark.range(40).select("id", F.lit(0).alias("shard"), F.expr("transform(sequence(1, cast(id % 9 + 1 as int)), x -> cast(id * 100 + x as int))").alias("ids"))
    off = packing.stream_offsets(docs, ["shard"], "id", F.size("ids") - 1)
    got = [r.ids for r in packing.stream_rows(packing.stream_pieces(off, 8, 20), ["shard"], "ids").orderBy("row").collect()]
    stream = [x for r in docs.orderBy("id").collect() for x in r.ids]
    assert len(got) == 20 and all(len(x) == 8 for x in got) and sum(got, []) == stream[:160]


def test_chat_best_fit(spark):
    rows = [(0, i, random.Random(i).randint(1, 30)) for i in range(100)]
    got = packing.chat_best_fit(spark.createDataFrame(rows, "k int, i int, n int"), ["k"], "i", "n", 32, 40).collect()
    assert len(got) == 100
    fill = {}
    for r in got:
        fill.setdefault((r.pool, r.row), []).append((r["at"], r.n))
    for parts in fill.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 32
    assert all(r.pool == r.i // 40 for r in got)


MARKS = {"bos": 1, "user": 90, "assistant": 91, "end": 92, "system": 93}


def test_encode_turns(spark):
    code = lambda s: [len(w) for w in s.split()]
    one = chat.encode_turns([("user", "a bb"), ("assistant", "ccc")], code, MARKS, 20)
    assert one == [([1, 90, 90, 1, 2, 91, 3, 92], [0, 0, 0, 0, 0, 0, 1, 1])]
    assert chat.encode_turns([("assistant", "x"), ("user", "a")], code, MARKS, 20) == []
    assert chat.encode_turns([("user", "a"), ("assistant", "b")] * 4, code, MARKS, 12) == []
    split = chat.encode_turns([("user", "a"), ("assistant", "b")] * 4, code, MARKS, 12, split=True)
    assert len(split) == 2 and all(len(i) == len(m) <= 12 for i, m in split)
    system = chat.encode_turns([("system", "ss"), ("user", "a"), ("assistant", "b")], code, MARKS, 12)
    assert system[0][0] == [1, 2, 90, 90, 1, 91, 1, 92]
    long = chat.encode_turns([("user", "a " * 30), ("assistant", "b"), ("user", "a"), ("assistant", "b")], code, MARKS, 12)
    assert long == [([1, 90, 90, 1, 91, 1, 92], [0, 0, 0, 0, 0, 1, 1])]  # a pair too long by itself is left out
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b c")], "conv_id long, turn long, role string, text string")
    got = chat.segments(chat.conversations(turns), code, MARKS, 20).collect()
    assert got[0].ids == [1, 90, 90, 1, 91, 1, 1, 92] and list(got[0].mask) == [0, 0, 0, 0, 0, 1, 1, 1]


def test_readers(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    open(p, "w").write('{"text": "one"}\n\n{bad\n{"other": 1}\n{"text": ""}\n{"text": "two"}\n')
    assert sorted(r.text for r in readers.read(spark, "jsonl", [p]).collect()) == ["one", "two"]
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"text": "three"}\n')
    assert [r.text for r in readers.read(spark, "jsonl_gz", [str(tmp_path / "b.jsonl.gz")]).collect()] == ["three"]
    q = str(tmp_path / "c.json")
    json.dump([{"instruction": " q ", "input": "more", "output": "a"}, {"instruction": "q2", "output": "b"}, {"instruction": "", "output": "c"}], open(q, "w"))
    assert {(r.question, r.answer) for r in readers.read(spark, "json_alpaca", [q]).collect()} == {("q\nmore", "a"), ("q2", "b")}
    spark.createDataFrame([([("human", "x"), ("gpt", "y"), ("tool", "z"), ("gpt", "")],)], "conversations array<struct<from:string,value:string>>").write.parquet(str(tmp_path / "d"))
    got = readers.read(spark, "parquet_chat_sharegpt", [str(tmp_path / "d")]).collect()
    assert [[(x.role, x.text) for x in r.turns] for r in got] == [[("user", "x"), ("assistant", "y")]]
    rows = [("q", (["A", "B"], ["x", "y"]), "B"), ("q", (["A", "B"], ["x", "y"]), "C"), ("q", (["A"], ["x", "y"]), "A")]
    spark.createDataFrame(rows, "question string, choices struct<label:array<string>,text:array<string>>, answerKey string").write.parquet(str(tmp_path / "e"))
    assert [r.answer for r in readers.read(spark, "parquet_arc", [str(tmp_path / "e")]).collect()] == ["B"]
    spark.createDataFrame([(["l1", "l2"], "q", ["x", "y"], "y"), ([], "q", ["x", "y"], "z")], "context array<string>, question string, choice array<string>, answer string").write.parquet(str(tmp_path / "f"))
    assert [(r.context, r.answer) for r in readers.read(spark, "parquet_mc_zh", [str(tmp_path / "f")]).collect()] == [("l1\nl2", "B")]
    long = [("a" * 1000, "b"), ("a" * 1001, "b"), ("　", "b"), (" a　", "b")]
    spark.createDataFrame([(x,) for x in long], "translation struct<en:string,zh:string>").write.parquet(str(tmp_path / "g"))
    assert sorted(len(r.en) for r in readers.read(spark, "parquet_pair", [str(tmp_path / "g")]).collect()) == [1, 1000]
    with pytest.raises(KeyError):
        readers.read(spark, "nothing", [p])
    assert readers.probe(readers.read(spark, "jsonl", [p])) == (2, 3.0)


def test_registry_and_sinks(spark, tmp_path):
    sources = registry.registry(spark, [{"name": "a", "lang": "en", "n_parts": 2}], [{"name": "b", "lang": "zh"}])
    assert registry.get(sources, "a").lang == "en"
    with pytest.raises(KeyError, match="known: a, b"):
        registry.get(sources, "c")
    with pytest.raises(ValueError):
        registry.registry(spark, [{"name": "a"}], [{"name": "a"}])
    with pytest.raises(KeyError):
        registry.weighted(spark.createDataFrame([("c", 1.0)], "source string, weight double"), sources)
    files = spark.createDataFrame([("x/b.parquet",), ("x/a.parquet",), ("x/y/c.parquet",)], "path string")
    assert [r.path for r in registry.selected(files, ["x/*.parquet"], 1).collect()] == ["x/a.parquet"]
    assert registry.selected(files, ["x/**.parquet"]).count() == 3
    sinks.shuffled(spark.range(50), str(tmp_path / "s"), 3, ["id"])
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == list(range(50))
    sinks.append_curve(spark.createDataFrame([(1, "x")], "step int, error string"), str(tmp_path / "c"))
    sinks.append_curve(spark.createDataFrame([(2, 0.5)], "step int, bleu double"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2
    with pytest.raises(ValueError):
        reports.require_shares(spark.createDataFrame([(0.02,)], "deviation double"))


def test_text_functions(spark):
    row = lambda c, v, s="string": spark.createDataFrame([(v,)], f"x {s}").select(c(F.col("x")).alias("y")).first().y
    assert row(t.strip, "　 a b \t") == "a b"
    assert row(t.cjk_share, "中文ab") == 0.5 and row(t.cjk_share, "") == 0
    assert row(t.repetition, "a" * 96) == pytest.approx(1 - 1 / 3)
    assert row(t.repetition, "ab") == 0
    assert row(lambda c: t.left_truncated(c, 2), [1, 2, 3], "array<int>") == [2, 3]
    assert row(lambda c: t.without_ids(c, [2]), [1, 2, 2, 3], "array<int>") == [1, 3]
    assert row(generate.spelled, "cat") == "c,a,t"


def test_metrics(spark):
    rows = spark.createDataFrame([(1, "a b c d e".split(), "a b c d e".split())], "k int, h array<string>, r array<string>")
    assert metrics.bleu(rows, "h", "r").first().bleu == pytest.approx(100)
    short = spark.createDataFrame([(1, "a b c d".split(), "a b c d e".split())], "k int, h array<string>, r array<string>")
    assert metrics.bleu(short, "h", "r").first().bleu == pytest.approx(100 * math.exp(1 - 5 / 4))
    steps = spark.range(1, 11).select((F.col("id") * 100).alias("step"))
    assert sorted(r.step for r in metrics.retained(steps, 2, 500).collect()) == [500, 900, 1000]
    assert metrics.retained(steps, 0, 500).count() == 10


def test_streaming(spark, tmp_path):
    from quern.streaming import curve

    spark.createDataFrame([(1, 0.5), (2, 0.6)], "step int, bleu double").write.json(str(tmp_path / "in"))
    q = curve.replay(curve.curve(spark, str(tmp_path / "in"), "step int, bleu double"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
