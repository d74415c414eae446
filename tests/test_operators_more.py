"""Tokens, tasks, evaluation, packed scans and streams against small specifications."""

import random

import pytest
from pyspark.sql import functions as F

from quern import storage
from quern.functions import text as t
from quern.operators import chat, evaluate, metrics, mix, tokens
from quern.plans import tasks
from quern.sources import readers, registry

TOK = tokens.Bytes()


def some_turns(rng, n):
    rows = []
    for c in range(n):
        for k in range(rng.randint(1, 7)):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", "tool"]) if k else rng.choice(["system", "user", "assistant"])
            rows.append((c, k, role, "x" * rng.choice([0, 1, 3, 9, 30])))
    return rows


def test_lengths_and_ids_equal_the_python_encoder(spark):
    rows = some_turns(random.Random(3), 120)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for room in (20, 40, 90):
        want = {}
        for c in {r[0] for r in rows}:
            got = chat.encode_turns([(r[2], r[3]) for r in sorted(rows) if r[0] == c], TOK.encode_text, TOK.marks, room)
            if got:
                want[c] = got[0]
        made = {r.conv_id: (r.ids, r["mask"]) for r in chat.encoded(turns, TOK, room).collect()}
        assert made == {c: (list(i), list(m)) for c, (i, m) in want.items()}
        sizes = {r.conv_id: (r.total, r.supervised) for r in chat.pair_lengths(turns, room, F.char_length).where("emitted").collect()}
        assert sizes == {c: (len(i), sum(m)) for c, (i, m) in want.items()}


def test_template_and_called_tokenizer(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "é"), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.ids for r in chat.conversations(turns).select("conv_id", tokens.template(F.col("turns"), TOK, True).alias("ids")).collect()}
    assert got == {1: [1, ord("s") + 8, 6, 3, ord("u") + 8, 4, 0xC3 + 8, 0xA9 + 8, 5, 4], 2: [1, 3, 4]}
    called = tokens.Called(lambda: lambda s: [ord(c) + 8 for c in s], lambda: lambda ids: "".join(chr(i - 8) for i in ids), 300)
    frame = spark.createDataFrame([("ab",), (None,)], "x string").select(called.encode(F.col("x")).alias("ids"))
    assert [list(r.ids) for r in frame.collect()] == [[105, 106], []]
    assert frame.select(called.decode(F.concat(F.array(F.lit(1)), "ids")).alias("x")).first().x == "ab"


def test_rendered_keeps_unknown_roles(spark):
    turns = spark.createDataFrame([(1, 0, "tool", "a"), (1, 1, "user", ""), (1, 2, "gpt", "b")], "conv_id long, turn long, role string, text string")
    assert chat.conversations(turns).select(chat.rendered(F.col("turns")).alias("x")).first().x == "tool:a\n\n助手:b"


def test_tasks(spark):
    made = tasks.Task("t", lambda s: s.range(10).select(F.col("id").alias("ord"), F.array(F.struct(F.lit("user").alias("role"), F.lit("a b").alias("text"))).alias("turns")))
    mixed = tasks.Mixture((made, made.stopped(3), made))
    assert mixed.rows(spark).count() == 23 and mixed.summary() == {"t(all)": 2, "t(3)": 1}
    with pytest.raises(ValueError):
        made.stopped(0)
    tasks.MIXES.pop("demo", None)
    tasks.mix("demo")(lambda epochs=2: tasks.Mixture((made,) * epochs))
    assert len(tasks.build("demo", epochs=3).tasks) == 3
    with pytest.raises(KeyError, match="known: demo"):
        tasks.build("nothing")


def test_globs_and_parts(spark, tmp_path):
    paths = ["a", "x/a", "x/y/a", "xa", "x/ab"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    keep = lambda g: {r.path for r in registry.selected(files, [g]).collect()}
    assert keep("**/a") == {"a", "x/a", "x/y/a", "xa"} and keep("x/*") == {"x/a", "x/ab"} and keep("?") == {"a"}
    for n in ("b.txt", "a.txt"):
        (tmp_path / n).write_text(n)
    assert [p.rsplit("/", 1)[1] for p in readers.parts(spark, [f"{tmp_path}/*.txt"])] == ["a.txt", "b.txt"]
    with pytest.raises(FileNotFoundError):
        readers.parts(spark, [f"{tmp_path}/*.none"])


def test_running_and_numbered_hold_over_plans(spark, tmp_path):
    spark.range(5000).select("id", (F.col("id") % 7).alias("_quern_row")).repartition(5).write.parquet(str(tmp_path / "t"))
    seen = []
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows, name = storage.numbered(spark.read.parquet(str(tmp_path / "t")))
            seen.append({r.id: (r[name], r["_quern_row"]) for r in rows.collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len({v[0] for v in seen[0].values()}) == 5000 and name != "_quern_row"
    hot = storage.stage(spark, spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("g"), F.lit(2).alias("v")), "hot")
    got = {r.id: (r["at"], r.v_before) for r in storage.running(hot, ["g"], ["-id"], ("v",)).collect()}
    ids = [i for i in range(2999, -1, -1) if i % 3 > 0 or i == 1]
    assert all(got[i] == (k, 2 * k) for k, i in enumerate(ids)) and got[0] == (0, 0)


def test_packed_guards(spark, tmp_path):
    put = lambda name, rows, field: spark.createDataFrame([(r,) for r in rows], f"{field} array<int>").coalesce(1).write.parquet(str(tmp_path / name)) or str(tmp_path / name)
    ids, mask, short, wide = put("i", [[1, 2], [3, 4]], "ids"), put("m", [[1, 0], [0, 1]], "mask"), put("s", [[1, 0]], "mask"), put("w", [[1, 2], [3]], "ids")
    assert {r["index"]: r.labels for r in readers.packed(spark, [ids, ids], [mask, mask]).collect()} == {0: [1, -100], 1: [-100, 4], 2: [1, -100], 3: [-100, 4]}
    for bad in (([ids, ids], [mask]), ([ids], [short]), ([wide], None)):
        with pytest.raises(ValueError):
            readers.packed(spark, *bad)


def test_evaluation_parts(spark):
    raw = {"hidden_size": 1024, "head_dim": 128, "num_attention_heads": 16, "num_key_value_heads": 8, "intermediate_size": 3072}
    got = evaluate.scaled_architecture(raw, 12)
    assert (got["hidden_size"], got["num_attention_heads"], got["num_key_value_heads"], got["intermediate_size"]) == (768, 12, 6, 2304)
    assert evaluate.scaled_architecture(raw, 0) == raw
    with pytest.raises(ValueError):
        evaluate.scaled_architecture(raw, 1)
    names = spark.createDataFrame([("checkpoint-20",), ("checkpoint-x",), ("a-checkpoint-3",)], "x string")
    assert [r[0] for r in names.select(evaluate.checkpoint_step(F.col("x"))).collect()] == [20, None, None]
    row = lambda f, x: [r.w for r in spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("w")).collect()][0]
    assert row(metrics.words_13a, 'Hi, "you" 3.5-4 &amp; x.') == ["Hi", ",", '"', "you", '"', "3.5", "-", "4", "&", "x", "."]
    assert row(metrics.words_zh, "你好,world") == ["你", "好", ",", "world"]
    ema = metrics.ema(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, 5, 1, 2])], "g int, k long, v double"), "g", "k", "v").first().ema
    assert ema == pytest.approx(0.9 * (0.9 * (0.9 * 3 + 0.1 * 5) + 0.1 * 1) + 0.1 * 2)
    steps = spark.createDataFrame([(i,) for i in (10, 20, 30)], "step long")
    assert mix.latest(steps, steps.where("step < 25")).first().step == 20
    got = {r.step: r.k for r in spark.createDataFrame([("x" * 48,), ("ab" * 30,)], "x string").select(F.char_length("x").alias("step"), t.repetition(F.col("x")).alias("k")).collect()}
    assert got[48] == 0.0 and got[60] == pytest.approx(1 - 1 / 2)


def test_stream_packer_hook_and_stop(spark, tmp_path):
    from quern.streaming import curve

    rng = random.Random(1)
    docs = [(i % 2, i, [rng.randint(10, 99) for _ in range(rng.randint(0, 9))]) for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in (docs[:25], docs[25:]):
            spark.createDataFrame(part, "shard long, ord long, ids array<int>").write.mode("append").parquet(str(tmp_path / "in"))
            q = curve.replay(curve.pack_stream(spark.readStream.schema("shard long, ord long, ids array<int>").parquet(str(tmp_path / "in")), 8, 0), str(tmp_path / "out"), str(tmp_path / "cp"))
            q.awaitTermination(90)
        got = {(r.shard, r.row): r.ids for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for s in (0, 1):
        flow = [x for shard, _, ids in docs if shard == s for x in [*ids, 0]]
        rows = [got[s, k] for k in range(len(flow) // 8)]
        assert rows == [flow[i * 8 : i * 8 + 8] for i in range(len(flow) // 8)] and (s, len(rows)) not in got
    spark.createDataFrame([(5, "c5"), (9, "c9")], "step long, ckpt string").coalesce(1).write.json(str(tmp_path / "saves"))
    calls = []

    def call(text):
        calls.append(text)
        raise RuntimeError("seen, and no harm done")

    curve.hooked(curve.curve(spark, str(tmp_path / "saves"), "step long, ckpt string"), str(tmp_path / "cp2"), "eval {step} {ckpt}", call).awaitTermination(60)
    assert calls == ["eval 5 c5", "eval 9 c9"]
    query = spark.readStream.format("rate").load().writeStream.format("noop").start()
    assert curve.stop_gracefully(query, 20) and not query.isActive
