"""Named tasks and mixes, readers and reports that had no test."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import reports
from quern.plans import library, tasks
from quern.sources import readers, sinks
from quern.streaming import curve


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("library")
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / name))
    chats = "messages array<struct<role string, content string>>"
    write("SmolTalk", [([("user", f"q{i}"), ("assistant", "a"), ("tool", "x"), ("user", "")],) for i in range(5)] + [(None,), ([],)], chats)
    write("MMLU_AuxTrain", [(("q", ["x", "y"], 1),), (("q", ["x"], 4),)], "train struct<question string, choices array<string>, answer int>")
    for name in ("ARC_Easy_Train", "ARC_Challenge_Train"):
        write(name, [("q", (["A", "B"], ["x", "y"]), "B"), ("q", (["A"], ["x", "y"]), "A"), ("q", (["A"], ["x"]), "1")], "question string, choices struct<label array<string>, text array<string>>, answerKey string")
    write("GSM8K_Train", [("q", "3 <<1+2=3>>apples"), ("", "a"), ("q", None)], "question string, answer string")
    write("C3_Train", [(["l1", "l2"], "q", ["x", "y"], "y"), ([], "q", ["x"], "z")], "context array<string>, question string, choice array<string>, answer string")
    write("Magpie_ZH", [([("human", "问"), ("gpt", "答")],)], "conversations array<struct<`from` string, value string>>")
    for name, rows, kind in (
        ("COIG_CQIA", [{"instruction": " q ", "input": "more", "output": "a"}, {"instruction": "", "output": "a"}], "jsonl"),
        ("Firefly_ZH", [{"kind": "Cot", "input": "q", "target": "a"}, {"kind": "NLI", "input": "q", "target": "a"}], "jsonl"),
        ("AlpacaGPT4_ZH", [{"instruction": "q", "input": "", "output": "a"}] * 2, "json"),
    ):
        (folder / name).mkdir()
        text = json.dumps(rows) if kind == "json" else "\n".join([*(json.dumps(r, ensure_ascii=False) for r in rows), "", "{broken"])
        (folder / name / f"p.{kind}").write_text(text)
    (folder / "EnglishWords").mkdir()
    (folder / "EnglishWords" / "w.txt").write_text("apple\nberry\nx1\n\ncherry\n")
    return str(folder)


WHO = {"en": [("Who?", "Me.")], "zh": [("谁?", "我。")]}


def test_every_task_and_mix(spark, base):
    lib = library.Library(f"file://{base}", who=WHO)
    turns = lambda name, stop=None: [[tuple(x) for x in r.turns] for r in lib.task(name, stop).rows(spark).orderBy("ord").collect()]
    assert turns("SmolTalk", 2) == [[("user", "q0"), ("assistant", "a")], [("user", "q1"), ("assistant", "a")]] and len(turns("SmolTalk")) == 5
    asked = "Multiple Choice question: {}\n- x=A\n- y=B\n\nRespond only with the letter of the correct answer."
    assert turns("MMLU_AuxTrain") == turns("ARC_Easy_Train") == [[("user", asked.format("q")), ("assistant", "B")]]
    assert turns("C3_Train") == [[("user", asked.format("l1\nl2\nq")), ("assistant", "B")]]
    assert turns("GSM8K_Train") == [[("user", "q"), ("assistant", "3 apples")]]
    assert turns("Magpie_ZH") == [[("user", "问"), ("assistant", "答")]]
    assert turns("COIG_CQIA") == [[("user", "q\nmore"), ("assistant", "a")]]
    assert turns("Firefly_ZH") == [[("user", "q"), ("assistant", "a")]] and len(turns("AlpacaGPT4_ZH")) == 2
    assert len(turns("SimpleSpelling", 7)) == 7 and len(turns("SpellingBee", 9)) == 9 and len(turns("Identity", 11)) == 11
    before = library.Library(f"file://{base}", render="before").task("MMLU_AuxTrain").rows(spark).first().turns[0].text
    assert before == "q\nA. x\nB. y"
    with pytest.raises(KeyError, match="SmolTalk"):
        lib.task("nothing")
    names = {m: [f"{x}" for x in lib.mix(m).tasks] for m in library.MIXES}
    assert names["chat"].count("MMLU_AuxTrain(all)") == 3 and names["chat_mmlu1"].count("MMLU_AuxTrain(all)") == 1 and names["chat"].count("GSM8K_Train(all)") == 4
    assert "Magpie_ZH(all)" not in names["chat_zhreal"] and "Firefly_ZH(235000)" in names["chat_zhreal"] and "SmolTalk(all)" in names["chat_full"] and "SmolTalk(10000)" in names["sft"]
    assert "Identity(1000)" not in map(str, library.Library(base).mix("sft").tasks)
    with pytest.raises(KeyError, match="midtrain"):
        lib.mix("nothing")
    try:
        lib.register()
        assert tasks.build("chat", mmlu_epochs=2).summary()["MMLU_AuxTrain(all)"] == 2
        rows = tasks.build("sft").rows(spark)
        assert {r.task: r["count"] for r in rows.groupBy("task").count().collect()}["SimpleSpelling"] == 300
    finally:
        for m in library.MIXES:
            tasks.MIXES.pop(m, None)


def test_tasks_as_table_functions(spark, base):
    lib = library.Library(f"file://{base}")
    mixture = tasks.Mixture((lib.task("SmolTalk", 3), lib.task("GSM8K_Train"), lib.task("SmolTalk", 3)))
    assert library.publish(spark, mixture, "t_") == ["t_smoltalk", "t_gsm8k_train"]
    got = spark.sql("SELECT epoch, task, count(*) AS n FROM (SELECT * FROM t_smoltalk(2) UNION ALL SELECT * FROM t_gsm8k_train()) GROUP BY ALL").collect()
    assert sorted(map(tuple, got)) == [(1, "GSM8K_Train", 1), (1, "SmolTalk", 3), (2, "SmolTalk", 3)]
    assert spark.sql("SELECT * FROM t_smoltalk(0)").count() == 0
    plan = spark.sql("SELECT count(*) FROM t_gsm8k_train() WHERE task = 'GSM8K_Train'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(question)" in plan and "Exchange SinglePartition" in plan  # inlined: a filtered scan and a count
    with pytest.raises(ValueError, match="several stops"):
        library.publish(spark, tasks.Mixture((lib.task("SmolTalk", 3), lib.task("SmolTalk"))))


def test_result_files(spark, tmp_path):
    for name, results in (("a/1.json", {"piqa": {"acc,none": 0.5}, "arc": {"acc,none": 0.1}}), ("b/2.json", {"piqa": {"acc,none": 0.7}, "gsm8k": {"em": 1.0}})):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"results": results, "other": 1}))
    got = readers.result_files(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect())) == [("arc", "acc,none", 0.1), ("gsm8k", "em", 1.0), ("piqa", "acc,none", 0.5)]


def test_health_windows(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", 1.0), ("2024-01-01 00:03:00", 3.0), ("2024-01-01 00:07:00", 5.0), ("2024-01-01 01:00:00", 0.0)]
    spark.createDataFrame(rows, "ts string, load double").coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    curve.replay(curve.health(spark, str(tmp_path / "in"), "ts timestamp, load double"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("minute(window.start) as m", "n", "load").collect()
    assert sorted(map(tuple, got)) == [(0, 2, 2.0), (5, 1, 5.0)]  # the last window is still open


def test_chat_manifest_and_masks(spark, tmp_path):
    packed = spark.createDataFrame([([1, 2, 3, 4], [0, 1, 1, 0]), ([5, 6, 7, 8], [0, 0, 0, 1])], "ids array<int>, mask array<int>")
    done = spark.createDataFrame([("b", 3, 30), ("a", 2, 20)], "task string, rows long, tokens long")
    row = reports.chat_manifest("m", 4, packed, done, ["a", "b", "a"]).first()
    assert (row.mix, row.seq_length, row.chunks, row.total_tokens, row.supervised_ratio) == ("m", 4, 2, 8, 3 / 8)
    assert row.tasks == ["a", "b", "a"] and row.rows == {"a": 2, "b": 3} and row.actual_tokens == {"a": 20, "b": 30}
    sinks.shuffled(packed.withColumn("k", F.col("ids")[0]), str(tmp_path / "s"), 1, ["k"])
    back = {tuple(r.ids): r.mask for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert back == {tuple(r.ids): r.mask for r in packed.collect()}
    sinks.manifest(spark.createDataFrame([("名字 é \"q\"",)], "name string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().name == "名字 é \"q\""

