"""Stateful packing, random access, permutations, scans in ranges and totals seen while writing."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern import storage
from quern.operators import metrics, mix, packing
from quern.sources import readers, sinks
from quern.streaming import curve, packers


def packed_in_batch(spark, docs, seq_len, buffer):
    table = spark.createDataFrame([(s, o, n - 1) for s, o, n in docs], "shard long, ord long, n long")
    return sorted(map(tuple, packing.bos_best_fit(table, "shard", "ord", "n", seq_len, buffer).collect()))


@pytest.mark.parametrize("seed,files,each", [(1, 1, 1), (2, 9, 2), (3, 5, 1)])
def test_streamed_rows_equal_the_batch_packers(spark, tmp_path, seed, files, each):
    rng = random.Random(seed)
    docs = [(s, i, rng.choice([rng.randint(1, 12), rng.randint(1, 40)])) for s in range(3) for i in range(rng.randint(30, 90))]
    sizes = {s: sum(1 for d in docs if d[0] == s) for s in range(3)}
    arriving = docs + [(s, n, None) for s, n in sizes.items()] + [(7, 0, None), (8, 0, 5), (8, 2, 5)]  # 7 is empty, 8 never closed and lacks its second
    rng.shuffle(arriving)
    for k in range(files):
        spark.createDataFrame(arriving[k::files], "shard long, ord long, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for _ in range(2):  # a restart finds nothing new
            stream = spark.readStream.schema("shard long, ord long, n long").option("maxFilesPerTrigger", each).parquet(str(tmp_path / "in"))
            curve.replay(packers.best_fit(stream, 32, 7), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = sorted(map(tuple, spark.read.schema(packers.ROWS).parquet(str(tmp_path / "out")).collect()))
    assert got == sorted([*packed_in_batch(spark, docs, 32, 7), (7, -1, 0, 0, 0)])


class Store:
    """A shard's state in memory, with its calls counted."""

    def __init__(self):
        self.tables, self.calls = {}, 0

    def getValueState(self, name, _):  # noqa: N802 - the engine's name
        return State(self, name)

    def getMapState(self, name, *_):  # noqa: N802
        return State(self, name)


class State:
    def __init__(self, store, name):
        self.store, self.rows = store, store.tables.setdefault(name, {})

    def _called(self, got=None):
        self.store.calls += 1
        return got

    exists = lambda self: self._called(bool(self.rows))
    get = lambda self: self._called(self.rows[()])
    update = lambda self, v: self._called(self.rows.update({(): v}))
    containsKey = lambda self, k: self._called(k in self.rows)  # noqa: E731, N815
    getValue = lambda self, k: self._called(self.rows.get(k))  # noqa: E731, N815
    updateValue = lambda self, k, v: self._called(self.rows.update({k: v}))  # noqa: E731, N815
    removeKey = lambda self, k: self._called(self.rows.pop(k))  # noqa: E731, N815
    iterator = lambda self: self._called(iter(list(self.rows.items())))
    clear = lambda self: self._called(self.rows.clear())


@pytest.mark.parametrize("out", [10, 10_000])
def test_waiting_documents_take_few_calls_of_the_state(monkeypatch, out):
    monkeypatch.setattr(packers, "OUT", out, raising=False)
    rng = random.Random(5)
    docs = [(i, rng.randint(1, 40)) for i in range(4000)]
    arriving = [*docs, (4000, None), *rng.sample(docs, 300)]  # some come again
    rng.shuffle(arriving)
    store, got, frames = Store(), [], 0
    for k in range(4):
        packer = packers.BestFit(32, 20)  # a restart each time
        packer.init(store)
        batch = pd.DataFrame(arriving[k::4], columns=["ord", "n"], dtype="object" if k % 2 else None)
        for f in packer.handleInputRows((3,), iter([batch[:700], batch[700:]]), None):
            got += list(map(tuple, f.to_numpy().tolist()))
            frames += 1
    stats, want = {"in": 0, "dropped": 0, "partial": 0}, []
    for i, row in enumerate(packing.bos_rows(iter(docs), 32, 20, stats)):
        at = 0
        for doc, taken in row:
            want.append((3, i, doc, at, taken))
            at += taken
    assert got == [*want, (3, -1, stats["in"], stats["dropped"], stats["partial"])]
    assert not any(store.tables.values())
    assert store.calls < 400  # less than one for ten documents
    assert (frames > 50) == (out == 10)


def test_stream_packer_sorts_a_group_of_several_frames(spark, tmp_path):
    docs = [(0, i, [i]) for i in range(1000)][::-1]
    spark.createDataFrame(docs, "shard long, ord long, ids array<int>").coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        curve.replay(curve.pack_stream(spark.readStream.schema("shard long, ord long, ids array<int>").parquet(str(tmp_path / "in")), 8, -1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = [x for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.row) for x in r.ids if x >= 0]
    assert got == list(range(1000))


def scanned(df):
    """Rows and files that the scans of an executed plan read."""
    df.collect()
    out, todo = {"rows": 0, "files": 0}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if node.nodeName().startswith("Scan parquet"):
            out["rows"] += node.metrics().apply("numOutputRows").value()
            out["files"] += node.metrics().apply("numFiles").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_rows_at_reads_only_their_blocks(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"), F.array(F.col("id").cast("int")).alias("ids"), F.array((F.col("id") % 2).cast("int")).alias("mask"))
    sinks.blocked(rows, path, ["k"], 100)
    want = {i: r.ids for i, r in enumerate(sorted(rows.collect(), key=lambda r: r.k))}
    got = readers.rows_at(spark, path, [4999, 3, 3, 250, 7000])
    assert {r["index"]: r.ids for r in got.collect()} == {i: want[i] for i in (3, 250, 4999)}
    assert all(r.mask[0] == r.ids[0] % 2 for r in got.collect())  # ids and masks stay together
    seen = scanned(readers.rows_at(spark, path, [4999, 3, 3, 250, 7000]))
    assert seen["files"] == 3 and seen["rows"] <= 300
    many = readers.rows_at(spark, path, list(range(0, 5000, 123)))
    assert {r["index"] for r in many.collect()} == set(range(0, 5000, 123))
    assert readers.rows_at(spark, path, []).count() == 0
    most = readers.NAMED
    try:
        readers.NAMED = 10
        table = spark.createDataFrame([(i,) for i in [*range(0, 5000, 50), None, 0]], "index long")
        assert sorted(r["index"] for r in readers.rows_at(spark, path, table).collect()) == list(range(0, 5000, 50))
    finally:
        readers.NAMED = most


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4096, 10_007])
def test_permutation(spark, n):
    got = spark.range(n).select("id", mix.permuted(F.col("id"), n, 5, 2).alias("at")).withColumn("back", mix.permuted(F.col("at"), n, 5, 2, inverse=True)).collect()
    assert sorted(r["at"] for r in got) == list(range(n)) and all(r.back == r.id for r in got)
    if n >= 1000:
        other = {r.id: r["at"] for r in spark.range(n).select("id", mix.permuted(F.col("id"), n, 5, 3).alias("at")).collect()}
        assert sum(other[r.id] == r["at"] for r in got) < 20 and sum(r["at"] == r.id for r in got) < 20
        steps = [b - a for a, b in zip([r["at"] for r in sorted(got, key=lambda r: r.id)], [r["at"] for r in sorted(got, key=lambda r: r.id)][1:])]
        assert len(set(steps)) > n // 3  # no fixed stride


def test_resume_needs_no_shuffle(spark):
    rows = spark.range(1000).withColumnRenamed("id", "index")
    rest = mix.epoch_rest(rows, "index", 1000, 1, 4, 600)
    assert rest.count() == 400 and "Exchange" not in rest._jdf.queryExecution().executedPlan().toString()
    first = {r["index"] for r in rows.select("index", mix.permuted(F.col("index"), 1000, 1, 4).alias("at")).where("at < 600").collect()}
    assert first | {r["index"] for r in rest.collect()} == set(range(1000))


def test_scans_in_ranges(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.choice([float(rng.randint(0, 40)), None]) if g != "long" else float(rng.randint(0, 9**9))) for g, k in (("a", 5), (None, 30), ("long", 3000)) for i in range(k)]
    table = spark.createDataFrame(rows, "g string, k long, v double")
    got = {(r.g, r.k): r for r in metrics.best_so_far(table, ["g"], "k", "v").collect()}
    best = {}
    for g, k, v in rows:
        low = v is not None and (best.get(g) is None or v < best[g])
        best[g] = v if low else best.get(g)
        assert (got[g, k].best, got[g, k].new_low) == (best[g], low), (g, k)
    full = table.where("v is not null")
    for by in (["g"], []):
        table = full if by else full.where("g = 'long'")
        got = {(r.g if by else "long", r.k): r.ema for r in metrics.ema_curve(table, by, "k", "v", 0.97).collect()}
        mean = {}
        for g, k, v in rows:
            if v is None or not by and g != "long":
                continue
            mean[g] = 0.97 * mean[g] + 0.03 * v if g in mean else v
            assert got[g, k] == pytest.approx(mean[g])


def test_totals_seen_while_writing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3), ("a", 4), ("b", 3), ("c", 5), (None, 1), ("b", None)], "source string, n long").repartition(3)
    got = sinks.written(rows, str(tmp_path / "w"), ["a", "b", "z"])
    assert {tuple(r) for r in got.collect()} == {("a", 2, 7), ("b", 2, 3), ("z", 0, 0), (None, 2, 6)}
    assert spark.read.parquet(str(tmp_path / "w")).count() == 6
    two = rows.where("source in ('a', 'b')")
    assert sinks.written_as_planned(two, str(tmp_path / "x"), {"a": 0.7, "b": 0.3}).count() == 3
    with pytest.raises(ValueError, match="deviates"):
        sinks.written_as_planned(two, str(tmp_path / "y"), {"a": 0.5, "b": 0.5})
    assert spark.read.parquet(str(tmp_path / "y")).count() == 4  # it was written all the same
    assert storage.free_name(["a"], "b") == "b"
