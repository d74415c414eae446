"""Operators 11 to 13 against SQL and brute force, and the cases their docstrings define."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import storage
from quern.llm import line_runs, vector_codes, vectors, whitening

NAN, INF = float("nan"), float("inf")
VECS = "vec_id long, embedding array<float>, label int, x int, code string, n long"


def odd_vectors(seed=1, count=60, d=16):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(v) for v in np.float32(rng.normal(0, 1, d))], int(i % 3) if i % 7 else None) for i in range(count)]
    rows += [rows[3]] * 20 + [(900 + i, rows[4][1], 1) for i in range(15)]  # repeated rows, equal vectors
    rows += [(None, rows[5][1], 2), (901, None, 1), (902, [1.0] * (d - 1) + [None], 1), (903, [NAN] + [1.0] * (d - 1), 1), (904, [INF] * d, 1), (905, [-INF] * d, None), (906, [], 1), (907, [1.0] * (d + 1), 1), (908, [-0.0] * d, 0)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 5, "c", 7) for r in odd_vectors()], VECS).repartition(5)


def kept_ints(rows, d, scale):
    ok = [r for r in rows if r[1] is not None and len(r[1]) == d and all(v is not None and math.isfinite(v) for v in r[1])]
    return [(r[0], [math.floor(scale * v) for v in r[1]], r[2]) for r in ok]


@pytest.mark.parametrize("module,name", [(vector_codes, "op11_vector_codes"), (line_runs, "op12_line_dedup")])
def test_sql(spark, sf, module, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = getattr(module, name)(spark, sf)
    want = con.execute(getattr(module, name.split("_")[0].upper() + "_SQL"))
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# 11


def test_annulus_equals_all_entries():
    rng = np.random.default_rng(2)
    for trial in range(60):
        d, k, spread = int(rng.integers(1, 9)), int(rng.integers(1, 20)), int(rng.choice([2, 50, 1 << 26]))
        x = rng.integers(-spread, spread + 1, (200, d))
        entries = rng.integers(-spread, spread + 1, (k, d))
        if trial % 3 == 0:
            entries[k // 2 :] = entries[: k - k // 2]  # equal entries
        at, best, evaluated = vector_codes.nearest(x, entries)
        all_d = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (at == all_d.argmin(1)).all() and (best == all_d.min(1)).all() and evaluated <= all_d.size


def test_annulus_prunes():
    rng = np.random.default_rng(3)
    entries = np.arange(1, 17)[:, None] * 1000 + rng.integers(0, 5, (16, 8))
    x = entries[rng.integers(0, 16, 500)] + rng.integers(-9, 9, (500, 8))
    assert vector_codes.nearest(x, entries)[2] < 1.2 * len(x)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[list(cut(r[1], p)) for r in rows[:entries]] for p in range(parts)]
    best = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for r in rows:
                got[best(cut(r[1], p), books[p])[1]].append(cut(r[1], p))
            for e, vs in got.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out = [(r, [best(cut(r[1], p), books[p]) for p in range(parts)]) for r in rows]
    by = defaultdict(int)
    for r, b in out:
        by[r[2]] += sum(d for d, _ in b)
    digest = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b), by[r[2]], digest) for r, b in out]


def test_codes_of_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op11_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_codes(kept_ints(odd_vectors(), 16, 4096)), key=repr)
    few = odd.where("vec_id < 5").dropDuplicates(["vec_id"])
    coded, books = vector_codes.compress(few)
    assert books.shape == (8, 5, 2) and all(r.error == 0 for r in coded.collect())
    exact = vector_codes.decode(coded, books).collect()
    want = {r[0]: r[1] for r in kept_ints(odd_vectors(), 16, 4096)}
    assert all([round(v * 4096) for v in r.vector] == want[r.vec_id] for r in exact)
    odd.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vector_codes.op11_vector_codes(spark, f"{tmp_path}/none").collect() == []
    big = spark.createDataFrame([(1, [1e9] * 8, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(big)


# 13


def test_symmetric_qr():
    rng = np.random.default_rng(4)
    for d in (1, 2, 3, 7, 40):
        for kind in range(4):
            a = rng.normal(size=(d, max(1, d // (1 + kind % 2))))
            a = a @ a.T
            if kind == 2:
                a = np.diag(np.arange(d, dtype=float))
            if kind == 3:
                a = np.ones((d, d))
            values, basis = whitening.symmetric_qr(a)
            assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, abs(a).max() * d))
            assert np.allclose(basis.T @ basis, np.eye(d), atol=1e-12) and np.allclose(basis * values @ basis.T, a, atol=1e-11 * max(1, abs(a).max() * d))
    assert (whitening.symmetric_qr(np.zeros((3, 3)))[0] == 0).all()


def test_parallel_update_equals_one_pass():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (101, 6)) + 1_000_000
    whole = whitening.Moments(6)
    for v in x.astype(float):
        whole.add(v)
    merged = whitening.Moments(6)
    for part in np.array_split(x, [0, 1, 30, 99]):
        state = whitening.Moments(6)
        for v in part.astype(float):
            state.add(v)
        state.sums += part.sum(0)
        merged.merge(state.n, state.mean, state.products, state.sums)
    for m in (whole, merged):
        assert m.n == 101 and np.allclose(m.mean, x.mean(0), rtol=1e-14)
        assert np.allclose(m.products / m.n, np.cov(x.T, bias=True), rtol=1e-10)
    assert (merged.sums == x.sum(0)).all()


def check_whitened(rows, got, d):
    xs = np.array(sorted({tuple(r[1]) for r in rows}))
    n, s = len(xs), xs.sum(0)
    v = np.cov(xs.T, bias=True).reshape(d, d)
    e, basis = np.linalg.eigh(v)
    e, basis = e[::-1], basis[:, ::-1]
    want = sorted(((r[0], i + 1, sum((n * a - int(b)) ** 2 for a, b in zip(r[1], s, strict=True)), (np.array(r[1]) - s / n) @ basis[:, i] / math.sqrt(e[i])) for r in rows for i in range(min(4, d))), key=lambda r: (repr(r[:3]), abs(r[3])))
    got = sorted(got, key=lambda r: (repr((r.vec_id, r.component, r.deviation)), abs(r.whitened)))
    assert [(r.vec_id, r.component, r.deviation) for r in got] == [w[:3] for w in want]
    for i in range(min(4, d)):
        a, b = np.array([r.whitened for r in got if r.component == i + 1]), np.array([w[3] for w in want if w[1] == i + 1])
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)
    assert all(r.n == n and abs(r.explained - e[r.component - 1] / np.trace(v)) < 1e-9 and r.identity_error < 1e-9 for r in got)


def test_whitening(spark, sf, odd):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    check_whitened(kept_ints([(r.vec_id, r.embedding, r.label) for r in table.collect()], 64, 256), whitening.op13_whitening(spark, sf).collect(), 64)
    got = whitening.whiten(odd.repartition(40))  # more states than are merged in one go
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitened(kept_ints(odd_vectors(), 16, 256), got.collect(), 16)
    assert whitening.whiten(odd.limit(0)).collect() == []


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {(r.component, r.whitened, r.explained, r.identity_error, r.deviation, r.n) for r in whitening.whiten(one).collect()} == {(1, 0.0, 0.0, 0.0, 0, 1), (2, 0.0, 0.0, 0.0, 0, 1)}
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(line).collect()}
    assert abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 2].whitened == 0 and got[1, 1].explained == 1 and got[1, 1].identity_error < 1e-12
    far = spark.createDataFrame([(i, [i * 1e7]) for i in range(3)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(far).collect()} == {None, 0}


def test_vectors_other_types(spark):
    table = spark.createDataFrame([(1, [1, 2]), (2, [1, None]), (3, None)], "vec_id long, embedding array<int>")
    rows, d = vectors.scaled(table, {"vec_id": "vec_id"}, "embedding", 256, 1 << 40)
    assert d == 2 and [tuple(r) for r in rows.collect()] == [(1, [256, 512])]


# 12

LONG = "the quick brown fox jumps over the lazy dog again"  # 49


def brute_lines(rows, least_chars=40, least_docs=5):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blanks))
    held = defaultdict(set)
    for i, (doc_id, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add((doc_id is not None, doc_id or 0, i))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < least_docs or (doc_id is not None, doc_id or 0, i) == max(held[key(x)])]
        out.append((doc_id, text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def odd_texts():
    rng = random.Random(7)
    pool = [LONG, LONG.upper() + " \t", "  " + LONG.title() + "\r", "É" * 39, "É" * 40, "É" * 40 + " ", "short", "", " " * 60, "x" * 40, "y" * 39 + "É", "z" * 45]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 9)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n"), (53, LONG), (54, "\n".join([LONG, "tail", LONG])), (None, LONG), (None, "one\n" + LONG), (60, "\n".join(f"line number {i} of a very long text that nobody else has" for i in range(3000)) + "\n" + LONG)]
    return rows


def test_lines_of_odd_rows(spark):
    rows = odd_texts()
    docs = spark.createDataFrame([(*r, "r", "h", 3) for r in rows], "doc_id long, text string, row string, hash string, line_dedup int").coalesce(1)
    for least, batches, fanout in ((5, 8, 4), (2, 5, 2), (1, 3, 3), (30, 1, 2)):
        got = line_runs.drop_lines(docs, least_docs=least, batches=batches, fanout=fanout)
        assert got.columns == [*docs.columns, "_line_dedup"]
        want = brute_lines(rows, least_docs=least)
        assert sorted(((r.doc_id, r.text, *r._line_dedup) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert line_runs.drop_lines(docs.limit(0)).count() == 0


def test_runs(spark):
    """Levels stay few, runs are sorted and met without a shuffle, settled hashes aren't added again, and order doesn't matter."""
    rng = random.Random(9)
    lines = [(i, f"h{rng.randint(0, 60)}" if rng.random() < 0.5 else f"u{i}") for i in range(1200)]
    table = spark.createDataFrame([(i, h.encode()) for i, h in lines], "row long, hash binary").withColumn("place", F.struct(F.col("row").alias("id"), "row"))
    want = defaultdict(list)
    for i, h in lines:
        want[h].append(i)
    for order in (range(12), reversed(range(12))):
        index = line_runs.LineRuns(spark, least=5, fanout=3)
        sizes = []
        for k in order:
            index.add(table.where(F.col("row").between(100 * k, 100 * k + 99)))
            sizes.append([len(level) for level in index.levels])
            assert all(n < 3 for n in sizes[-1])
        assert sizes[-1] == [0, 1, 1] and index.merged == 5
        youngest = spark.table(index.runs()[0])
        files = [[r.hash for r in spark.read.parquet(f).collect()] for f in youngest.inputFiles()]
        assert all(f == sorted(f) for f in files)
        got = {r.hash.decode(): (r.docs, r.last.row) for r in index.index().collect()}
        assert set(got) == set(want)
        for h, rows in want.items():
            n, last = got[h]
            assert last == max(rows) and (n == len(rows) if len(rows) < 5 else 5 <= n <= len(rows))
        index.close()
        assert index.runs() == []


def test_a_batch_meets_runs_by_merge_without_shuffling_them(spark):
    index = line_runs.LineRuns(spark, least=2, fanout=4)
    lines = spark.range(2000).select(F.col("id").alias("row"), F.unhex(F.md5((F.col("id") % 700).cast("string"))).alias("hash"), F.struct("id", F.col("id").alias("row")).alias("place"))
    lines = storage.stage(spark, lines, "lines")
    index.add(lines.where("row < 1500"))
    plans = []
    put = index._put
    index._put = lambda rows, level: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), put(rows, level))
    index.add(lines.where("row >= 1500"))
    plan = plans[0]
    assert plan.count("SortMergeJoin") == 1 and "LeftAnti" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 2  # both of the batch: its lines, then its hashes
    index.close()


def test_lines_past_memory_of_a_key(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = line_runs.drop_lines(docs)
    want = {r[0]: r[1:] for r in brute_lines([(r.doc_id, r.text) for r in docs.collect()])}
    assert all((r.text, *r.line_dedup) == want[r.doc_id] for r in got.collect())
    assert storage.numbered(docs)[0].count() == got.count()
