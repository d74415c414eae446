"""The registered queries that SQL can't express, held to their columns' definitions on the smallest tables."""

import hashlib
import random
import re
import shutil
import zlib

import pytest
from pyspark.sql import functions as F
from test_llm import spec_components, spec_fingerprint

from quern.llm import kd_shards, mixing, pii, quality, simhash, toxicity

BLANK = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def test_op2(spark, sf, docs, tmp_path):
    """Labels of held-out rows, lang and source have no part in any score."""
    shutil.copytree(sf, tmp_path / "t", ignore=lambda _, names: [n for n in names if n not in ("documents.parquet", "labels.parquet")])
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast(labels.schema["toxic"].dataType))
    flipped.write.parquet(str(tmp_path / "other" / "labels.parquet"))
    table = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"lang": F.lit("xx"), "source": F.lit("none")})
    table.write.parquet(str(tmp_path / "other" / "documents.parquet"))
    rows = {r.doc_id: r for r in toxicity.op2_toxicity(spark, sf).collect()}
    assert set(rows) == {d.doc_id for d in docs} and len(rows) == len(docs)
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    again = {r.doc_id: r.score for r in toxicity.op2_toxicity(spark, str(tmp_path / "other")).collect()}
    assert again == pytest.approx({i: r.score for i, r in rows.items()}, abs=1e-9)


def test_op4(spark, sf, docs):
    rows = kd_shards.op4_kd_shards(spark, sf).collect()
    want = {d.doc_id: (len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == want and len(rows) == len(docs)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    slots, held = {}, dict.fromkeys(range(40), 0)
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        held[r.shard] += r["size"]
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, most = sum(held.values()) / 40, max(s for s, _ in want.values())
    assert all(abs(x - mean) <= most for x in held.values())


def test_op6(spark, sf, docs):
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, sf).collect()}
    ids, prints = [d.doc_id for d in docs], [spec_fingerprint(d.text) for d in docs]
    roots = spec_components(ids, prints)
    assert rows == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, roots, strict=True)}


def test_op7(spark, sf, docs):
    # fixed values: the contract's patterns, in its order
    form = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def digits(x):
        return [int(c) for c in x if c in "0123456789"]

    def luhn(d):
        return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0

    passes = {
        "email": lambda x: True,
        "ip": lambda x: all(int(p) <= 255 for p in x.split(".")),
        "card": lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x)),
        "phone": lambda x: 8 <= len(digits(x)) <= 15,
    }
    rows = {r.doc_id: r for r in pii.op7_pii(spark, sf).collect()}
    assert len(rows) == len(docs) and sum(r.n_email for r in rows.values()) > 0
    for d in docs:
        spans = {k: [m.span() for m in re.finditer(p, d.text or "") if passes[k](m[0])] for k, p in form.items()}
        base = [f"{k}:{a}:{b}" for k in form for a, b in spans[k]]
        r = rows[d.doc_id]
        assert [r[f"n_{k}"] for k in form] == [len(spans[k]) for k in form]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = [s.split(":") for s in r.spans.split(",") if s]
        assert [":".join(s) for s in every if s[0] in form] == base
        assert all(int(a) < int(b) <= len(d.text) for _, a, b in every)
        assert all(x[0] != y[0] or int(x[1]) < int(y[1]) for x, y in zip(every, every[1:], strict=False))


def test_op8(spark, sf, docs):
    rows = {r.doc_id: r for r in mixing.op8_mixing(spark, sf).collect()}
    size = {d.doc_id: len(re.findall(BLANK, d.text or "")) for d in docs}
    names = sorted({d.source for d in docs}, key=lambda s: (s is None, s or ""))
    held = {s: sum(size[d.doc_id] for d in docs if d.source == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 2.0 * sum(held.values())
    for _ in range(200):  # the level at which capped shares add up
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 2 * held[s]) for s in names) < 1.5 * sum(held.values()) else (low, level)
    goal = {s: min(high * weight[s], 2 * held[s]) for s in names}
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d.doc_id]
        assert (r["size"], r.source_size) == (size[d.doc_id], held[d.source]) and r.target == pytest.approx(goal[d.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
    for s in names:
        own = [d.doc_id for d in docs if d.source == s]
        assert abs(sum(rows[i].taken for i in own) - goal[s]) <= max(size[i] for i in own)


def test_op10_windows_of_equal_hash(spark, monkeypatch):
    """With two hashes in all, unlike windows meet in nearly every text, and words are compared."""
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(2)))
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("ab" if i % 2 else "abcdefg", k=rng.randint(0, 120)))) for i in range(60)]
    rows += [(60, "a b c d e f g h " * 9), (61, " ".join(f"w{k}" for k in range(90)))]
    covered = {}
    for i, x in rows:
        w, seen = x.split(), {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        covered[i] = len({p for s in seen.values() if len(s) > 1 for k in s for p in range(k, k + 8)})
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.quality.n_repeat_words for r in got} == covered and covered[60] == 72 and covered[61] == 0
