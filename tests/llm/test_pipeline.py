"""The pipeline, stage by stage, against what each stage must keep."""

import re

import corpus_pipeline
from quern import storage
from quern.llm import mixing, simhash, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = storage.stage(spark, stage(spark, docs, sf), name)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
    assert {norm(r) for r in kept["exact_dedup"]} == {norm(r) for r in kept["toxicity"]}
    assert len(kept["exact_dedup"]) == len({norm(r) for r in kept["toxicity"]})
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    scored = toxicity.score(whole, toxicity.fit(whole, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    assert {r.doc_id for r in kept["toxicity"]} == {r.doc_id for r in scored if not r.toxicity.predicted}
    assert {r.doc_id for r in kept["simhash_near_dedup"]} <= {r.doc_id for r in kept["exact_dedup"]}
    plan = mixing.plan(storage.stage(spark, spark.createDataFrame(kept["simhash_near_dedup"], docs.sparkSession.read.parquet(f"{sf}/documents.parquet").schema), "again")).collect()
    want = sorted(r.doc_id for r in plan for _ in r.copies)
    assert sorted(r.doc_id for r in kept["mixing"]) == want
    check_rows(kept["packing"], len(kept["mixing"]))


def test_odd_and_empty_tables(spark, sf, tmp_path):
    """Every stage on nulls, blanks, repeats, a long text and clashing names, and on no rows."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, _quern_row long, row long, toxicity string"
    odd = [(1, "Some words that come twice here.", "en", "a", 1), (1, "Some words that come twice here.", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t", "en", "b", 2), (None, "No id at all in this one.", "en", None, 1), (5, "long word " * 30_000, "fr", "a", 1), (6, "a" + " " * 100_000 + "b", "en", "b", 1)]
    for rows in ([(*r, i, 9, "x") for i, r in enumerate(odd)], []):
        docs = spark.createDataFrame(rows, kind)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = storage.stage(spark, stage(spark, docs, sf), name)
            if name != "packing":
                assert docs.columns == columns
        assert (docs.count() > 0) == bool(rows)


def test_near_dedup_equals_brute_force(spark, sf):
    docs = storage.stage(spark, corpus_pipeline.drop_copies(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), "docs")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert len({i for i, _ in rows}) == len(rows)
    sets = [simhash.shingle_set(t, 5) for _, t in rows]
    prints = [simhash.fingerprint(t, 5) % (1 << 64) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    want = {rows[i][0] for i in set(root)}  # the least id of each component
    assert len(want) < len(rows)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} == want


def check_rows(rows, documents):
    """Gapless sequences of at most 1024 tokens that hold every document."""
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert sum(r.piece == 0 for r in rows) == documents
