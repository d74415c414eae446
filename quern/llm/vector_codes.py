"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

Vectors become integers and are cut into parts; each part position has a codebook
of a few entries. By the reverse triangle inequality an entry nearer than the
current best distance r to a part p has a norm within r of p's norm. So the
entries are sorted by norm; the entry next in norm gives the first r; the
interval of norms within r is found by binary search, its ends included; only its
entries are evaluated, outwards, and whenever r shrinks the interval is searched
again. Distances are exact integers, so the outcome is that of evaluating every
entry, ties going to the lower index; norms are doubles with a slack over
their rounding, which can only widen the interval.

A round is one pass over the staged vectors: every task sums its parts by entry
(integers), Spark adds the tasks' sums, and the new codebooks (entries times
dimension, whatever the number of rows) return to the driver. Rows are never
shuffled by vector, so equal vectors, however many, are no task's burden. Lost
executors cost their tasks alone, as the vectors lie in shared storage.

Defined cases: rows whose vector is null, has null or non-finite components, or
has another dimension than most (or none that the number of parts divides) are
dropped; entries start as the parts of the smallest ids, ascending, null ids
last, rows of one id by their vectors; with fewer rows than entries the codebooks are
that much smaller; unused entries stay; repeated rows count one by one; a null
label is a label; an empty table gives an empty result; other columns,
whatever their names, are ignored. A scaled component beyond 2^26 stops the
query, as squared distances might not fit 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import storage
from quern.llm import vectors

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LARGEST = 1 << 26
SLACK = 1e-2  # norms are at most 2^26 times the root of the dimension; their rounding is far below this


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of ``x`` the nearest entry's index (ties: the lower) and squared
    distance; then how many distances were evaluated in all."""
    norm = np.sqrt((entries * entries).sum(1).astype(float))
    order = np.argsort(norm, kind="stable")
    norm = norm[order]
    own = np.sqrt((x * x).sum(1).astype(float))
    start = np.searchsorted((norm[1:] + norm[:-1]) / 2, own)  # the entry next in norm

    def distance(rows, found):
        apart = x[rows] - entries[found]
        return (apart * apart).sum(1)

    def annulus(rows):
        r = np.sqrt(best[rows].astype(float)) + SLACK
        return np.searchsorted(norm, own[rows] - r, "left"), np.searchsorted(norm, own[rows] + r, "right")

    every = np.arange(len(x))
    at = order[start]
    best = distance(every, at)
    lo, hi = annulus(every)
    evaluated = len(x)
    for step in range(1, len(norm)):
        for place in (start - step, start + step):
            rows = np.flatnonzero((place >= lo) & (place < hi))
            if not len(rows):
                continue
            found = order[place[rows]]
            d = distance(rows, found)
            evaluated += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (found < at[rows]))
            rows = rows[better]
            at[rows], best[rows] = found[better], d[better]
            lo[rows], hi[rows] = annulus(rows)
    return at, best, evaluated


def improve(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, position) after one round over all rows."""
    parts, entries, width = books.shape

    def sums(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in vectors.nonempty(batches):
            x = vectors.matrix(b, parts * width).reshape(-1, parts, width)
            for p in range(parts):
                at = nearest(x[:, p], books[p])[0]
                count[p] += np.bincount(at, minlength=entries)
                for e in np.unique(at):
                    total[p, e] += x[at == e, p].sum(0)
        used = np.flatnonzero(np.repeat(count.ravel(), width))
        yield pa.RecordBatch.from_pydict({"cell": used, "n": np.repeat(count.ravel(), width)[used], "total": total.ravel()[used]})

    found = rows.select("x").mapInArrow(sums, "cell long, n long, total long")
    new = books.copy().ravel()
    for cell, n, total in found.groupBy("cell").agg(F.sum("n"), F.sum("total")).collect():  # at most entries times dimension rows
        new[cell] = total // n
    return new.reshape(books.shape)


def fit(rows: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks of the scaled ``rows`` (``vec_id``, ``x``): the parts of the smallest ids, improved ``rounds`` times."""
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, d // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = improve(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with ``code`` (two hex digits a part) and ``error`` (squared distances summed) instead of ``x``."""
    parts, _, width = books.shape
    kept = [c for c in rows.columns if c != "x"]

    def coded(batches):
        for b in vectors.nonempty(batches):
            x = vectors.matrix(b, parts * width).reshape(-1, parts, width)
            found = [nearest(x[:, p], books[p])[:2] for p in range(parts)]
            codes = np.stack([at for at, _ in found], 1).astype(np.uint8)
            columns = {c: b.column(c) for c in kept}
            columns |= {"code": pa.array([row.tobytes().hex() for row in codes]), "error": pa.array(sum(e for _, e in found))}
            yield pa.RecordBatch.from_pydict(columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x")
    return rows.mapInArrow(coded, f"{fields}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code", scale: int = SCALE) -> DataFrame:
    """``codes`` with ``vector``, the entries that the code names, scaled back."""
    parts, _, _ = books.shape
    tables = F.array(*[F.array(*[F.array(*[F.lit(float(v) / scale) for v in e]) for e in p]) for p in books])
    digits = [F.conv(F.substring(F.col(code_col), 2 * p + 1, 2), 16, 10).cast("int") for p in range(parts)]
    return codes.withColumn("vector", F.flatten(F.array(*[F.get(F.get(tables, F.lit(p)), digits[p]) for p in range(parts)])))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """``vec_id``, ``label``, ``code`` and ``error`` of every usable row, and the codebooks (None without rows)."""
    rows, d = vectors.scaled(table, {"vec_id": id_col, "label": label_col}, vec_col, SCALE, LARGEST, PARTS)
    if not d:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    books = fit(rows, d)
    return encode(rows, books), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Code and errors of every usable row of ``embeddings``."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = storage.stage(spark, coded.withColumn("of", F.struct("label")), "codes")
    by_label = storage.stage(spark, coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label_errors")
    out = storage.lookup(coded, by_label, "of", coded.count(), "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books) if books is not None else "").alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by evaluating every entry of every part, round by round."""
    assigned = """SELECT rid, part, y, entry, d FROM (
      SELECT p.rid, p.part, p.y, b.entry, list_sum(list_transform(range(1, len(p.y) + 1), lambda j: (p.y[j] - b.c[j]) * (p.y[j] - b.c[j]))) AS d,
             row_number() OVER (PARTITION BY p.rid, p.part ORDER BY list_sum(list_transform(range(1, len(p.y) + 1), lambda j: (p.y[j] - b.c[j]) * (p.y[j] - b.c[j]))), b.entry) AS nth
      FROM p JOIN b{r} b USING (part)) WHERE nth = 1"""
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({assigned.format(r=r)})")
        steps.append(f"""b{r + 1} AS MATERIALIZED (
      SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
        SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (
          SELECT part, entry, j, sum(y[j]) AS s, count(*) AS n FROM (SELECT part, entry, y, unnest(range(1, len(y) + 1)) AS j FROM a{r}) GROUP BY ALL)
        GROUP BY ALL) m USING (part, entry))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT rid, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS y FROM (SELECT rid, x, unnest(range({parts})) AS part FROM v)
), b0 AS MATERIALIZED (
  SELECT part, entry, y AS c FROM p JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS entry FROM v) USING (rid) WHERE entry < {entries}
), {", ".join(steps)}, f AS MATERIALIZED ({assigned.format(r=rounds)}
), h AS (
  SELECT sha256(string_agg(CAST(c[j] AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256
  FROM (SELECT part, entry, c, unnest(range(1, len(c) + 1)) AS j FROM b{rounds})
), e AS (
  SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (rid), h
"""


OP11_SQL = _sql()
