"""Toxic passages by maximum-scoring segment search.

Fit. Each word and each stem (a word's first ``STEM`` characters), hashed into
``BUCKETS``, gets the log-odds of occurring in a toxic against a clean labelled
text, both rates smoothed by a Dirichlet prior with the pooled rate as mean and
``PRIOR`` texts as weight. Log-odds whose likelihood ratio could be chance among
so many buckets (G2 under 2 ln of their number) become 0; a word without a score
of its own takes its stem's. Every word pays ``DRIFT``, so the expected score of
clean text is negative. Equal training texts count
once. Words are counted in the tasks and summed by bucket, so the driver gets
one row a bucket at most.

Search. The linear-time scan of Ruzzo and Tompa yields all disjoint maximal
segments of a text. By Karlin and Altschul the best of a clean text of n words
exceeds S with probability 1 - exp(-K n exp(-lambda S)); lambda and K are
fitted to clean training texts by maximum likelihood. A segment is significant
if its expected number K n exp(-lambda S) is at most ``E_VALUE``. The score of
a text is a logistic function of the best segment's calibrated excess and of
the summed excess of all significant ones, fitted on texts that had no part in
the word table applied to them (two folds).

Bounds: at most ``MAX_FIT`` labelled ids, the first by hash of id, and of their
different texts at most ``MAX_FIT``, the first by hash of text, are used to fit (a
documented sample; rows of one id may have several texts, so both are bounded);
everything else covers every text, and fitting sees all segments of a text as scoring does.

Defined cases: null and empty texts have no segment and get the score of a text
without any; of several labels of one id the largest counts; null labels and
null ids are no labels; without labels of both classes every score is 0; repeated
rows are scored alike; a text of any length is scanned whole, in time and memory
linear in its length; an empty table gives an empty result; other columns, whatever
their names, are ignored, or kept by ``score`` and ``drop_toxic``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from quern import storage

BUCKETS = 1 << 20
STEM = 4
PRIOR = 20.0
DRIFT = 0.5
E_VALUE = 0.05
LEAST = -20.0  # excess of a text without segments
MAX_FIT = 60_000
FOLDS = 2
#: Words whose buckets a task remembers at most.
CACHE = 200_000
#: Texts answered at a time.
SOME = 128

_WORD = re.compile(r"\w+")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def stem_bucket(word: str) -> int:
    return bucket("^" + word[:STEM])


class Scores(dict):
    """Word to score, looked up by bucket once a word."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE:
            self.clear()
        s = self[word] = float(self.table[bucket(word)] or self.table[stem_bucket(word)]) - DRIFT
        return s


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), left to right.

    Runs of positive scores are taken as one step. ``below[k]`` links to the last
    earlier candidate whose left sum is less, so each search follows links that
    are never followed again: linear time.
    """
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], up.view(np.int8), [0]))))
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    start, end, left, right, below = [], [], [], [], []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        lo, hi = float(total[a]), float(total[b])
        while True:
            j = len(start) - 1
            while j >= 0 and left[j] >= lo:
                j = below[j]
            if j < 0 or right[j] >= hi:
                break
            a, lo = start[j], left[j]  # merge with candidate j and all after it
            del start[j:], end[j:], left[j:], right[j:], below[j:]
        start.append(a)
        end.append(b)
        left.append(lo)
        right.append(hi)
        below.append(j)
    return [(s, e, r - x) for s, e, x, r in zip(start, end, left, right, strict=True)]


@dataclass
class Model:
    tables: np.ndarray  # a row of scores for each fold left out, the last for all
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, ...] | None = None  # None: no labels of both classes

    def features(self, n: int, segments) -> tuple[float, float]:
        """Calibrated excess of the best segment, and log of the summed excess of the significant."""
        base = np.log(self.k * max(n, 1))
        excess = [self.lam * s - base for _, _, s in segments]
        floor = -np.log(E_VALUE)
        return max([LEAST, *excess]), float(np.log1p(sum(x for x in excess if x >= floor)))

    def score(self, n: int, segments) -> float:
        if self.weights is None:
            return 0.0
        x = self.features(n, segments)
        w = self.weights
        return float(1 / (1 + np.exp(-np.clip(w[0] + w[1] * x[0] + w[2] * x[1], -50, 50))))

    def expected(self, n: int, score: float) -> float:
        return float(self.k * max(n, 1) * np.exp(-self.lam * score))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``toxic``, ``fold`` and ``text`` of the labelled rows that may be learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(MAX_FIT)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "_id")
    return rows.select("toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), F.xxhash64("text").alias("copy"), "text")


def word_counts(train: DataFrame) -> DataFrame:
    """Texts that have a bucket, by fold and class; bucket -1 has the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cache = np.zeros((FOLDS * 2, BUCKETS + 1), np.int64), {}
        for b in batches:
            for toxic, fold, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                row, words = n[2 * fold + (toxic > 0)], set(_WORD.findall(cell.as_py().lower()))
                ids = {x for w in words for x in (cache[w] if w in cache else cache.setdefault(w, (bucket(w), stem_bucket(w))))}
                row[np.fromiter(ids, np.int64, len(ids))] += 1
                row[BUCKETS] += 1
                if len(cache) > CACHE:
                    cache.clear()
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == BUCKETS, -1, at)), *[pa.array(x[at]) for x in n]], ["bucket", *[f"n{i}" for i in range(FOLDS * 2)]])

    counts = train.select("toxic", "fold", "text").mapInArrow(run, "bucket long, " + ", ".join(f"n{i} long" for i in range(FOLDS * 2)))
    counts = counts.groupBy("bucket").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(FOLDS * 2)])
    return counts.where((F.col("bucket") < 0) | (sum(F.col(f"n{i}") for i in range(FOLDS * 2)) > 1))  # one text proves nothing


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Smoothed log-odds of each bucket, 0 where they could be chance."""
    n, share = toxic + clean, n_toxic / max(n_toxic + n_clean, 1)
    pooled = n / max(n_toxic + n_clean, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log((toxic + PRIOR * pooled) / (n_toxic + PRIOR)) - np.log((clean + PRIOR * pooled) / (n_clean + PRIOR))
        ratio = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (n * share)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - share))), 0))
    sure = (n > 1) & (ratio >= 2 * np.log(max((n > 1).sum(), 2)))
    return np.where(sure, odds, 0.0).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    spark = docs.sparkSession
    storage.small_batches(spark)
    train = training_rows(docs, labels, id_col, text_col)
    once = train.groupBy("copy").agg(F.max("toxic").alias("toxic"), F.first("fold").alias("fold"), F.first("text").alias("text"))
    staged = once = storage.stage(spark, once, "training")
    if once.count() > MAX_FIT:  # ids with several texts
        last = once.select("copy").orderBy("copy").limit(MAX_FIT).agg(F.max("copy")).first()[0]
        once = once.where(F.col("copy") <= last)
    got = word_counts(once).toPandas()
    n = np.zeros((FOLDS, 2, BUCKETS), np.int64)
    size = np.zeros((FOLDS, 2), np.int64)
    for i in range(FOLDS * 2):
        col = got[f"n{i}"].to_numpy()
        rows = got.bucket.to_numpy()
        n[i // 2, i % 2, rows[rows >= 0]] = col[rows >= 0]
        size[i // 2, i % 2] = col[rows < 0].sum()
    keep = [[f for f in range(FOLDS) if f != out] for out in range(FOLDS)] + [list(range(FOLDS))]
    tables = np.stack([log_odds(n[f, 1].sum(0), n[f, 0].sum(0), size[f, 1].sum(), size[f, 0].sum()) for f in keep])
    model = Model(tables)
    if not size.sum(0).all():
        return model
    seen = segment_rows(once, model)
    best = seen.select("toxic", "n", "best").toPandas().sort_values(["n", "best", "toxic"])  # at most MAX_FIT rows, in one order
    clean = best[best.toxic <= 0]
    model.lam, model.k = fit_extremes(clean.best.to_numpy(), np.maximum(clean.n.to_numpy(), 1))
    base = F.log(F.lit(model.k) * F.greatest("n", F.lit(1)))
    excess = F.transform("parts", lambda s: s * model.lam - base)
    sure = F.aggregate(F.filter(excess, lambda x: x >= -float(np.log(E_VALUE))), F.lit(0.0), lambda a, x: a + x)
    x = seen.select("toxic", F.greatest(F.lit(LEAST), F.array_max(excess)).alias("best"), F.log1p(sure).alias("sum")).toPandas()
    x = x.sort_values(["toxic", "best", "sum"])  # one order of summation, whatever the partitions
    model.weights = fit_logistic(x[["best", "sum"]].to_numpy(), x.toxic.to_numpy() > 0)
    storage.discard(spark, staged)
    storage.discard(spark, seen)
    return model


def segment_rows(train: DataFrame, model: Model) -> DataFrame:
    """Staged: words, best score and all segment scores of each training text under the table of its fold."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(model.tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [Scores(t) for t in shared.value]
        for b in batches:
            out = []
            for fold, cell in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                words = _WORD.findall(cell.as_py().lower())
                s = np.array([scores[fold][w] for w in words])
                out.append((len(words), [x for _, _, x in maximal_segments(s)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array([max(p, default=0.0) for _, p in out], pa.float64()), pa.array([p for _, p in out], pa.list_(pa.float64()))], ["toxic", "n", "best", "parts"])

    return storage.stage(spark, train.select("toxic", "fold", "text").mapInArrow(run, "toxic int, n long, best double, parts array<double>"), "segments")


def fit_extremes(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and K of the extreme-value law of clean texts: the likelihood's maximum over a grid of lambda, K in closed form."""
    lams = np.exp(np.linspace(np.log(0.05), np.log(3.0), 60))
    fits = []
    for lam in lams:
        e = n * np.exp(-lam * best)
        k = len(n) / e.sum()
        fits.append((np.sum(np.log(lam * k * n) - lam * best - k * e), lam, k))
    return max(fits)[1:]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton's method with a small ridge on the slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pen, x.T @ (y - p) - pen @ w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def original_places(text: str, lowered: str) -> list[int] | None:
    """For each place in ``lowered`` that in ``text``; None if they are the same."""
    if len(text) == len(lowered):
        return None
    out = [i for i, c in enumerate(text) for _ in c.lower()]
    return [*out, len(text)]


def score(docs: DataFrame, model: Model, text_col: str = "text", output: str = "toxicity") -> DataFrame:
    """``docs`` with ``output`` (a column of that name is replaced): score, predicted, and the significant passages
    (start, stop in code points of the text, score, expected number by chance)."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    shared = spark.sparkContext.broadcast((model.tables[-1], model.lam, model.k, model.weights))
    kind = "struct<score:double,predicted:int,passages:array<struct<start:bigint,stop:bigint,score:double,expected:double>>>"
    shape = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("passages", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])))])
    if text_col == output:
        raise ValueError("the output would replace the text")
    rows = docs.drop(output)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lam, k, weights = shared.value
        m, words_to = Model(table[None], lam, k, weights), Scores(table)
        for b in (whole.slice(i, SOME) for whole in batches for i in range(0, whole.num_rows, SOME)):
            out = []
            for cell in b.column(at):
                text = cell.as_py() or ""
                lowered = text.lower()
                words = _WORD.findall(lowered)
                found = maximal_segments(np.array([words_to[w] for w in words]))
                value = m.score(len(words), found)
                marked = [(s, e, x) for s, e, x in found if m.expected(len(words), x) <= E_VALUE] if weights else []
                if marked:
                    spans, back = [w.span() for w in _WORD.finditer(lowered)], original_places(text, lowered)
                    first = lambda i: back[i] if back else i  # noqa: B023, E731
                    marked = [{"start": first(spans[s][0]), "stop": first(spans[e - 1][1] - 1) + 1, "score": x, "expected": m.expected(len(words), x)} for s, e, x in marked]
                out.append({"score": value, "predicted": int(value >= 0.5), "passages": marked})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, shape)], names=[*b.schema.names, output])

    schema = StructType([*rows.schema.fields, StructField(output, DataType.fromDDL(kind))])
    return rows.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that aren't predicted toxic, with all their columns."""
    name = storage.free_name(docs.columns, "_quern_toxicity")
    return score(docs, fit(docs, labels, id_col, text_col), text_col, name).where(f"{name}.predicted = 0").drop(name)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "toxicity.score", "toxicity.predicted")
