"""Evaluation metrics over tables of model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import storage
from quern.functions import text as t


def proportion(rows: DataFrame, by: str, flag: Column, length: Column | None = None) -> DataFrame:
    """Share, its binomial standard error, count and mean ``length``, by group and pooled (group null)."""
    p = F.avg(flag.cast("int"))
    mean = [] if length is None else [F.avg(length).alias("mean_length")]
    return rows.rollup(by).agg(F.count("*").alias("n"), p.alias("share"), *mean).withColumn("se", F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("n")))


def log_likelihood(logprobs: Column, top: Column, tokens: Column) -> tuple[Column, Column]:
    """Sum of the continuation's log-probabilities, and whether each token was the likeliest (missing places don't count against it)."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    greedy = F.forall(F.zip_with(top, tokens, lambda a, b: a.isNull() | (a == b)), lambda x: x)
    return total, greedy


def perplexity(loss: Column, n: Column) -> Column:
    """Of summed losses over summed tokens; not a mean of means."""
    return F.exp(F.sum(loss) / F.greatest(F.sum(n), F.lit(1)))


def ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def common(one: Column, two: Column) -> Column:
    """How many elements two arrays have in common, each as often as in the array that has it less:
    both are sorted together and their runs counted in one pass."""
    side = lambda xs, k: F.transform(xs, lambda x: F.struct(x.alias("g"), F.lit(k).alias("side")))
    runs = F.sort_array(F.concat(side(one, 0), side(two, 1)))  # of equal elements the first array's come first
    start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("open"), F.lit(0).cast("long").alias("met"))

    def step(a: Column, x: Column) -> Column:
        left = F.when(a["g"].eqNullSafe(x["g"]), a["open"]).otherwise(0)
        first, meets = x["side"] == 0, (x["side"] == 1) & (left > 0)
        return F.struct(x["g"].alias("g"), F.when(first, left + 1).when(meets, left - 1).otherwise(left).alias("open"), (a["met"] + meets.cast("long")).alias("met"))

    return F.aggregate(runs, start, step, lambda a: a["met"])


def bleu(rows: DataFrame, hyp: str, ref: str, order: int = 4) -> DataFrame:
    """Corpus BLEU of two word arrays: clipped n-gram matches and totals of the corpus,
    exponential smoothing of empty orders, brevity penalty. Matches are counted within
    a row, in time of a sort of its words, so the corpus is one sum and nothing is
    shuffled. A null counts as no words."""
    h, r = F.col("h"), F.col("r")
    parts = rows.select(F.coalesce(F.col(hyp), F.array()).alias("h"), F.coalesce(F.col(ref), F.array()).alias("r"))
    sums = [x for n in range(1, order + 1) for x in (F.sum(common(ngrams(h, n), ngrams(r, n))).alias(f"m{n}"), F.sum(F.greatest(F.size(h) - (n - 1), F.lit(0))).alias(f"t{n}"))]
    got = parts.agg(*sums, F.sum(F.size("h")).alias("hyp_len"), F.sum(F.size("r")).alias("ref_len"))
    total, empty = F.lit(0.0), F.lit(0)
    for n in range(1, order + 1):
        none = F.coalesce(F.col(f"m{n}"), F.lit(0)) == 0
        empty = empty + none.cast("int")
        total = total + F.log(F.when(none, 1 / (F.pow(F.lit(2.0), empty) * F.greatest(f"t{n}", F.lit(1)))).otherwise(F.col(f"m{n}") / F.col(f"t{n}")))
    brevity = F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.col("ref_len") / F.greatest("hyp_len", F.lit(1))))
    return got.select((100 * brevity * F.exp(total / order)).alias("bleu"), F.col("hyp_len").cast("long").alias("hyp_len"), F.col("ref_len").cast("long").alias("ref_len"))


def words_13a(c: Column) -> Column:
    """The words that the 13a tokenisation of translation scoring gives."""
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return t.words(_split_marks(F.concat(F.lit(" "), c, F.lit(" "))))


# The code points that the Chinese tokenisation of translation scoring sets apart. The first two ranges are meant
# to be U+20000 to U+2A6D6 and U+2F800 to U+2FA1D, but are read with four digits and a further character by that scorer.
CHINESE = (
    (0x2001, 0x2A6D), (0x2F81, 0x2FA1), (0x3400, 0x4DB5), (0x4E00, 0x9FA5), (0x9FA6, 0x9FBB), (0xF900, 0xFA2D), (0xFA30, 0xFA6A), (0xFA70, 0xFAD9),
    (0xFF00, 0xFFEF), (0x2E80, 0x2EFF), (0x3000, 0x303F), (0x31C0, 0x31EF), (0x2F00, 0x2FDF), (0x2FF0, 0x2FFF), (0x3100, 0x312F), (0x31A0, 0x31BF),
    (0xFE10, 0xFE1F), (0xFE30, 0xFE4F), (0x2600, 0x26FF), (0x2700, 0x27BF), (0x3200, 0x32FF), (0x3300, 0x33FF),
)


def words_zh(c: Column) -> Column:
    """Chinese characters and marks one by one, the rest as in 13a."""
    apart = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CHINESE)
    return t.words(_split_marks(F.regexp_replace(c, f"([{apart}])", " $1 ")))


def _split_marks(c: Column) -> Column:
    # The rules of the 13a tokenisation, in order.
    for rule, new in (("([\\{-~\\[-` -&\\(-+:-@/])", " $1 "), ("([^0-9])([.,])", "$1 $2 "), ("([.,])([^0-9])", " $1 $2"), ("([0-9])(-)", "$1 $2 ")):
        c = F.regexp_replace(c, rule, new)
    return c


def nucleus(rows: DataFrame, by: str, weight: str, tie: str, top_p: float) -> DataFrame:
    """``rows`` with ``p``, the share of ``weight`` in its group, and ``before``, the probability of
    likelier candidates: those that are kept while it is under ``top_p``. Candidates are ranked in ranges
    (`storage.running`), so a group may have any number of them."""
    total = rows.groupBy(F.col(by).alias("_of")).agg(F.sum(weight).alias("_total"))
    shares = rows.join(total, F.col(by).eqNullSafe(F.col("_of"))).select(*rows.columns, (F.col(weight) / F.col("_total")).alias("p"))
    ranked = storage.running(storage.stage(rows.sparkSession, shares, "candidates"), [by], ["-p", tie], ("p",), at="_at")
    return ranked.withColumnRenamed("p_before", "before").drop("_at").where(F.col("before") < top_p)


def ema(rows: DataFrame, by: str, order: str, value: str, keep: float = 0.9) -> DataFrame:
    """Exponential mean at the end of each series, seeded by its first value: a weighted sum over
    places counted from the end, so a long series needn't fit a task."""
    series = rows.select(by, order, value)
    first = series.groupBy(by).agg(F.count("*").alias("_n"))
    back = storage.running(storage.stage(rows.sparkSession, series.join(first, by), "series"), [by], [f"-{order}"], at="_back")
    weight = F.pow(F.lit(keep), "_back") * F.when(F.col("_back") == F.col("_n") - 1, 1.0).otherwise(1 - keep)
    return back.groupBy(by).agg(F.sum(weight * F.col(value)).alias("ema"))


def ema_curve(rows: DataFrame, by: list[str], order: str, value: str, keep: float = 0.9) -> DataFrame:
    """``rows`` (``by``, the unique ``order``, ``value``) with ``ema``, the exponential mean up to each row, seeded by a series' first value.

    Series are sorted in ranges. A range passes its rows once with nothing carried, and says how much
    of a carried mean its rows would keep and what they add; these pairs are composed over the
    ranges of a series (as many as shuffle partitions, whatever the rows), so one
    series may hold all rows."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(*by, order, F.col(value).cast("double").alias(value))
    dealt = rows.repartitionByRange(n, *[F.col(c) for c in [*by, order]]).withColumn("_part", F.spark_partition_id())
    dealt = storage.stage(spark, dealt, "series")

    def local(frames):
        now, mean, share = None, 0.0, 1.0
        for f in frames:
            means, shares = [], []
            keys = list(zip(f["_part"].tolist(), *[f[c].tolist() for c in by], strict=True))
            for key, x in zip(keys, f[value].tolist(), strict=True):
                if key != now:
                    now, mean, share = key, 0.0, 1.0
                mean, share = keep * mean + (1 - keep) * x, keep * share
                means.append(mean)
                shares.append(share)
            yield f.assign(_mean=means, _share=shares)

    inner = dealt.repartition(n, "_part").sortWithinPartitions("_part", *by, order)
    inner = storage.stage(spark, inner.mapInPandas(local, dealt.schema.add("_mean", "double").add("_share", "double")), "local_means")
    ends = inner.groupBy("_part", *by).agg(F.max_by(F.struct("_mean", "_share"), order).alias("end"), F.min_by(value, order).alias("first"))
    series = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", "end", "first"))).alias("ends"))
    start = F.struct(F.get("ends", F.lit(0))["first"].alias("mean"), F.array().cast("array<double>").alias("carried"))
    after = lambda a, e: F.struct((e["end"]["_mean"] + e["end"]["_share"] * a["mean"]).alias("mean"), F.concat(a["carried"], F.array(a["mean"])).alias("carried"))
    series = series.withColumn("carried", F.aggregate("ends", start, after, lambda a: a["carried"]))
    carried = series.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.explode(F.arrays_zip("ends", "carried")).alias("x"))
    carried = carried.select(*[f"_by{i}" for i in range(len(by))], F.col("x.ends._part").alias("_of"), F.col("x.carried").alias("_carried"))
    same = [F.col("_part") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]]
    return inner.join(carried, same).select(*by, order, value, (F.col("_mean") + F.col("_share") * F.col("_carried")).alias("ema"))


def best_so_far(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with ``best``, the least value up to each row, and ``new_low`` where it is below all before; in ranges."""
    got = storage.running(storage.stage(rows.sparkSession, rows, "series"), by, [order], at="_at", least=(value,))
    low = F.col(f"{value}_least")
    return got.select(*rows.columns, F.least(F.col(value), low).alias("best"), F.coalesce(F.col(value) < low, F.col(value).isNotNull()).alias("new_low"))


def learning_rate(step: Column, warm: int, total: int, floor: float, shape: str = "cosine", decay: int = 0) -> Column:
    """Factor of the peak rate: linear warm-up from 0, then cosine, linear, or held until the last
    ``decay`` steps (a tenth of all if 0) and lowered to ``floor``; it stays there past the end."""
    share = F.least(F.lit(1.0), (step - warm) / max(1, total - warm))
    if shape == "cosine":
        after = floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * share))
    elif shape == "linear":
        after = F.greatest(F.lit(floor), 1 - share * (1 - floor))
    elif shape == "wsd":
        decay = decay or max(1, total // 10)
        after = F.when(step < total - decay, 1.0).otherwise(floor + (1 - floor) * (1 - F.least(F.lit(1.0), (step - (total - decay)) / max(1, decay))))
    else:
        raise ValueError(f"unknown schedule {shape!r}")
    return F.when(step < warm, step / max(1, warm)).otherwise(after)


def momentum(step: Column, warm: int, start: float, end: float) -> Column:
    """Linear from ``start`` to ``end`` in ``warm`` steps."""
    return F.lit(end) if warm <= 0 else start + F.least(F.lit(1.0), step / warm) * (end - start)


def masked_loss(loss: Column, valid: Column) -> Column:
    """Summed loss of the valid places over their number (1 at least)."""
    return F.sum(F.when(valid, loss).otherwise(0.0)) / F.greatest(F.sum(valid.cast("int")), F.lit(1))


def padding(length: Column, width: Column) -> Column:
    """Share of the places of padded rows that hold padding."""
    return 1 - F.sum(length) / F.greatest(F.sum(width), F.lit(1))


def tokens_per_char(tokens: Column, text: Column) -> Column:
    return F.sum(tokens) / F.greatest(F.sum(F.char_length(text)), F.lit(1))


def spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Range and sample deviation over repeated runs."""
    return rows.groupBy(by).agg(F.count("*").alias("runs"), (F.max(value) - F.min(value)).alias("range"), F.stddev(value).alias("sd"))


def throughput(rows: DataFrame, by: str, at: str, units: Column) -> DataFrame:
    """Units a second between a group's first and last record; null if no time has passed."""
    got = rows.groupBy(by).agg(F.sum(units).alias("units"), F.timestamp_diff("MICROSECOND", F.min(at), F.max(at)).alias("us"))
    return got.select(by, "units", (F.col("us") / 1e6).alias("seconds"), F.when(F.col("us") > 0, F.col("units") / (F.col("us") / 1e6)).alias("rate"))


def stop_check(rows: DataFrame, by: str, said: Column, used: Column, budget: int, ends: Column) -> DataFrame:
    """How often the engine's word and the heuristic (budget left, or a stop token last) disagree on a natural stop."""
    guess = (used < budget) | ends
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(said.cast("int")).alias("stopped"), F.sum((said != guess).cast("int")).alias("disagree"))


def first_batches(rows: DataFrame, key: str, size: int, most: int) -> DataFrame:
    """The rows of the first ``most`` batches of a capped evaluation."""
    return rows.orderBy(key).limit(size * most)


def retained(steps: DataFrame, last: int, every: int) -> DataFrame:
    """Checkpoints kept: the last ones and the milestones; ``last`` of 0 or less keeps all."""
    if last <= 0:
        return steps
    newest = steps.orderBy(F.col("step").desc()).limit(last)
    return newest.union(steps.where(F.col("step") % every == 0)).distinct() if every > 0 else newest
