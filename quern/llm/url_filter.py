"""URL filter: rules first, then trust and distrust over the host graph.

Hosts whose pages a rule allows are trusted seeds, hosts whose pages a rule
blocks are distrusted ones, each weighted by its share of all pages. Trust runs
along host edges by personalised PageRank, distrust against them (who links to
a blocked host is suspect). Edges are the links of the pages that name a host, and the
steps between a host and its parent domain, both ways. A host whose distrust is
at least ``RATIO`` times its trust, and not 0, is blocked where no rule decides;
masses that miss the ratio by a billionth, as sums in another order may, are at it.

Masses are the first ``ROUNDS`` terms of the series of walks from the seeds. What
is left out is at most ``DAMPING ** ROUNDS`` (3e-5) of the seeds' mass on any graph.
While the paths of two steps are at most ``FEW_PATHS`` (counted first), a step of
twice the length is made of them and doubles the terms summed; rounds with the
longest step made add the rest. The sum is the same either way.

All steps are DataFrame operations: links are counted per pair of hosts before
anything iterates, masses are written to shared storage on the way, hosts with a
large share of all edges get their mass by broadcast (`storage.HOT_KEYS` at
most), masses of earlier rounds are deleted, and the verdicts of hosts meet the pages by a lookup that no hot host slows.

Defined cases: a null url, or one without ``://``, has empty host and path and,
if no rule fits, is allowed; null html has no links; repeated rows count as
pages of their own; a page of any length is searched whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import storage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Action, host and path of the contract's rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING, RATIO = 0.85, 2.0
#: Terms of the series, a power of two.
ROUNDS = 64
#: Rounds of one job.
EVERY = 6
#: Paths that are written as steps of twice the length.
FEW_PATHS = 1_000_000
#: Masses that are this near to the ratio, relatively, are at it.
NEAR = 1e-9
#: Edges up to which rounds are worked in groups of EVERY; beyond, each is written.
FEW_EDGES = 100_000
LINK = r"""(?i:href|src)\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def match(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct of rule and action; null if none does."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest ends up outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src``, ``dst`` and ``weight`` (pages of src with a link to dst, parent steps as 1), no loops."""
    host = host_of(F.col(url_col)).alias("src")
    links = pages.select(host, F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1)).alias("to"))
    links = links.where("size(to) > 0").select("src", F.explode("to").alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    links = links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    links = storage.stage(pages.sparkSession, links, "host_links")  # the pages are searched once
    hosts = pages.select(host).unionByName(links.select(F.col("dst").alias("src"))).distinct()
    labels = F.split("src", "\\.")
    # a host and all its parent domains of two labels or more, each beside the next
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    many = F.greatest(F.size(labels) - 2, F.lit(0))  # valid for short hosts too: Spark may evaluate it before the filter
    steps = hosts.where(F.size(labels) >= 3).select(F.arrays_zip(F.slice(chain, 1, many).alias("a"), F.slice(chain, 2, many).alias("b")).alias("z"))
    steps = steps.select(F.explode("z").alias("z")).select(F.col("z.a").alias("src"), F.col("z.b").alias("dst")).distinct()
    both = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``kind`` (t or d), ``host`` and ``mass`` of all terms. ``seeds``: the same columns."""
    spark = edges.sparkSession
    back = edges.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = edges.select(F.lit("t").alias("kind"), "src", "dst", "weight").unionByName(back)
    total = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    share = (F.lit(DAMPING) * F.col("weight") / F.col("total")).alias("share")
    steps = storage.stage(spark, both.join(total, ["kind", "src"]).select("kind", "src", "dst", share), "host_edges")
    base = storage.stage(spark, seeds.select("kind", "host", (F.lit(1 - DAMPING) * F.col("mass")).alias("mass")), "mass")
    edges_n, length = steps.count(), 1
    while edges_n <= FEW_EDGES and length < ROUNDS // 2 and paths(steps) <= FEW_PATHS:
        twice = storage.stage(spark, moved(base, steps, base), "mass"), storage.stage(spark, squared(steps), "host_edges")
        storage.discard(spark, base)
        storage.discard(spark, steps)
        (base, steps), length = twice, 2 * length
    hubs = None
    if edges_n > FEW_EDGES:
        degree = steps.groupBy("kind", "src").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, edges_n // storage.HOT_KEYS))
        hubs = F.broadcast(storage.stage(spark, degree.select("kind", "src"), "hubs"))  # HOT_KEYS at most
    mass, written, rounds = base, None, ROUNDS // length - 1
    for i in range(1, rounds + 1):
        mass = moved(mass, steps, base, hubs)
        if hubs is not None or i % EVERY == 0 or i == rounds:
            mass, before = storage.stage(spark, mass, "mass"), written
            if before is not None:
                storage.discard(spark, before)
            written = mass
    return mass


def moved(mass: DataFrame, steps: DataFrame, base: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """``base`` and what ``mass`` sends along ``steps``; the masses of ``hubs`` are broadcast."""
    mass = mass.withColumnRenamed("host", "src")
    flow = steps.join(mass, ["kind", "src"])
    if hubs is not None:
        few = F.broadcast(mass.join(hubs, ["kind", "src"], "left_semi"))
        flow = steps.join(hubs, ["kind", "src"], "left_anti").join(mass, ["kind", "src"]).unionByName(steps.join(few, ["kind", "src"]))
    flow = flow.select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("mass")).alias("mass"))
    return flow.unionByName(base).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def paths(steps: DataFrame) -> int:
    """How many pairs of steps follow each other."""
    ends = steps.groupBy("kind", F.col("dst").alias("src")).agg(F.count("*").alias("ends"))
    pairs = steps.groupBy("kind", "src").agg(F.count("*").alias("starts")).join(ends, ["kind", "src"])
    return pairs.agg(F.sum(F.col("ends") * F.col("starts"))).first()[0] or 0


def squared(steps: DataFrame) -> DataFrame:
    """Steps of twice the length."""
    then = steps.select("kind", F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("share").alias("then"))
    two = steps.withColumnRenamed("dst", "mid").join(then, ["kind", "mid"])
    return two.groupBy("kind", "src", F.col("to").alias("dst")).agg(F.sum(F.col("share") * F.col("then")).alias("share"))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` of every row."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("hit", match(F.col("host"), F.col("path"), rules))
    count = lambda a: F.count(F.when(F.col("hit.action") == a, 1))
    hosts = storage.stage(spark, rows.groupBy("host").agg(F.count("*").alias("n"), count("allow").alias("t"), count("block").alias("d")), "hosts")
    total = hosts.agg(F.sum("n")).first()[0] or 0
    seeds = hosts.where("host <> ''").select("host", F.explode(F.create_map(F.lit("t"), "t", F.lit("d"), "d")).alias("kind", "k")).where("k > 0")
    mass = propagate(host_edges(pages, url_col, html_col), seeds.select("kind", "host", (F.col("k") / F.lit(max(total, 1))).alias("mass")))
    scores = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "t", F.col("mass"))).alias("trust"), F.sum(F.when(F.col("kind") == "d", F.col("mass"))).alias("distrust"))
    scores = hosts.select("host", "n").join(scores, "host", "left").select("host", "n", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    scores = storage.stage(spark, scores, "host_scores")
    suspect = (F.col("distrust") > 0) & (F.col("distrust") * (1 + NEAR) >= RATIO * F.col("trust"))
    found = storage.lookup(rows, scores, "host", total, "n")
    verdict = F.coalesce("hit.action", F.when(suspect, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "hit.rule", verdict.alias("verdict"), "trust", "distrust")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, a) for a, h, p in ranked]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for c, _, a in fits) + " END"
    return rf"""
WITH RECURSIVE u AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (SELECT *, {rule} AS rule, {action} AS act FROM u),
link AS (
  SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (
    SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '(?i:href|src)\s*=\s*["'']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1))), '{UPPER}', '{LOWER}') AS dst FROM u
  ) WHERE src <> '' AND src <> dst GROUP BY src, dst
), hosts AS (SELECT DISTINCT string_split(h, '.') AS p FROM (SELECT host AS h FROM u UNION ALL SELECT dst FROM link)),
step AS (
  SELECT DISTINCT array_to_string(p[i:], '.') AS src, array_to_string(p[i + 1:], '.') AS dst
  FROM (SELECT p, unnest(range(1, len(p) - 1)) AS i FROM hosts WHERE len(p) >= 3)
), g AS (
  SELECT src, dst, sum(weight) AS weight FROM (
    SELECT * FROM link UNION ALL SELECT src, dst, 1.0 FROM step UNION ALL SELECT dst, src, 1.0 FROM step) GROUP BY src, dst
), b AS (SELECT 't' AS kind, src, dst, weight FROM g UNION ALL SELECT 'd', dst, src, weight FROM g),
e AS (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM b),
m0 AS (
  SELECT CASE act WHEN 'allow' THEN 't' ELSE 'd' END AS kind, host, count(*) / (SELECT count(*) FROM pages) AS mass
  FROM r WHERE act IS NOT NULL AND host <> '' GROUP BY 1, 2
), m AS (
  SELECT 0 AS i, kind, host, {1 - DAMPING} * mass AS mass FROM m0
  UNION ALL
  SELECT i + 1, kind, host, sum(mass) FROM (
    SELECT m.i, e.kind, e.dst AS host, {DAMPING} * e.share * m.mass AS mass FROM m JOIN e ON m.kind = e.kind AND m.host = e.src WHERE m.i < {ROUNDS - 1}
    UNION ALL SELECT x.i, m0.kind, m0.host, {1 - DAMPING} * m0.mass FROM m0, (SELECT DISTINCT i FROM m WHERE i < {ROUNDS - 1}) x
  ) GROUP BY i, kind, host
),
s AS (SELECT host, sum(mass) FILTER (kind = 't') AS t, sum(mass) FILTER (kind = 'd') AS d FROM m WHERE i = {ROUNDS - 1} GROUP BY host)
SELECT page_id, host, path, rule,
       coalesce(act, CASE WHEN coalesce(d, 0) > 0 AND d * (1 + {NEAR}) >= {RATIO} * coalesce(t, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN s USING (host)
"""


OP5_SQL = _sql()
