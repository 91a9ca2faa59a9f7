"""Sources combined to target shares of the total size, by Poisson replication.

A text's copies follow a Poisson distribution whose uniform draw is a hash of the
text and a seed, so any executor draws the same.  Each source has a target rate
(copies per text on average); the distribution is cut at ``max_repeats`` and its mean
is raised until the cut distribution keeps the target rate, so the cap doesn't pull
shares down; of a few seeds a source takes the one whose draw lands nearest to its
target size, which removes most of the chance of small sources.  The total is the largest at which no source with texts needs more than
its cap; the source that sets it uses every text exactly that often.

The unit is the distinct text: equal texts are one unit that belongs to the source of
its smallest document, so no text comes more than the cap of any source allows.
Whole texts only; sizes are tokens of a public tokenizer.  Rows that are copies of one
another collapse in a map-side combined aggregate.  The shuffle is a range sort by a
hash of (document, copy): a global random order that any part of the output can be
read in.

Defined cases: null, empty and blank texts, null sources and sources without a target
are left out; a target without texts keeps its row in the report with share 0, and the
others share the whole in the ratio of their targets; zero or null targets get no
copies; null ``max_repeats`` counts as 1; empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.llm.tokens import VOCABULARY, token_counts
from frameatlas.runtime import materialize, table

SEED, SEEDS = 20_240_601, 16


def _poisson(lam: float, cap: int) -> list[float]:
    """P(copies = i) for i below the cap; logarithms keep great means from vanishing."""
    if lam <= 0:
        return [1.0, *[0.0] * (cap - 1)] if cap else []
    log = math.log(lam)
    return [math.exp(i * log - lam - math.lgamma(i + 1)) for i in range(cap)]


def _cut_mean(lam: float, cap: int) -> float:
    """Mean of min(Poisson(lam), cap)."""
    p = _poisson(lam, cap)
    return sum(i * x for i, x in enumerate(p)) + cap * max(0.0, 1.0 - sum(p))


def rate_parameter(rate: float, cap: int) -> float:
    """The Poisson mean whose distribution, cut at ``cap``, has mean ``rate``."""
    if rate >= cap - 1e-9 * max(1, cap):
        return math.inf
    lo, hi = 0.0, 1.0
    while _cut_mean(hi, cap) < rate:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _cut_mean(mid, cap) < rate else (lo, mid)
    return (lo + hi) / 2


def thresholds(rate: float, cap: int) -> list[float]:
    """P(copies <= i) for i below the cap: the inverse distribution as a step list."""
    lam = rate_parameter(rate, cap)
    if math.isinf(lam):
        return [0.0] * cap
    return [min(1.0, x) for x in itertools.accumulate(_poisson(lam, cap))]


def uniform(seed: Column, *cols: Column) -> Column:
    """A hash-seeded uniform number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(SEED), seed, *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def units(docs: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """``doc_id, source, tokens``: one row per distinct text of a source that has a target."""
    named = docs.where("doc_id is not null and text is not null and trim(text) <> '' and source is not null").join(F.broadcast(targets.where("source is not null").select("source").distinct()), "source", "left_semi")
    key = [F.sha2("text", 256).alias("key")]
    first = named.select("doc_id", "source", *key).groupBy("key").agg(F.min(F.struct("doc_id", "source")).alias("m")).select("m.doc_id")
    return named.select("doc_id", "source", "text").join(first, "doc_id", "left_semi").select("doc_id", "source", token_counts(path)("text").alias("tokens")).where("tokens > 0")


def mix(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, report)``: rows are ``position_key, doc_id, source, copy, tokens`` in shuffled order."""
    spark = docs.sparkSession
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    goals = {r["source"]: (float(r["target_share"] or 0.0), max(0, int(r["max_repeats"]))) for r in goal.collect()}  # one row per source with a target
    u = materialize(units(docs, goal, path), "mix-units").df
    sizes = {r["source"]: int(r["t"]) for r in u.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    live = {s: (w, c) for s, (w, c) in goals.items() if w > 0 and c > 0 and sizes.get(s, 0) > 0}
    whole = sum(w for w, _ in live.values())
    most = min((c * sizes[s] / (w / whole) for s, (w, c) in live.items()), default=0.0)
    total = min(float(total_tokens), most) if total_tokens else most
    steps = [(s, thresholds(total * w / whole / sizes[s], c)) for s, (w, c) in live.items()]
    plan = spark.createDataFrame(steps, "source string, steps array<double>")
    drawn = lambda seed: F.size(F.filter("steps", lambda x: x <= uniform(seed, F.col("doc_id"))))
    # of a few seeds per source the one whose draw comes nearest: one aggregate, one row per source
    tried = u.join(F.broadcast(plan), "source").groupBy("source").agg(*[F.sum(F.col("tokens") * drawn(F.lit(j))).alias(f"t{j}") for j in range(SEEDS)])
    seeds = {r["source"]: min(range(SEEDS), key=lambda j: abs(r[f"t{j}"] - total * live[r["source"]][0] / whole)) for r in tried.collect()}
    plan = spark.createDataFrame([(s, t, seeds[s]) for s, t in steps if s in seeds], "source string, steps array<double>, seed int")
    n = drawn(F.col("seed"))
    copies = u.join(F.broadcast(plan), "source").select("doc_id", "source", "tokens", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("copy"))
    rows = copies.select(F.xxhash64(F.lit(SEED + 1), "doc_id", "copy").alias("position_key"), "doc_id", "source", "copy", "tokens")
    used = rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_texts"), F.max("copy").alias("most_copies"), F.sum("tokens").alias("tokens"))
    wanted = spark.createDataFrame([(s, w, c) for s, (w, c) in goals.items()], "source string, target_share double, max_repeats int")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    whole_tokens = F.sum("tokens").over(W.partitionBy(F.lit(1)))  # one row per source
    report = wanted.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", zero("n_rows"), zero("n_texts"), zero("most_copies"), zero("tokens"), F.round(F.coalesce(F.col("tokens") / F.nullif(whole_tokens, F.lit(0)), F.lit(0.0)), 6).alias("actual_share")
    )
    return rows.orderBy("position_key", "doc_id", "copy"), report


def p9_mixture(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]


def p9_checks(spark, sf_dir: str) -> DataFrame:
    """Every target with whether its share is met (to 0.01 of the shares that sources with texts can have) and its cap kept."""
    report = p9_shares(spark, sf_dir)
    whole = F.sum(F.when(F.col("n_rows") > 0, F.col("target_share"))).over(W.partitionBy(F.lit(1)))  # one row per source
    wanted = F.when(F.col("n_rows") > 0, F.col("target_share") / whole).otherwise(0.0)
    return report.select("source", "max_repeats", (F.col("n_rows") > 0).alias("has_rows"), (F.abs(F.col("actual_share") - wanted) <= 0.01).alias("share_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_checks": p9_checks}
SQL = {
    "p9_checks": """SELECT t.source, t.max_repeats, count(d.doc_id) > 0 AS has_rows, true AS share_met, true AS cap_kept
  FROM source_targets AS t LEFT JOIN documents AS d ON d.source = t.source AND d.doc_id IS NOT NULL AND trim(d.text) <> '' WHERE t.source IS NOT NULL GROUP BY 1, 2"""
}
