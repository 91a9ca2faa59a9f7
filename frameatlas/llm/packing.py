"""Texts packed into training windows of one fixed size.

Sizes are tokens of a public tokenizer.  A text longer than the window is cut into
whole windows and a rest; nothing else is ever split.  Items are spread evenly over
partitions of about ``items_per_part`` and packed there best-fit decreasing.  Lower
bounds from dual feasible functions certify a partition whose number of windows can't
be beaten.  Partitions with a gap give the texts of their unfilled windows to a pool,
which is spread over new, fewer partitions and packed again, until all are certified or
a round saves nothing.

A partition is bounded by the number of items, however they are distributed over
sources; the pool shrinks from round to round; each round is written to the shared
folder.  The overall bound needs only the counts per size (at most ``capacity`` rows).

Defined cases: null and empty texts are no items; equal texts are packed as often as
they come; a text of exactly the window's size is a window of its own; empty tables
give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameatlas.llm.tokens import VOCABULARY, token_counts
from frameatlas.runtime import materialize, partitions_for, table

CAPACITY = 2_048
_PACKED = "bin_id long, doc_id long, piece int, start_token long, tokens int, fill int, gap int"


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Windows that any packing needs; ``counts[s]`` items of size s (1..capacity).

    The largest of three families of dual feasible functions: the identity; the
    threshold functions that count sizes above capacity - t as a whole window and drop
    sizes below t; and, for k = 1..20, sizes rounded down to multiples of 1 / (k + 1)
    of the window, with exact multiples kept.
    """
    s = np.arange(len(counts), dtype=np.int64)
    n = counts.astype(np.int64)
    total = int((s * n).sum())
    if total == 0:
        return 0
    best = -(-total // capacity)
    cum_n, cum_s = np.cumsum(n), np.cumsum(s * n)
    t = np.arange(1, capacity // 2 + 1)
    over = cum_n[-1] - cum_n[capacity - t]
    mid = cum_s[capacity - t] - cum_s[t - 1]
    best = max(best, int((over + -(-mid // capacity)).max()))
    for k in range(1, 21):
        x = s * (k + 1)
        exact = x % capacity == 0
        value = np.where(exact, s * k, (x // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number of every item and fill of every window.

    Windows wait in one list per free space; a bit mask of the non-empty lists gives
    the tightest window that fits in one step.
    """
    order = np.argsort(-sizes, kind="stable")
    where = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        where[i] = b
        fills[b] += size
        rest = room - size
        if rest:
            free[rest].append(b)
            mask |= 1 << rest
    return where, np.array(fills, np.int64)


def _pack_part(capacity: int, round_no: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        sizes = pdf["tokens"].to_numpy(np.int64)
        where, fills = best_fit_decreasing(sizes, capacity)
        gap = len(fills) - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        out = pdf[["doc_id", "piece", "start_token", "tokens"]].copy()
        out.insert(0, "bin_id", (round_no << 56) + (int(pdf["part"].iloc[0]) << 24) + where)
        out["fill"], out["gap"] = fills[where].astype(np.int32), np.int32(gap)
        return out

    return run


def items(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start_token, tokens``: whole texts, or windows and the rest of longer ones."""
    n = docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", token_counts(path)("text").alias("n")).where("n > 0")
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))
    cut = n.select("doc_id", "n", F.explode(pieces).alias("piece"))
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("tokens"))


def pack(sized: DataFrame, capacity: int = CAPACITY, items_per_part: int = 40_000, rounds: int = 6, trace: list[dict] | None = None) -> DataFrame:
    """``bin_id, doc_id, piece, start_token, tokens``: every item once, no window above capacity.

    ``trace`` receives a dict per round: parts, items, windows, the sum of the parts'
    gaps to their lower bounds, and items handed to the pool.
    """
    todo = materialize(sized, "pack-items")
    n, done = todo.rows(), None
    spare = None  # the packing of the pool before it was repacked
    for r in range(rounds):
        parts = partitions_for(n, items_per_part)
        spread = todo.df.withColumn("part", F.pmod(F.xxhash64(F.lit(r), "doc_id", "piece"), F.lit(parts)))
        now = materialize(spread.groupBy("part").applyInPandas(_pack_part(capacity, r), _PACKED), "pack-round")
        bins = now.df.groupBy("bin_id").agg(F.first("gap").alias("gap"), F.first("fill").alias("fill"), F.count("*").alias("n"))
        is_open = (F.col("gap") > 0) & (F.col("fill") < capacity)
        seen = bins.groupBy(F.shiftright("bin_id", 24).alias("part")).agg(F.count("*").alias("w"), F.max("gap").alias("gap"), F.sum(F.when(is_open, F.col("n"))).alias("pool"))
        sums = seen.agg(F.sum("w").alias("windows"), F.sum("gap").alias("gap"), F.sum("pool").alias("pool")).first()
        left = int(sums["pool"] or 0)
        if trace is not None:
            trace.append({"round": r, "parts": parts, "items": n, "windows": int(sums["windows"] or 0), "gap": int(sums["gap"] or 0), "pooled": left})
        if spare is not None and int(sums["windows"] or 0) >= spare.select("bin_id").distinct().count():
            return done.unionByName(spare)
        kept = now.df.where(~is_open)
        done = kept if done is None else done.unionByName(kept)
        spare = now.df.where(is_open)
        if left == 0 or parts == 1:
            return done.unionByName(spare)
        todo.drop()
        todo = materialize(spare.select("doc_id", "piece", "start_token", "tokens"), "pack-items")
        n = left
    return done.unionByName(spare)


def p8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(items(table(spark, sf_dir, "documents"))).select("bin_id", "doc_id", "piece", "start_token", "tokens")


def p8_report(spark, sf_dir: str) -> DataFrame:
    """Texts, items, windows used, the certified least number, and the share of tokens that are filled."""
    packed = materialize(p8_packing(spark, sf_dir), "packed").df
    hist = packed.groupBy("tokens").agg(F.count("*").alias("n")).collect()  # at most CAPACITY rows
    counts = np.zeros(CAPACITY + 1, np.int64)
    for row in hist:
        counts[row["tokens"]] = row["n"]
    bound = lower_bound(counts, CAPACITY)
    total = packed.agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_items"), F.count_distinct("bin_id").alias("n_windows"), F.sum("tokens").alias("n_tokens"))
    return total.select("*", F.lit(bound).cast("long").alias("least_windows"), F.round(F.col("n_tokens") / (F.nullif(F.col("n_windows"), F.lit(0)) * CAPACITY), 6).alias("filled"))


SMALL, FEW = 128, 50  # a window and partitions small enough that bounds are missed and texts exchanged


def p8_rounds(spark, sf_dir: str) -> DataFrame:
    """The rounds of a packing into windows of 128 tokens over partitions of 50 items, in which partitions with a gap exchange texts."""
    trace: list[dict] = []
    pack(items(table(spark, sf_dir, "documents"), capacity=SMALL), capacity=SMALL, items_per_part=FEW, trace=trace)
    return spark.createDataFrame(trace, "round int, parts int, items long, windows long, gap long, pooled long")


def p8_checks(spark, sf_dir: str) -> DataFrame:
    """Of that packing: texts placed, and how many break a rule (token lost or placed twice, window overfull, short text cut)."""
    sized = materialize(items(table(spark, sf_dir, "documents"), capacity=SMALL), "pack-items").df
    packed = materialize(pack(sized, capacity=SMALL, items_per_part=FEW), "packed").df
    overfull = packed.groupBy("bin_id").agg(F.sum("tokens").alias("t")).where(F.col("t") > SMALL).agg(F.count("*").alias("n_overfull"))
    of = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("t"), F.max(F.col("start_token") + F.col("tokens")).alias("end"), F.min("start_token").alias("start"))
    was = sized.groupBy("doc_id").agg(F.sum("tokens").alias("t0"))
    by_doc = was.join(of, "doc_id", "full").agg(
        F.count("pieces").alias("n_docs"),
        F.count_if(~F.col("t").eqNullSafe(F.col("t0")) | (F.col("end") != F.col("t0")) | (F.col("start") != 0)).alias("n_wrong"),
        F.count_if((F.col("t0") <= SMALL) & (F.col("pieces") > 1)).alias("n_cut"),
    )
    return by_doc.join(overfull)  # one row each


QUERIES = {"p8_packing": p8_packing, "p8_report": p8_report, "p8_rounds": p8_rounds, "p8_checks": p8_checks}
SQL = {"p8_checks": "SELECT count(DISTINCT doc_id) AS n_docs, 0 AS n_wrong, 0 AS n_cut, 0 AS n_overfull FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''"}
