"""Filters, joins and set operations that recur in every cohort query.

All of them take and return DataFrames and leave the physical choice to Catalyst.
Null keys never match; extra columns pass through unless stated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.runtime import materialize, partitions_for


def in_open_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows strictly inside every range (both ends excluded)."""
    return df.where(reduce(lambda a, b: a & b, [(F.col(c) > lo) & (F.col(c) < hi) for c, (lo, hi) in ranges.items()], F.lit(True)))


def keyword_cohort(bridge: DataFrame, item: str, word: str, any_of=(), all_of=(), none_of=()) -> DataFrame:
    """Items by a boolean keyword expression, judged per item (not per bridge row)."""
    wanted = [*any_of, *all_of, *none_of]
    hits = bridge.where(F.col(word).isin(wanted)).groupBy(item).agg(F.collect_set(word).alias("w"))
    cond = F.lit(True)
    if any_of:
        cond &= F.arrays_overlap("w", F.array(*map(F.lit, any_of)))
    for x in all_of:
        cond &= F.array_contains("w", x)
    for x in none_of:
        cond &= ~F.array_contains("w", x)
    return hits.where(cond).select(item)


def at_least_k_of(bridge: DataFrame, item: str, word: str, words: list[str], k: int) -> DataFrame:
    """Items that carry at least k different words of a list."""
    return bridge.where(F.col(word).isin(words)).groupBy(item).agg(F.count_distinct(word).alias("n_words")).where(F.col("n_words") >= k)


def last_wins(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in ``order`` (all columns kept). Ties must be settled by ``order``."""
    w = W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_wins(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*[c.asc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fill_nulls_from(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Fill-only update: a null of ``old`` takes the value of ``new`` (unique per key), nothing is overwritten."""
    other = new.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    j = old.join(other, key, "left")
    return j.select(*[F.coalesce(c, f"_{c}").alias(c) if c in cols else c for c in old.columns])


def merge_insert_absent(existing: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows plus the batch rows whose key is new (applying a batch twice equals once)."""
    return existing.unionByName(batch.join(existing.select(*key), key, "left_anti"))


def upsert(existing: DataFrame, batch: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Last write per key wins by ``seq``; replays change nothing."""
    return last_wins(existing.unionByName(batch), key, [F.col(seq)])


def unordered_pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key once with where it is found: left, right or both."""
    ls, rs = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("l", F.lit(1)), right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "both").when(F.col("l").isNotNull(), "left").otherwise("right")
    return ls.join(rs, key, "full").select(key, side.alias("found_in"))


def ordered_positions(df: DataFrame, order: list[str], name: str = "position", rows_per_slice: int = 200_000) -> DataFrame:
    """Places 1..n in a total order, without gathering the rows in one task.

    Rows are range-partitioned by ``order`` (which must settle ties), numbered inside
    their slice, and shifted by the counts of the slices before; only those counts, one
    row per slice, are windowed globally.  The sliced rows are written once, so slices
    can't shift between the two reads.
    """
    n = partitions_for(df.count(), rows_per_slice)
    sliced = materialize(df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()), "ordered").df
    before = sliced.groupBy("_slice").agg(F.count("*").alias("_n")).select("_slice", (F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy("_slice")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(W.partitionBy("_slice").orderBy(*order))
    return sliced.join(F.broadcast(before), "_slice").withColumn(name, local.cast("long") + F.col("_before")).drop("_slice", "_before")
