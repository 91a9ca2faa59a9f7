"""Windows, positions and exact quantiles of groups of any size, without a group in one task.

Rows are range-partitioned by (group, order) and written once with the number of their
slice.  Whatever a slice can't know, what came before it in a group, is one row per
slice and group; those few rows are windowed and joined back.  ``order`` must settle
ties (quantiles need not: equal values are interchangeable).  A null group is a group
of its own; an empty table gives no rows; columns may not start with an underscore.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.runtime import materialize, partitions_for

PER_SLICE = 200_000


def _sliced(df: DataFrame, group: str, order: Sequence[str], per_slice: int) -> DataFrame:
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    return materialize(df.repartitionByRange(partitions_for(df.count(), per_slice), *keys).withColumn("_slice", F.spark_partition_id()), "slices").df


def _local(group: str, order: Sequence[str]):
    return W.partitionBy("_slice", group).orderBy(*[F.col(c).asc_nulls_first() for c in order])


def _joined(rows: DataFrame, told: DataFrame, group: str) -> DataFrame:
    told = told.withColumnsRenamed({"_slice": "_s", group: "_g"})
    return rows.join(told, (F.col("_slice") == F.col("_s")) & F.col(group).eqNullSafe(F.col("_g")), "left").drop("_s", "_g")


def grouped_positions(df: DataFrame, group: str, order: Sequence[str], name: str = "position", per_slice: int = PER_SLICE) -> DataFrame:
    """``df`` with the place 1..n of every row in its group, and ``<name>_of``, the size of the group."""
    rows = _sliced(df, group, order, per_slice)
    n = rows.groupBy("_slice", group).agg(F.count("*").alias("_n"))
    by = W.partitionBy(group)
    told = n.select("_slice", group, (F.sum("_n").over(by.orderBy("_slice")) - F.col("_n")).alias("_before"), F.sum("_n").over(by).alias("_of"))
    placed = _joined(rows.withColumn("_r", F.row_number().over(_local(group, order))), told, group)
    return placed.withColumn(name, F.col("_r") + F.col("_before")).withColumn(f"{name}_of", F.col("_of")).drop("_slice", "_r", "_before", "_of")


def previous(df: DataFrame, group: str, order: Sequence[str], col: str, name: str, per_slice: int = PER_SLICE) -> DataFrame:
    """``df`` with the value of ``col`` one row earlier in the group (null for the first)."""
    rows = _sliced(df, group, order, per_slice)
    last = rows.groupBy("_slice", group).agg(F.max_by(F.struct(F.col(col).alias("v")), F.struct(*order)).alias("_last"))
    told = last.select("_slice", group, F.lag("_last").over(W.partitionBy(group).orderBy("_slice")).alias("_prev"))
    local = _local(group, order)
    seen = rows.withColumn("_r", F.row_number().over(local)).withColumn(name, F.lag(col).over(local))
    return _joined(seen, told, group).withColumn(name, F.when(F.col("_r") == 1, F.col("_prev.v")).otherwise(F.col(name))).drop("_slice", "_r", "_prev")


def last_known(df: DataFrame, group: str, order: Sequence[str], col: str, name: str, per_slice: int = PER_SLICE) -> DataFrame:
    """``df`` with the latest value of ``col`` that isn't null, up to the row itself."""
    rows = _sliced(df, group, order, per_slice)
    last = rows.where(F.col(col).isNotNull()).groupBy("_slice", group).agg(F.max_by(col, F.struct(*order)).alias("_last"))
    every = _joined(rows.select("_slice", group).distinct(), last, group)
    told = every.select("_slice", group, F.last("_last", ignorenulls=True).over(W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)).alias("_prev"))
    local = _local(group, order).rowsBetween(W.unboundedPreceding, 0)
    return _joined(rows.withColumn(name, F.last(col, ignorenulls=True).over(local)), told, group).withColumn(name, F.coalesce(name, "_prev")).drop("_slice", "_prev")


def exact_quantiles(df: DataFrame, group: str | None, value: str, wanted: dict[str, float], nearest: bool = False, per_slice: int = PER_SLICE) -> DataFrame:
    """One row per group (or one in all): the quantiles ``wanted`` by name, interpolated between ranks or of the nearest rank.

    Null values take no part; a group without values has no row.
    """
    g = group or "_all"
    base = df.where(F.col(value).isNotNull()).select(*([group] if group else [F.lit(0).alias(g)]), F.col(value).cast("double").alias("_v"))
    placed = grouped_positions(base, g, ["_v"], "_p", per_slice)
    here = lambda rank: F.max(F.when(F.col("_p") == rank, F.col("_v")))
    out: list[Column] = []
    keep = F.lit(False)
    for name, q in wanted.items():
        if nearest:
            rank = F.greatest(F.lit(1), F.ceil(F.col("_p_of") * q))
            out.append(here(rank).alias(name))
            keep = keep | (F.col("_p") == rank)
        else:
            at = (F.col("_p_of") - 1) * q
            lo, hi = F.floor(at) + 1, F.ceil(at) + 1
            out.append((here(lo) + (here(hi) - here(lo)) * F.max(at - F.floor(at))).alias(name))
            keep = keep | (F.col("_p") == lo) | (F.col("_p") == hi)
    got = placed.where(keep).groupBy(g).agg(*out)
    return got if group else got.drop(g)
