"""Pivots, dense matrices and selection of their cells.

Cells stay in long form (row, column, value) for every decision; only exports are
made wide, with the column list given, so no second pass looks for column values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def wide_counts(df: DataFrame, row: str, col: str, values: list, prefix: str = "c_", distinct: str | None = None) -> DataFrame:
    """One count column per value (conditional aggregates: one map-side combined pass)."""
    hit = lambda v: F.count_distinct(F.when(F.col(col) == v, F.col(distinct))) if distinct else F.count_if(F.col(col) == v)
    return df.groupBy(row).agg(*[hit(v).alias(f"{prefix}{v}") for v in values])


def with_total(df: DataFrame, cols: list[str], name: str = "total") -> DataFrame:
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols]))


def full_axis(df: DataFrame, row: str, n: int, cols: list[str]) -> DataFrame:
    """Rows 0..n-1, missing ones filled with zeros."""
    axis = df.sparkSession.range(n).withColumnRenamed("id", row)
    return axis.join(df, row, "left").select(row, *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])


def dense_counts(df: DataFrame, row: str, col: str, rows: int, cols: int, prefix: str = "c_") -> DataFrame:
    """Counts with all rows 0..rows-1 and all columns 0..cols-1, and their total per row; a null row or column is no cell.

    Cells are counted first, so the wide aggregate reads one row per cell.
    """
    names = [f"{prefix}{i}" for i in range(cols)]
    cells = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(F.count("*").alias("_n"))
    wide = cells.groupBy(row).agg(*[F.sum(F.when(F.col(col) == i, F.col("_n"))).alias(c) for i, c in enumerate(names)])
    return with_total(full_axis(wide, row, rows, names), names)


def selected_cells(cells: DataFrame, least: int) -> DataFrame:
    """Cells above ``least`` with their place in row-major order: rows up, values down, columns up."""
    w = W.partitionBy("r").orderBy(F.col("n").desc(), "c")
    return cells.where(F.col("n") > least).withColumn("place", F.row_number().over(w))


def routed_cells(cells: DataFrame, least: int, none_col: int, colour_from: int) -> DataFrame:
    """First match wins: small column, uncoloured, colour, plain, dropped."""
    total = F.sum("n").over(W.partitionBy("c"))
    route = F.when(total < least * 50, "small_column").when((F.col("c") == none_col) & (F.col("n") >= least), "no_colour").when(F.col("n") >= colour_from, "colour").when(F.col("n") >= least, "plain").otherwise("drop")
    return cells.withColumn("route", route)


def subsplit(df: DataFrame, parent: str, sub: str, cutoff: int, least: int) -> DataFrame:
    """Large parents split by ``sub``; small sub-groups vanish, and a parent none of whose groups survive stays whole."""
    per = df.groupBy(parent, sub).agg(F.count("*").alias("n_sub"))
    size = per.groupBy(parent).agg(F.sum("n_sub").alias("n_parent"), F.count_if((F.col("n_sub") >= least) & F.col(sub).isNotNull()).alias("n_alive"))
    split = (F.col("n_parent") >= cutoff) & (F.col("n_alive") > 0)
    j = per.join(size, parent)
    kept = j.where(split & (F.col("n_sub") >= least) & F.col(sub).isNotNull()).select(parent, F.col(sub).cast("string").alias("part"), F.col("n_sub").alias("n"))
    whole = size.where(~split).select(parent, F.lit("whole").alias("part"), F.col("n_parent").alias("n"))
    return kept.unionByName(whole)
