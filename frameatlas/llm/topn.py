"""The N best items of every group, however large a group is.

Exact group counts split the groups.  Light groups (the rule) take an ordinary
``row_number`` window.  Heavy groups are range-sorted over many tasks: rows are
range-partitioned by (group, score, item), every slice keeps its first N, and
only those survivors meet in a final window.  A group counts as heavy from
``max(heavy_rows, rows / 1000)`` rows, so there are never more than 1000 heavy
groups and their list may be broadcast.

Ties in the score go to the smaller item.  Rows whose group, score or item is
null, or whose score is NaN, take no part; an item listed twice in a group counts
once, with its best score; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.runtime import materialize, partitions_for


def latest_per_item(df: DataFrame, item: str, at: str, keep: list[str]) -> DataFrame:
    """The row of each item with the greatest ``at`` (nulls first); equal times are settled by the kept values."""
    value = F.struct(F.col(at).isNotNull().alias("_has"), F.col(at).alias("_at"), *[F.col(c) for c in keep])
    return df.where(F.col(item).isNotNull()).groupBy(F.col(item)).agg(F.max(value).alias("_m")).select(item, *[F.col(f"_m.{c}").alias(c) for c in keep])


def top_n(df: DataFrame, group: str, score: str, item: str, n: int, heavy_rows: int = 20_000, slice_rows: int = 100_000, ascending: bool = True) -> DataFrame:
    """``(group, item, score, position)`` of the N first items per group."""
    s = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), (s if ascending else -s).alias("s")).where("g is not null and i is not null and s is not null and not isnan(s)")
    rows = rows.groupBy("g", "i").agg(F.min("s").alias("s"))
    base = materialize(rows, "topn")
    counts = base.df.groupBy("g").agg(F.count("*").alias("c"))
    total = base.rows()
    bar = max(heavy_rows, total // 1000)
    heavy = materialize(counts.where(F.col("c") >= bar).select("g"), "topn-heavy")
    n_heavy = heavy.rows()
    best = W.partitionBy("g").orderBy("s", "i")
    light_rows = base.df.join(F.broadcast(heavy.df), "g", "left_anti") if n_heavy else base.df
    out = light_rows.withColumn("position", F.row_number().over(best)).where(F.col("position") <= n)
    if n_heavy:
        slices = base.df.join(F.broadcast(heavy.df), "g", "left_semi").repartitionByRange(partitions_for(total, slice_rows, least=8), "g", "s", "i").withColumn("_slice", F.spark_partition_id())
        local = W.partitionBy("g", "_slice").orderBy("s", "i")
        few = slices.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n).select("g", "i", "s")
        out = out.unionByName(few.withColumn("position", F.row_number().over(best)).where(F.col("position") <= n))
    shown = F.col("s") if ascending else -F.col("s")
    return out.select(F.col("g").alias(group), F.col("i").alias(item), shown.alias(score), "position")
