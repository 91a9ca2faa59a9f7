"""Nearest stored centre of every vector.

The centres are few by nature (a clustering's k rows), yet their size is checked:
up to ``most_bytes`` they go to the executors as one matrix and every Arrow batch is a
matrix product; beyond that the centres are split into blocks, every vector meets one
block per copy, and a map-side combined minimum puts the blocks together again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameatlas.runtime import single_blas_thread


def centroids(df: DataFrame, cluster: str, vec: str) -> DataFrame:
    """``cluster, centre``: element-wise means in double."""
    u = df.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("cluster"), F.posexplode(vec).alias("i", "x"))
    m = u.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


def assign_nearest(df: DataFrame, item: str, vec: str, centres: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """``item, cluster, dist, mad``; ties go to the smaller cluster; vectors of another length are left out.

    An empty set of centres gives no rows.
    """
    spark = df.sparkSession
    size = centres.agg(F.count("*").alias("n"), F.max(F.size("centre")).alias("k")).first()
    n, k = size["n"], size["k"] or 0
    kind = dict(df.dtypes)[item]
    schema = f"{item} {kind}, cluster {dict(centres.dtypes)['cluster']}, dist double, mad double"
    if n == 0:
        return spark.createDataFrame([], schema)
    blocks = max(1, -(-n * k * 8 // most_bytes))
    parts = [centres] if blocks == 1 else [centres.where(F.pmod(F.xxhash64("cluster"), F.lit(blocks)) == b) for b in range(blocks)]
    out = None
    for part in parts:
        rows = part.orderBy("cluster").toArrow()  # at most about most_bytes
        names, mat = rows["cluster"], np.array(rows["centre"].to_pylist(), dtype=np.float64).reshape(-1, k)
        shared = spark.sparkContext.broadcast((names.combine_chunks(), mat))

        def run(batches, shared=shared):
            single_blas_thread()
            labels, c = shared.value
            for b in batches:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, c.shape[1])
                if not len(x):
                    continue
                rough = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T
                best = rough.argmin(1)
                diff = x - c[best]
                yield pa.RecordBatch.from_arrays([b.column(item), labels.take(pa.array(best)), pa.array(np.sqrt((diff * diff).sum(1))), pa.array(np.abs(diff).mean(1))], names=[item, "cluster", "dist", "mad"])

        one = df.where(F.size(vec) == k).select(item, F.col(vec).alias("v")).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    if blocks == 1:
        return out
    return out.groupBy(item).agg(F.min(F.struct("dist", "cluster", "mad")).alias("m")).select(item, "m.cluster", "m.dist", "m.mad")
